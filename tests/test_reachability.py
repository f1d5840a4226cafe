"""Interval labels against the table of all ancestors."""

import random

import pytest

from strandline.operators import ontology, reachability


def ancestors(up):
    out = {}

    def above(x):
        if x not in out:
            out[x] = set()
            for a, b in up:
                if a == x:
                    out[x] |= {b} | above(b)
        return out[x]

    for a, b in up:
        above(a), above(b)
    return out


def some(seed, n):
    """An acyclic hierarchy: a tree, then more and more terms with several parents; two roots."""
    r = random.Random(seed)
    up = {(f"t{i}", f"t{r.randrange(i)}") for i in range(2, n)}
    for _ in range((0, n // 8, n)[seed % 3]):
        a, b = sorted(r.sample(range(n), 2))
        up.add((f"t{b}", f"t{a}"))
    return sorted(up)


@pytest.mark.parametrize("seed", range(3))
def test_labels_equal_the_ancestor_table(spark, seed):
    up = some(seed, 28)
    rows = [*up, up[0], ("t3", None), (None, "t1"), ("t5", "t5")]
    labels = reachability.label(spark.createDataFrame(rows, "term string, parent string"))
    above = ancestors(up)
    names = [*above, "unknown"]
    pairs = spark.createDataFrame([(a, d) for a in names for d in names], "ancestor string, term string")
    got = {(r["ancestor"], r["term"]) for r in reachability.is_ancestor(pairs, labels).where("above").collect()}
    assert got == {(a, d) for d in above for a in above[d]}
    assert labels.tree.count() == len(above) and (labels.extra.isEmpty() or seed)
    r = random.Random(seed + 50)
    cats = [(f"s{i}", r.choice(names)) for i in range(40) for _ in range(r.randrange(1, 7))]
    df = spark.createDataFrame(cats, "subject string, category string")
    table = spark.createDataFrame([(d, a) for d in above for a in above[d]], "term string, ancestor string")
    want = sorted(map(tuple, ontology.most_specific(df, table).collect()))
    assert sorted(map(tuple, reachability.most_specific(df, labels).collect())) == want


def test_deep_wide_and_empty(spark):
    chain = [(f"c{i:04d}", f"c{i - 1:04d}") for i in range(1, 300)] + [(f"w{i}", "c0000") for i in range(300)]
    labels = reachability.label(spark.createDataFrame(chain, "term string, parent string"))
    pairs = spark.createDataFrame([("c0000", "c0299"), ("c0150", "c0149"), ("c0149", "c0150"), ("c0000", "w7"), ("c0001", "w7"), ("w1", "w2")], "ancestor string, term string")
    assert {(r["ancestor"], r["term"]) for r in reachability.is_ancestor(pairs, labels).where("above").collect()} == {("c0000", "c0299"), ("c0149", "c0150"), ("c0000", "w7")}
    none = reachability.label(spark.createDataFrame([], "term string, parent string"))
    assert none.tree.count() == 0 and reachability.is_ancestor(pairs, none).where("above").count() == 0


@pytest.mark.parametrize("up", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]])
def test_cycles_are_errors(spark, up):
    with pytest.raises(ValueError, match="cycle"):
        reachability.label(spark.createDataFrame(up, "term string, parent string"))
