"""Closures by doubling, property lists in chunks, resources in the scan."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import terms as T
from strandline.operators import ontology, properties, triples
from strandline.sources import records, shared


def folders(spark):
    from pathlib import Path

    return {p.name for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("closure-*")}


def test_a_chain_of_five_thousand_in_few_rounds(spark):
    up = spark.range(1, 5001).selectExpr("cast(id as string) AS term", "cast(id - 1 AS string) AS parent")
    before = folders(spark)
    got = ontology.closure(spark.createDataFrame([("5000",), ("17",)], "term string"), up, ["term"])
    assert got.count() == 5001 and got.rounds <= 14
    assert len(folders(spark) - before) == 1  # each round discards the one before


def plain(start, up):
    found, new = set(start), list(start)
    while new:
        x = new.pop()
        for a, b in up:
            if a == x and b not in found:
                found.add(b)
                new.append(b)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_closures_equal_plain_search(spark, seed):
    """Cycles, several parents, unknown terms, repeated and null rows; the last two graphs fall back to single steps."""
    r = random.Random(seed)
    n, many = (30, 35) if seed < 2 else (40, 200)
    up = [(str(r.randrange(n)), str(r.randrange(n))) for _ in range(many)]
    if seed == 3:
        up = [(str(i), str(j)) for i in range(40) for j in range(i + 1, min(40, i + 5))] + [("39", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    start = ["0", "3", "nowhere"]
    df = spark.createDataFrame([*up, up[0], ("1", None)], "term string, parent string")
    before = folders(spark)
    got = ontology.closure(spark.createDataFrame([(x,) for x in start], "term string"), df, ["term"])
    assert sorted(x[0] for x in got.collect()) == sorted(plain(start, up))
    assert len(folders(spark) - before) == 1


def test_closures_by_two_keys_and_of_nothing(spark):
    ep = spark.createDataFrame([("A", "x", "y"), ("B", "x", "z"), ("A", "y", "w"), ("B", "y", "never")], "enum string, value string, parent string")
    got = ontology.closure(spark.createDataFrame([("A", "x"), ("B", "x")], "enum string, value string"), ep, ["enum", "value"])
    assert {tuple(x) for x in got.collect()} == {("A", "x"), ("A", "y"), ("A", "w"), ("B", "x"), ("B", "z")}
    assert ontology.closure(ep.select("enum", "value").limit(0), ep, ["enum", "value"]).count() == 0
    assert ontology.closure(ep.select("enum", "value"), ep.limit(0), ["enum", "value"]).count() == 4


def test_property_lists_in_chunks(spark):
    big = spark.range(25_000).select(F.lit("urn:big").alias("resource"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("predicate"), F.lpad(F.col("id").cast("string"), 6, "0").alias("value"))
    small = spark.createDataFrame([("urn:a", "p", "1"), ("urn:b", "q", "2"), ("urn:b", "p", "3")], "resource string, predicate string, value string")
    got = properties.chunked(big.unionByName(small), 1000).collect()
    rows = sorted((r for r in got if r["resource"] == "urn:big"), key=lambda r: r["chunk"])
    assert [len(r["properties"]) for r in rows] == [1000] * 25 and [r["chunk"] for r in rows] == list(range(25))
    flat = [tuple(p) for r in rows for p in r["properties"]]
    assert flat == sorted((f"p{i % 7}", f"{i:06d}") for i in range(25_000))
    assert {(r["resource"], r["chunk"], tuple(map(tuple, r["properties"]))) for r in got if r["resource"] != "urn:big"} == {("urn:a", 0, (("p", "1"),)), ("urn:b", 0, (("p", "3"), ("q", "2")))}
    assert properties.chunked(small.limit(0)).count() == 0


def test_listed_resources_reach_the_scan(spark, tmp_path, monkeypatch):
    ids = ["A:1", "biolink:x", "http://a/b?c=1+2", "urn:e", "B:a b/c%+é", "https://identifiers.org/A:1", "no curie", "https://w3id.org/biolink/vocab/x"]
    rows = [(f"urn:{i}", a, "biolink:p", "C:1") for i, a in enumerate(ids)] + [(a, "S:1", "q:r", "D:2") for a in ids]
    spark.createDataFrame(rows, "edge string, s string, p string, o string").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    named = [r[0] for r in e.select(T.curie_to_iri("s")).union(e.select(T.curie_to_iri("edge"))).distinct().collect()]
    for listed in (named, named[:3], ["urn:none"], ["https://identifiers.org/no curie", "https://identifiers.org/no%20curie"]):
        r = spark.createDataFrame([(x,) for x in listed], "resource string")
        want = sorted(tuple(x) for x in triples.reify(e).where(F.col("s").isin(listed)).distinct().collect())
        for most in (1000, 1):
            monkeypatch.setattr(triples, "LISTED", most)
            got = triples.of_resources(e, r)
            assert sorted(set(map(tuple, got.collect()))) == want
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert most == 1 or "PushedFilters: [In(s" in plan or "EqualTo(s" in plan


def test_records_without_what_they_need_are_errors(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    for bad in ('{"category":[]}', '{"id":null}', '{"id":"A:1"} more', "[1"):
        with pytest.raises(Exception):
            records.node_rows(lines('{"id":"A:1"}', bad)).collect()
    assert records.node_rows(lines('{"id":"A:1"}')).first()["id"] == "A:1"
    (tmp_path / "t.tsv").write_text('?a\t?b\n"plain"\t"x"^^<urn:t>\n<urn:i>\t\n"q \\" \'"\t\\\n')
    got = [tuple(r) for r in records.read_bindings(spark, str(tmp_path / "t.tsv")).collect()]
    assert got == [('"plain"', '"x"^^<urn:t>'), ("<urn:i>", None), ('"q \\" \'"', "\\")]
