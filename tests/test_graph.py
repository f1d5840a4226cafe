import json

import pytest

from strandline.operators import graph, ontology, paths, properties, triples

SUB = "biolink:subclass_of"


def edges(spark, *rows):
    return spark.createDataFrame([(e, s, p, o) for e, s, p, o in rows], "edge string, s string, p string, o string")


def walk(spark, e, a, b, k, **kw):
    return [tuple(r) for r in paths.find_paths(graph.oriented(e), a, b, k, edges=e, **kw).collect()]


def test_self_loop_gives_both_directions(spark):
    assert len(walk(spark, edges(spark, ("e1", "A", "p", "A")), "A", "A", 1)) == 2


def test_walks_may_return_on_the_same_edge(spark):
    assert len(walk(spark, edges(spark, ("e1", "A", "p", "B")), "A", "A", 2)) == 1


def test_parallel_edges_are_two_paths_and_one_triple(spark):
    e = edges(spark, ("e1", "A", "p", "B"), ("e2", "A", "p", "B"))
    assert len(walk(spark, e, "A", "B", 1)) == 2
    t = triples.reify(e).where("p like '%/p'").distinct()
    assert t.count() == 1


def test_star_join_combines_repeated_ids(spark):
    rows = [("e1", "subject", x) for x in "AC"] + [("e1", "object", x) for x in "BD"] + [("e1", "predicate", "p")]
    assert graph.star_join(spark.createDataFrame(rows, "edge string, key string, value string")).count() == 4


@pytest.mark.parametrize(
    ("rows", "start", "count"),
    [
        ([("s1", "M", SUB, "E"), ("s2", "N", SUB, "M"), ("e1", "X", "p", "N")], "X", 0),
        ([("s1", "M", SUB, "E"), ("s2", "M", SUB, "E"), ("e1", "X", "p", "M")], "X", 2),
        ([("s1", "E", SUB, "M"), ("e1", "X", "p", "M")], "X", 0),
        ([("s1", "M", SUB, "E")], "M", 1),
    ],
)
def test_lifting(spark, rows, start, count):
    assert len(walk(spark, edges(spark, *rows), start, "E", 1, lift_end=True)) == count


def test_oriented_form_equals_branch_union(spark):
    e = edges(spark, ("e1", "A", "p", "B"), ("e2", "B", "q", "C"), ("e3", "C", "p", "A"), ("e4", "B", "p", "B"), ("e5", "C", "r", "B"))
    for k in (1, 2, 3):
        a = {tuple(r) for r in paths.find_paths(graph.oriented(e), "A", "B", k).collect()}
        assert a == {tuple(r) for r in paths.branch_union(e, "A", "B", k).collect()}


def test_bad_length_limits_and_empty(spark):
    e = edges(spark, ("e1", "A", "p", "B"))
    with pytest.raises(ValueError):
        paths.find_paths(graph.oriented(e), "A", "B", 0)
    assert walk(spark, e, "A", "B", 1, limit=0) == []
    assert walk(spark, e.where("false"), "A", "B", 2) == []


def test_filter_reaches_the_scan(spark, tmp_path):
    from strandline.sources.adjacency import open_adjacency, write_adjacency

    write_adjacency(graph.oriented(edges(spark, ("e1", "A", "p", "B"))), f"{tmp_path}/adj")
    plan = paths.find_paths(open_adjacency(spark, f"{tmp_path}/adj"), "A", "B", 2)._jdf.queryExecution().toString()
    assert "EqualTo(f,A)" in plan and "EqualTo(f,B)" in plan  # both halves begin where files are sorted


def test_documents_and_resources(spark):
    e = edges(spark, ("e1", "A", "p", 'B"'), ("e2", 'B"', "q", "C"), ("s1", "D", SUB, "C"), ("e3", 'B"', "q", "D"))
    p = paths.find_paths(graph.oriented(e), "A", "C", 2, edges=e, lift_end=True)
    docs = sorted((r[0] for r in paths.documents(p, 2).collect()), key=len)
    assert docs == [json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")) for x in docs]
    plain, lifted = map(json.loads, docs)
    assert plain == {"node1": {"id": 'B"', "label": None}, "steps": [{"direction": "forward", "edge": "e1", "next_node": 'B"', "predicate": "p"}, {"direction": "forward", "edge": "e2", "predicate": "q"}]}
    assert lifted["end_witness"] == "D" and lifted["end_subclass_edge"] == "s1" and "start_witness" not in lifted
    assert {r[0] for r in paths.resources(p, 2, "A", "C").collect()} == {"A", 'B"', "C", "e1", "e2", "e3", "p", "q"}
    assert [r[0] for r in paths.resource_list(p, 2, "A", "C").collect()] == ["A", 'B"', "C", "e1", "e2", "e3"]
    assert [r[0] for r in paths.resource_list(p.where("false"), 2, "A", "C").collect()] == ["A", "C"]


def test_pages(spark):
    e = edges(spark, *((f"e{i:03d}", "A", "p", "B") for i in range(57)))
    p = paths.find_paths(graph.oriented(e), "A", "B", 1)
    got = paths.paged(p, 10).orderBy("nth").collect()
    assert [(r["edge1"], r["nth"], r["page"]) for r in got] == [(f"e{i:03d}", i, i // 10) for i in range(57)]
    assert paths.paged(p.where("false"), 10).count() == 0
    with pytest.raises(ValueError):
        paths.paged(p, 0)


def test_triples_of_resources_and_as_a_set(spark):
    e = edges(spark, ("urn:1", "A:1", "biolink:p", "B:1"), ("urn:2", "A:1", "biolink:p", "B:1"), ("urn:3", "urn:1", "biolink:p", "B:2"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(triples.reified_set(e)) == rows(triples.reify(e).distinct())
    r = spark.createDataFrame([("urn:1",), ("https://identifiers.org/A:1",), ("urn:none",)], "resource string")
    assert rows(properties.properties(triples.of_resources(e, r), r)) == rows(properties.properties(triples.reify(e), r))


def test_reverse_alias_is_no_statement(spark):
    e = edges(spark, ("CALL:e", "SHIP:1", "biolink:calls_at", "PORT:1"))
    t = {tuple(r) for r in triples.reverse_aliases(e).collect()}
    assert not [x for x in t if x[1].endswith("#subject") or x[2].endswith("#Statement")]
    assert any(x[1].endswith("traversal_from") and x[2] == "https://identifiers.org/PORT:1" for x in t)


def test_properties_hide_reification(spark):
    t = triples.reify(edges(spark, ("urn:e", "A:1", "biolink:p", "B:1")))
    r = spark.createDataFrame([("urn:e",), ("https://identifiers.org/A:1",)], "resource string")
    got = properties.properties(t, r).collect()
    assert len(got) == 5 and not [x for x in got if x["predicate"].endswith(("#subject", "#predicate", "#object"))]


def test_most_specific(spark):
    frame = spark.createDataFrame
    anc = frame([("k:Ferry", "k:Ship"), ("k:Ferry", "k:Thing"), ("k:Ship", "k:Thing"), ("k:Thing", "k:Thing")], "term string, ancestor string")
    cats = frame([("x", f"k:{c}") for c in ("Thing", "Ship", "Ferry", "Odd")] + [("y", "k:Ship"), ("z", "k:Thing")], "subject string, category string")
    assert sorted(map(tuple, ontology.most_specific(cats, anc).collect())) == [("x", "k:Ferry"), ("x", "k:Odd"), ("y", "k:Ship"), ("z", "k:Thing")]


def test_hierarchies(spark):
    """Cycles end, several parents of an enumeration value all count, unknown terms keep their type alone."""
    frame = spark.createDataFrame
    el = frame([("biolink:Ferry", "ferry")], "term string, name string")
    par = frame([("biolink:Ferry", "biolink:Ship"), ("biolink:Ship", "biolink:Ferry")], "term string, parent string")
    v, t = "https://w3id.org/biolink/vocab/", "http://www.w3.org/2000/01/rdf-schema#"
    got = {tuple(r) for r in ontology.hierarchy(frame([("biolink:Ferry",)], "term string"), el, par, "class").collect()}
    kind = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", t + "Class")
    assert got == {(v + "Ferry", *kind), (v + "Ship", *kind), (v + "Ferry", t + "label", '"ferry"'), (v + "Ferry", t + "subClassOf", v + "Ship"), (v + "Ship", t + "subClassOf", v + "Ferry")}
    ep = frame([("TideEnum", "spring", "high"), ("TideEnum", "spring", "rare"), ("TideEnum", "rare", "any")], "enum string, value string, parent string")
    got = {tuple(r) for r in ontology.enum_hierarchy(ep.where("value = 'spring'").select("enum", "value"), ep).collect()}
    assert sum(r[1].endswith("label") for r in got) == 4 and sum(r[1].endswith("is_a") for r in got) == 3


def test_deep_closure(spark):
    """Plans stay small however deep the chain: thirty levels."""
    up = spark.range(1, 31).selectExpr("cast(id as string) AS term", "cast(id - 1 AS string) AS parent")
    got = ontology.closure(spark.createDataFrame([("30",)], "term string"), up, ["term"])
    assert {r[0] for r in got.collect()} == {str(i) for i in range(31)}
    assert len(got._jdf.queryExecution().toString()) < 100_000


def test_lines_escape_each_term_of_an_edge_once(spark):
    e = edges(spark, ("urn:<1>", "A:1", "biolink:p>", "http://x/\\\\<y>"), ("urn:2", None, "biolink:p", "B:2"), (None, "A:1", None, "B:ü"))
    got = triples.reified_lines(e)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, triples.lines(triples.reify(e)).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("%3E") <= 4
