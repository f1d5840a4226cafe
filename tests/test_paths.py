"""Counting, reduction and the stored adjacency against listing walks one by one."""

import random
import re

import pytest

from strandline.operators import graph, paths
from strandline.sources.adjacency import open_adjacency, write_adjacency

SUB = "biolink:subclass_of"


def table(spark, rows):
    return spark.createDataFrame(rows, "edge string, s string, p string, o string")


def some_graph(seed, nodes=7, n=16):
    r = random.Random(seed)
    rows = [(f"e{r.randrange(n)}", f"N{r.randrange(nodes)}", r.choice(["p", "q", SUB]), f"N{r.randrange(nodes)}") for _ in range(n)]
    return rows + rows[:2]  # ids repeat with other ends, and whole rows repeat


def plain_walks(rows, start, end, k, lift=(False, False)):
    """Sets of rows by going from node to node."""
    step = {(f, d, e, p, t) for e, s, p, o in rows for f, d, t in ((s, "forward", o), (o, "reverse", s))}
    below = lambda x: {(s, s, e) for e, s, p, o in rows if p == SUB and o == x}
    at = [{(x, None, None)} | (below(x) if up else set()) for x, up in zip((start, end), lift)]
    found = {(c, ()) for c in at[0]}
    for i in range(k):
        found = {(c, (*w, x)) for c, w in found for x in step if x[0] == (w[-1][4] if w else c[0])}
    out = set()
    for c, w in found:
        for z in at[1]:
            if w[-1][4] == z[0]:
                flat = [v for i, x in enumerate(w) for v in (x[1:4] if i == k - 1 else x[1:5])]
                out.add((*flat, *((c[1], c[2], z[1], z[2]) if any(lift) else ())))
    return out


@pytest.mark.parametrize("lift", [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_counting_and_reduction_equal_listing(spark, k, lift):
    rows = some_graph(k)
    own = graph.oriented(table(spark, rows))
    up = {"lift_start": lift[0], "lift_end": lift[1]}
    for start, end in (("N0", "N1"), ("N2", "N2"), ("N0", "none")):
        want = plain_walks(rows, start, end, k, lift)
        assert int(paths.count_paths(own, start, end, k, **up).first()["path_count"]) == len(want)
        if (start, end) == ("N0", "N1"):
            assert {tuple(r) for r in paths.reduced_paths(own, start, end, k, **up).collect()} == want
            assert {tuple(r) for r in paths.find_paths(own, start, end, k, **up).collect()} == want


def test_counts_beyond_a_long(spark):
    many = table(spark, [(f"e{i}", "A", "p", "B") for i in range(300)])
    got = paths.count_paths(graph.oriented(many), "A", "A", 14).first()
    assert got["path_count"] == 300**14 and got["path_length"] == 14
    with pytest.raises(ValueError):
        paths.count_paths(graph.oriented(many), "A", "B", 0)


def test_reduction_leaves_edges_on_walks_only(spark):
    rows = some_graph(3, nodes=30, n=60) + [(f"x{i}", "N0", "p", f"dead{i}") for i in range(200)] + [(f"y{i}", "N1", "p", f"end{i}") for i in range(200)]
    own = graph.oriented(table(spark, rows))
    walks = paths.find_paths(own, "N0", "N1", 4).collect()
    hops = paths.reduced_hops(own, paths.levels(own, "N0", "N1", 4))
    used = {i: {(w[f"dir{i}"], w[f"edge{i}"], w[f"pred{i}"]) for w in walks} for i in range(1, 5)}
    assert walks and sum(h.distinct().count() for h in hops.values()) <= 4 * len(walks)
    turn = {"forward": "reverse", "reverse": "forward"}
    for i, h in hops.items():
        kept = {(r["dir"] if i <= 2 else turn[r["dir"]], r["edge"], r["pred"]) for r in h.collect()}
        assert kept == used[i]


@pytest.fixture
def merged(spark):
    """Joins that cannot broadcast, as over tables of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("hub", [10**6, 20])
def test_hops_do_not_shuffle_the_adjacency(merged, tmp_path, hub):
    spark, path = merged, f"{tmp_path}/adj-{hub}"
    rows = some_graph(1) + [(f"h{i}", "HUB", "p", f"N{i % 7}") for i in range(150)]
    write_adjacency(graph.oriented(table(spark, rows)), path, hub=hub)
    own = open_adjacency(spark, path)
    plan = paths.find_paths(own, "N0", "N1", 4)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    scans = [i for i, x in enumerate(plan) if "Scan parquet" in x or "FileScan" in x]
    free = 0
    for i in scans:
        depth = re.search(r"[A-Za-z]", plan[i]).start()
        above = next(x for x in reversed(plan[:i]) if re.search(r"[A-Za-z]", x).start() < depth and not re.search(r"Project|Filter|ColumnarToRow|WholeStage|InputAdapter", x))
        free += "Exchange" not in above
    adjacency_scans = [i for i in scans if "strandline_adjacency" in plan[i]]
    assert len(adjacency_scans) == 4 and free >= 2  # both inner hops; the outer ones are walks from an endpoint
    assert sum("Bucketed: true" in plan[i] for i in adjacency_scans) == 2
    got = {tuple(r) for r in paths.find_paths(own, "N0", "N1", 4).collect()}
    assert got == plain_walks(rows, "N0", "N1", 4)


def test_hubs_lie_in_many_files_and_open_elsewhere(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"{tmp_path}/adj"
    rows = [(f"h{i}", "HUB", "p", f"N{i}") for i in range(500)] + [("h1", "HUB", "p", "N1")]
    write_adjacency(graph.oriented(table(spark, rows)), path, hub=50)
    assert spark.read.parquet(f"{path}/rows").where("f = 'HUB'").select(F.input_file_name()).distinct().count() >= 4
    other = spark.newSession()
    for name in spark.catalog.listTables():
        if name.name.startswith("strandline_adjacency"):
            spark.sql(f"DROP TABLE {name.name}")
    own = open_adjacency(other, path)
    assert own.rows.count() == 1000 and own.hubs.collect()[0][:2] == ("HUB", 11)
    assert int(paths.count_paths(own, "N1", "N2", 2).first()["path_count"]) == 1
    assert paths.find_paths(own, "N1", "N2", 4).count() == int(paths.count_paths(own, "N1", "N2", 4).first()["path_count"]) == 500


def test_many_candidates_are_joined_not_listed(spark, monkeypatch):
    rows = [(f"s{i}", f"M{i}", SUB, "E") for i in range(5)] + [(f"e{i}", "X", "p", f"M{i}") for i in range(5)]
    own = graph.oriented(table(spark, rows))
    want = plain_walks(rows, "X", "E", 1, (False, True))
    for most in (1000, 2):
        monkeypatch.setattr(paths, "LISTED", most)
        assert {tuple(r) for r in paths.find_paths(own, "X", "E", 1, lift_end=True).collect()} == want
        assert int(paths.count_paths(own, "X", "E", 1, lift_end=True).first()["path_count"]) == len(want) == 5


def test_counts_over_many_tasks_do_not_shuffle_the_adjacency(merged, tmp_path):
    spark, path = merged, f"{tmp_path}/adj"
    rows = some_graph(3, 9, 60)
    write_adjacency(graph.oriented(table(spark, rows)), path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")  # more than buckets
    try:
        counted = paths.count_paths(open_adjacency(spark, path), "N0", "N1", 4)
        plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert int(counted.first()["path_count"]) == len(plain_walks(rows, "N0", "N1", 4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("Bucketed: true") >= 2


def test_many_candidates_do_not_have_the_adjacency_shuffled(merged, tmp_path, monkeypatch):
    spark, path = merged, f"{tmp_path}/adj"
    rows = [(f"s{i}", f"M{i}", SUB, "E") for i in range(5)] + [(f"e{i}", "X", "p", f"M{i}") for i in range(5)]
    write_adjacency(graph.oriented(table(spark, rows)), path)
    monkeypatch.setattr(paths, "LISTED", 2)
    counted = paths.count_paths(open_adjacency(spark, path), "E", "X", 2, lift_start=True)
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert int(counted.first()["path_count"]) == len(plain_walks(rows, "E", "X", 2, (True, False)))
    assert "LeftSemi" not in plan


def test_rows_said_to_be_distinct_are_written_as_they_are(spark, tmp_path):
    rows = sorted(set(some_graph(5, 6, 40)))
    found = []
    for hub, distinct in ((10**6, False), (10**6, True), (5, True)):
        path = f"{tmp_path}/adj-{hub}-{distinct}"
        write_adjacency(graph.oriented(table(spark, rows)), path, hub=hub, distinct=distinct)
        found.append(sorted(tuple(r) for r in open_adjacency(spark, path).rows.select(*graph.EDGE).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * len(rows)


def test_graph_edges_are_unique_where_table_rows_repeat(spark, tmp_path):
    from strandline.plans import projection

    small = "/root/testdata/sf0.001"
    for name in ("nation", "customer", "supplier", "orders", "part", "lineitem"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        df.union(df.limit(5)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(projection.edges(spark, str(tmp_path), unique=True).collect()) == sorted(projection.edges(spark, small).distinct().collect())


def compared(df):
    """The columns that a plan's aggregates look at."""
    return [x.split("Aggregate [")[1].split("]")[0] for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]


@pytest.fixture
def repeated(spark, tmp_path):
    """The smallest tables, where five rows of each come twice."""
    for name in ("nation", "customer", "supplier", "orders", "part", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.union(df.limit(5)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_set_of_triples_compares_numbers_alone_in_tasks_of_one_size(spark, repeated, monkeypatch):
    from strandline.operators import triples
    from strandline.plans import catalog, projection

    monkeypatch.setattr(projection, "TASK_ROWS", 200)
    got = catalog.QUERIES["triples_distinct"](spark, repeated)
    keys = compared(got)
    assert len(keys) == len(projection.EDGES) and not [k for k in keys if k.startswith("s#") or " o#" in k]
    assert sorted(got.collect()) == sorted(triples.reify(projection.edges(spark, "/root/testdata/sf0.001")).distinct().collect())
    assert projection.edges(spark, repeated).rdd.getNumPartitions() >= 2 * 6000 // 200


def test_nodes_are_compared_by_number_without_making_edges(spark, repeated):
    from pyspark.sql import functions as F

    from strandline.plans import catalog, projection

    own = spark.read.parquet(f"{repeated}/customer.parquet")
    own.limit(3).withColumn("c_custkey", F.lit(None).cast("long")).withColumn("c_nationkey", F.lit(None).cast("int")).write.mode("append").parquet(f"{repeated}/customer.parquet")
    got = catalog.QUERIES["kg_nodes"](spark, repeated)
    assert [k.split("#")[0] for k in compared(got)] == ["prefix"]
    found = [r[0] for r in got.collect()]
    assert found.count(None) == 1 and sorted(x or "" for x in found) == sorted(r[0] or "" for r in graph.nodes(projection.edges(spark, repeated)).collect())


def test_terms_of_subjects_are_compared_by_number(spark, repeated):
    from strandline.plans import catalog, projection

    got = catalog.QUERIES["iri_normalize"](spark, repeated)
    assert [k.split("#")[0] for k in compared(got)] == ["prefix"]
    assert sorted(map(tuple, got.collect())) == sorted((r[0], f"<{r[0]}>") for r in projection.edges(spark, repeated).select("s").distinct().collect())


def test_ids_of_the_graph_are_compared_by_number_beside_addresses(spark, repeated):
    from strandline.plans import catalog, projection

    urls = ["ORDER:1", "ORDER:1", "urn:e:ord:1", "biolink:places", "urn:e:ord:none", "X:a", "http://x", None]
    spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{repeated}/documents.parquet")
    e = projection.edges(spark, repeated)
    kept = [u for u in urls if u is None or not u.startswith(tuple(projection.graph_ids(spark, repeated)[1]))]
    for some in (urls, kept):
        spark.createDataFrame([(u,) for u in some], "url string").write.mode("overwrite").parquet(f"{repeated}/pages.parquet")
        own = catalog._ids(spark, repeated)
        want = {r[0] for c in ("edge", "s", "p") for r in e.select(c).collect()} | {u for u in some if u} | {"X:a", "X:b"}
        found = [r[0] for r in own.collect()]
        assert sorted(found) == sorted(want)
    assert sum(k.startswith("v#") for k in compared(own)) == 2  # addresses with texts, and predicates


def test_adjacency_of_the_graph_is_dealt_as_numbers_once(spark, repeated, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameWriter

    from strandline.plans import projection

    for name, c in (("customer", "c_custkey"), ("supplier", "s_nationkey"), ("part", "p_type"), ("lineitem", "l_partkey"), ("lineitem", "l_orderkey")):
        df = spark.read.parquet(f"{repeated}/{name}.parquet")
        df.limit(3).withColumn(c, F.lit(None).cast(df.schema[c].dataType)).write.mode("append").parquet(f"{repeated}/{name}.parquet")
    plans, save = [], DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, name: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or save(self, name))
    own = projection.adjacency(spark, repeated)
    dealt = [x for x in plans[0].splitlines() if "Exchange" in x]
    assert len(dealt) == 1 and "edge#" not in plans[0].split(dealt[0])[1]
    rows = lambda df: sorted(map(repr, df.select(*graph.EDGE).collect()))
    assert rows(own.rows) == rows(graph.oriented(projection.edges(spark, repeated, unique=True)))


@pytest.mark.parametrize("hub, often", [(60, 60), (20, 60), (20, 10**6)])
@pytest.mark.parametrize("exact", [False, True])
def test_hubs_are_found_at_any_size(spark, tmp_path, monkeypatch, hub, often, exact):
    """Nodes with so many rows that one task should not count them, and nodes that one task counts."""
    from strandline.sources import adjacency

    monkeypatch.setattr(adjacency, "HUB", often)
    rows = some_graph(4, 12, 90) + [(f"h{i}", "HUB", "p", f"N{i % 7}") for i in range(150)]
    own = graph.oriented(table(spark, rows + rows[-40:]))
    write_adjacency(own, f"{tmp_path}/adj", hub=hub, exact=exact)
    count = own.distinct() if exact else own
    want = {(r["f"], -(-r["count"] // hub), r["count"]) for r in count.groupBy("f").count().collect() if r["count"] > hub}
    found = open_adjacency(spark, f"{tmp_path}/adj")
    assert want and {tuple(r) for r in found.hubs.collect()} == want
    assert sorted(found.rows.select(*graph.EDGE).collect()) == sorted(own.distinct().collect())
    used = {r["f"]: r["count"] for r in found.rows.select("f", "slot").distinct().groupBy("f").count().collect()}
    assert all((used[f] > 1) == (f in {x[0] for x in want}) for f in used)
