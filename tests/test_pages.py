"""Pages by number and by token, and answers that are printed while they are read."""

import base64
import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.operators import graph, paths
from strandline.sources import pages, stream
from strandline.sources.package import ship


@pytest.fixture(scope="module")
def rows(spark):
    """Values that only a right key keeps in order: nulls, empty and nested prefixes, characters around the key's own."""
    values = [None, "", "a", "a\x00", "a\x01", "a\x02", "aa", "ab", "b", "é", "漢", "\U0001f600"]
    return [(x, y) for x in values for y in values]


def ordered(rows):
    enc = lambda v: (v is not None, (v or "").encode())
    return sorted(rows, key=lambda r: tuple(map(enc, r)))


@pytest.fixture(scope="module")
def held(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('pages')}/p"
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    return pages.store_pages(df, path, range_rows=20, expected=len(rows)), path


def test_pages_by_token_are_the_whole_in_order(held, rows):
    own, _ = held
    for size in (1000, 144, 50, 7):
        got, tokens = [], []
        for page, token in own.follow(size):
            got += [tuple(r) for r in page.collect()]
            tokens.append(token)
            if size == 7 and len(tokens) == 4:
                break
        assert got == ordered(rows)[: len(got)] and (size == 7 or (len(got) == len(rows) and tokens[-1] is None))


def test_all_pages_in_one_job_are_those_by_token(held):
    own, _ = held
    for size in (1000, 144, 50, 37):
        want = [(*r, i) for i, (page, _) in enumerate(own.follow(size)) for r in page.collect()]
        got = own.pages(size).orderBy("nth").collect()
        assert [(*r[:2], r["page"]) for r in got] == want and [r["nth"] for r in got] == list(range(own.count()))
    with pytest.raises(ValueError):
        own.pages(0)


def test_any_page_by_number(held, rows):
    own, _ = held
    assert own.count() == len(rows)
    for number, size in ((0, 10), (5, 13), (14, 10), (2, 144), (0, 1)):
        want = ordered(rows)[number * size : (number + 1) * size]
        got = own.page(number, size).collect()
        assert [tuple(r)[:2] for r in got] == want and [r["nth"] for r in got] == list(range(number * size, number * size + len(want)))
    with pytest.raises(ValueError):
        own.page(0, 0)


def test_a_page_reads_its_own_ranges_only(spark, held):
    own, _ = held
    first, token = own.after(None, 30)
    later, _ = own.after(token, 30)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = later._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100")
    assert "GreaterThan(__key" in plan and "LessThanOrEqual(__key" in plan
    # rows of a page of 30 in ranges of about 20: three ranges, or four
    ranges = own.rows.where(F.col("__key") > json.loads(base64.urlsafe_b64decode(token))["after"])
    assert ranges.select("__range").distinct().count() >= 5
    read = plan[plan.index("PushedFilters") :]
    low, high = (int(read.split(f"{k}(__range,")[1].split(")")[0]) for k in ("GreaterThanOrEqual", "LessThanOrEqual"))
    assert high - low <= 3


def test_resume_after_a_kill(spark, rows, tmp_path):
    """What was finished is kept; a token goes on in another session."""
    path, df = f"{tmp_path}/p", spark.createDataFrame(rows, "a string, b string")
    own = pages.store_pages(df, path, range_rows=40, expected=len(rows))
    _, token = own.after(None, 100)
    # killed before the bounds: the sorted rows stand
    (tmp_path / "p" / "bounds" / "_SUCCESS").unlink()
    wrong = spark.createDataFrame([("never", "read")], "a string, b string")
    again = pages.store_pages(wrong, path)
    assert again.count() == len(rows)
    other = pages.open_pages(spark.newSession(), path)
    assert [tuple(r) for r in other.after(token, 100)[0].collect()] == ordered(rows)[100:]
    # killed before the rows: they are written anew
    (tmp_path / "p" / "rows" / "_SUCCESS").unlink()
    (tmp_path / "p" / "bounds" / "_SUCCESS").unlink()
    assert pages.store_pages(df.limit(3), path).count() == 3


def test_empty_and_repeated_rows(spark, tmp_path):
    none = pages.store_pages(spark.createDataFrame([], "a string"), f"{tmp_path}/none")
    assert none.count() == 0 and none.page(0, 5).count() == 0 and [p.count() for p, _ in none.follow(5)] == [0]


def test_a_result_beyond_what_the_driver_may_hold_is_printed(spark, tmp_path):
    """Sixty megabytes by way of a driver that may fetch one at a time."""
    ship(spark)
    n, wide = 30_000, "x" * 2000
    df = spark.range(n).select(F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(wide)).alias("a"))
    own = pages.store_pages(df, f"{tmp_path}/big", range_rows=400, expected=n)

    class Counted(io.TextIOBase):
        size, head, tail = 0, "", ""

        def write(self, text):
            self.size += len(text)
            self.head, self.tail = (self.head + text)[:300] if len(self.head) < 300 else self.head, (self.tail + text)[-300:]
            return len(text)

    out = Counted()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "75")
    tracemalloc.start()
    count = stream.write_document(out, own.rows.orderBy("__range", "__at"), F.concat(F.lit('{"a":"'), "a", F.lit('"}')), {"end": "e", "start": "s"})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert count == n and out.size > 60_000_000 and peak < 20_000_000
    assert out.head.startswith('{\n"end": "e",\n"paths": [\n{"a":"00000000xxx') and out.tail.endswith('x"}],\n"path_count": 30000,\n"start": "s"\n}\n')


def test_printed_answer_is_one_json_object(spark, tmp_path, capsys):
    from strandline.sources.adjacency import write_adjacency

    e = spark.createDataFrame([(f"urn:e{i}", "urn:a", "urn:p", f"urn:m{i % 3}") for i in range(6)] + [(f"urn:f{i}", f"urn:m{i}", "urn:p", "urn:z") for i in range(3)], "edge string, s string, p string, o string")
    write_adjacency(graph.oriented(e), f"{tmp_path}/adjacency")
    spark.createDataFrame([("urn:a", "urn:q", '"v"'), ("urn:z", "urn:q", "urn:w")], "s string, p string, o string").write.parquet(f"{tmp_path}/triple_table")
    cli.main(["paths", "urn:a", "urn:z", "2", "--graph", f"{tmp_path}", "--include-properties"])
    doc = json.loads(capsys.readouterr().out)
    assert doc["path_count"] == len(doc["paths"]) == 6 and list(doc["properties"]) == ["urn:a", "urn:z"]
    want = [json.loads(r[0]) for r in paths.documents(paths.in_order(paths.find_paths(graph.oriented(e), "urn:a", "urn:z", 2)), 2).collect()]
    assert doc["paths"] == want
    cli.main(["paths", "urn:a", "urn:none", "3", "--graph", f"{tmp_path}"])
    doc = json.loads(capsys.readouterr().out)
    assert doc["paths"] == [] and doc["path_count"] == 0 and "properties" not in doc
