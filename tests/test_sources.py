import json

import pytest
from pyspark.sql import functions as F

from strandline.sources import archive, records, shared
from strandline.streaming.ingest import append_adjacency, stream_edges

HARBOUR = {"id": "PORT:4", "category": ["biolink:Place", "biolink:Harbour"], "depth": 11.5}
CALL = {"id": "urn:call:88", "subject": "SHIP:2", "predicate": "biolink:calls_at", "object": "PORT:4"}


def test_records(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text(json.dumps(HARBOUR) + "\n \t \n" + json.dumps({"id": "PORT:5", "category": "no list"}) + "\r\n")
    got = {r["id"]: r["categories"] for r in records.read_nodes(spark, str(tmp_path / "n.jsonl")).collect()}
    assert got == {"PORT:4": HARBOUR["category"], "PORT:5": []}
    (tmp_path / "e.jsonl").write_text(json.dumps(CALL) + "\n")
    assert records.read_edges(spark, str(tmp_path / "e.jsonl")).first()["s"] == "SHIP:2"
    for i, bad in enumerate(('{"id": "x"}\n', "{half\n")):
        (tmp_path / f"bad{i}.jsonl").write_text(bad)
        with pytest.raises(Exception):
            records.read_edges(spark, str(tmp_path / f"bad{i}.jsonl")).collect()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_archive(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/harbours.tar.zst"
    archive.write_archive(path, {"nodes.jsonl": [json.dumps(HARBOUR), ""], "edges.jsonl": [json.dumps(CALL)], "notes.txt": ["x"]})
    archive.register(spark)
    got = spark.read.format("record_archive").option("path", path).load().collect()
    assert [(r["member"], json.loads(r["value"])) for r in got] == [("nodes.jsonl", HARBOUR), ("edges.jsonl", CALL)]


def test_bindings(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("?dir1\t?edge1\nforward\t<e>\n")
    assert records.read_bindings(spark, str(tmp_path / "b.tsv")).first().asDict() == {"dir1": "forward", "edge1": "<e>"}
    lines = spark.createDataFrame([("a\tb\r\n",), ("only one",), ("",), ("a\t",), ("x\ty\tz",)], "value string")
    rows = records.bindings(lines, ["?p", "?q"])
    assert [tuple(r) for r in rows.collect()] == [("a", "b", False), (None, None, True), ("a", "", False), (None, None, True)]
    with pytest.raises(Exception):
        records.refuse_malformed(rows).collect()
    assert records.refuse_malformed(rows.where("not malformed")).count() == 2


@pytest.mark.parametrize("codec", ["none", "gzip", "zstd"])
def test_lines(spark, tmp_path, codec):
    import zstandard

    out = tmp_path / "nt"
    records.write_lines(spark.range(50).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("value")).repartition(3), str(out), codec)
    if codec == "zstd":
        parts = sorted(out.glob("*.zst"))
        got = [x.rstrip("\n") for p in parts for x in zstandard.open(p, "rt")]
        assert len(parts) == 3 and not list(out.glob("_draft*"))
    else:
        got = [r[0] for r in spark.read.text(str(out)).collect()]
    assert sorted(got) == sorted(f"é{i}" for i in range(50))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps(CALL) + "\n\n")
    append_adjacency(stream_edges(spark, str(tmp_path / "in")), str(tmp_path / "adj"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["dir"], r["f"]) for r in spark.read.parquet(str(tmp_path / "adj")).collect()} == {("forward", "SHIP:2"), ("reverse", "PORT:4")}
    # a malformed record stops the stream, as it stops a batch
    (tmp_path / "in/b.jsonl").write_text("not json\n")
    with pytest.raises(Exception):
        append_adjacency(stream_edges(spark, str(tmp_path / "in")), str(tmp_path / "adj"), str(tmp_path / "cp")).awaitTermination(120)


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster())


@pytest.mark.parametrize("zipped", [True, False])
def test_archives_are_read_in_ranges(spark, tmp_path, zipped):
    """Whatever the frames and ranges: each line once, members under other names left out."""
    import random

    r = random.Random(4)
    nodes = ["x" * r.choice([0, 1, 3, 700, 5000]) + str(i) for i in range(300)] + ["é漢" * 50, ""]
    parts = {"notes.txt": ["n" * 3000], "nodes.jsonl": nodes, "x/nodes.jsonl": ["never"], "edges.jsonl": [f"e{i}" for i in range(2000)]}
    want = sorted([("nodes.jsonl", x) for x in nodes if x.strip()] + [("edges.jsonl", x) for x in parts["edges.jsonl"]])
    for frame, split in ((100_000, 50_000), (511, 512), (777, 3000), (4096, 1), (None, 1000)):
        path = f"{tmp_path}/{zipped}-{frame}-{split}.tar"
        archive.write_archive(path, parts, frame_bytes=frame, zipped=zipped)
        found = archive.layout(path, split)
        if zipped and frame is None:
            assert found is None  # one frame, one task
            got = list(archive.members(path))
        else:
            own, known, ranges = found
            assert len(ranges) > 1 or frame == 100_000
            got = [x for a, b in ranges for x in archive.lines_between(path, own, known, a, b)]
        assert sorted(got) == want, (frame, split)
    archive.register(spark)
    df = spark.read.format("record_archive").option("path", f"{tmp_path}/{zipped}-777-3000.tar").option("splitBytes", 3000).load()
    assert df.rdd.getNumPartitions() > 10 and sorted(map(tuple, df.collect())) == want


def test_frames_of_every_kind(tmp_path):
    """Sizes known and unknown, checksums, skippable frames, incompressible and repeated blocks."""
    import io as _io
    import os as _os

    import zstandard

    parts = [b"", b"a" * 1_000_000, _os.urandom(300_000), b"xyz" * 70]
    for checksum in (True, False):
        for size in (True, False):
            data, want = b"", []
            for p in parts:
                want.append((len(data), len(p) if size else None))
                data += zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=size).compress(p)
                data += b"\x50\x2a\x4d\x18" + (5).to_bytes(4, "little") + b"noise"
            (tmp_path / "f.zst").write_bytes(data)
            with archive.opened(str(tmp_path / "f.zst")) as raw:
                assert archive.frames(raw) == want
                if size:
                    plain = _io.BufferedReader(archive.Unpacked(raw, [w for w in want]), 1000)
                    whole = b"".join(parts)
                    for at, n in ((0, 10), (999_990, 30), (len(whole) - 5, 9), (1_200_000, 100_500), (3, 2)):
                        plain.seek(at)
                        assert plain.read(n) == whole[at : at + n]


def test_zstd_levels(spark, tmp_path):
    import io as _io

    import zstandard

    lines = spark.range(20_000).select(F.concat(F.lit("urn:"), F.sha2(F.col("id").cast("string"), 256)).alias("value")).coalesce(1)
    size = {}
    for level in (1, 19):
        records.write_lines(lines, f"{tmp_path}/l{level}", "zstd", level)
        (part,) = (tmp_path / f"l{level}").glob("*.zst")
        size[level] = part.stat().st_size
        assert zstandard.ZstdDecompressor().stream_reader(_io.BytesIO(part.read_bytes())).read().count(b"\n") == 20_000
    assert size[19] < size[1]
