"""Command line: paths between two endpoints, conversion of an archive, and a timing grid.

``convert`` writes a graph folder (IRIs throughout) that the other two commands read.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SIZE = 100_000  # fixed value: rows a page


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("paths", help="exact-length walks between two endpoints, as one JSON object in ordered parts")
    p.add_argument("start", help="CURIE or IRI")
    p.add_argument("end", help="CURIE or IRI")
    p.add_argument("path_length", type=int)
    p.add_argument("--graph", required=True, help="folder that convert wrote")
    p.add_argument("--output", help="folder of the pages and the answer; without it the answer is printed as it comes")
    p.add_argument("--include-properties", action="store_true", help="outgoing properties of the nodes and edges on the paths")
    p.add_argument("--limit", type=int)
    p.add_argument("--page-size", type=int, default=PAGE_SIZE)
    p.add_argument("--include-subclasses", action="store_true", help="let both endpoints match through one subclass edge")
    b = sub.add_parser("bench", help="times full retrieval for several lengths and page sizes")
    b.add_argument("start")
    b.add_argument("end")
    b.add_argument("--graph", required=True)
    b.add_argument("--output", required=True, help="folder for the results and one JSON record")
    b.add_argument("--path-lengths", type=int, nargs="+", default=[2, 3])
    b.add_argument("--page-sizes", type=int, nargs="+", default=[PAGE_SIZE])
    c = sub.add_parser("convert", help="archive to edges, adjacency, triples and N-Triples lines")
    c.add_argument("archive")
    c.add_argument("output")
    c.add_argument("--reverse-aliases", action="store_true")
    c.add_argument("--codec", choices=("none", "gzip", "zstd"), default="gzip", help="of the N-Triples lines")
    c.add_argument("--zstd-level", type=int, default=3)
    c.add_argument("--ontology", help="folder of the five ontology tables as Parquet")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    if a.command == "convert":
        convert(spark, a.archive, a.output, a.reverse_aliases, a.ontology, a.codec, a.zstd_level)
    elif a.command == "paths" and a.output is None:
        printed(spark, sys.stdout, a.graph, a.start, a.end, a.path_length, a.limit, a.include_subclasses, a.include_properties)
    elif a.command == "paths":
        print(json.dumps(retrieve(spark, a.graph, a.start, a.end, a.path_length, a.output, a.limit, a.page_size, a.include_subclasses, a.include_properties), sort_keys=True))
    else:
        print(json.dumps(bench(spark, a.graph, a.start, a.end, a.path_lengths, a.page_sizes, a.output), indent=2, sort_keys=True))


def retrieve(
    spark: SparkSession, folder: str, start: str, end: str, k: int, output: str, limit: int | None = None, page_size: int = PAGE_SIZE, subclasses: bool = False, properties: bool = False
) -> dict:
    """Write all paths under ``output``: pages as JSON Lines (``pages/page=N``) and the whole answer as one JSON object
    (``answer``, parts in the order of their names). Returns the counts."""
    from strandline.functions.terms import VOCAB, curie_to_iri
    from strandline.operators import paths
    from strandline.operators import properties as props
    from strandline.sources import records
    from strandline.sources.adjacency import open_adjacency
    from strandline.sources.shared import stored

    start, end = spark.range(1).select(curie_to_iri(F.lit(start)), curie_to_iri(F.lit(end))).first()
    t = time.perf_counter()
    adjacency = open_adjacency(spark, f"{folder}/adjacency")
    search = paths.find_paths if k < 3 else paths.reduced_paths
    found = paths.paged(search(adjacency, start, end, k, limit, None, None, subclasses, subclasses, VOCAB + "subclass_of"), page_size)
    document = paths.document(k, subclasses)
    found.select("page", "nth", document.alias("value")).repartitionByRange("nth").sortWithinPartitions("nth").select("page", "value").write.partitionBy("page").option("compression", "gzip").text(f"{output}/pages")
    count = found.count()
    millis = round(1000 * (time.perf_counter() - t))
    listed = None
    if properties:
        wanted = paths.resource_list(found, k, start, end)
        listed = stored(props.grouped(props.properties(spark.read.parquet(f"{folder}/triple_table"), wanted)), "properties")
    records.envelope(found, document, count, start, end, k, millis, listed).write.text(f"{output}/answer")
    return {"path_length": k, "page_size": page_size, "path_count": count, "query_time_ms": millis, "skipped_malformed_rows": 0, "pages": -(-count // page_size)}


def printed(spark: SparkSession, out: TextIO, folder: str, start: str, end: str, k: int, limit: int | None = None, subclasses: bool = False, properties: bool = False) -> int:
    """Write the answer to ``out`` as one JSON object while it is read; the driver holds two ranges of the sorted paths at most.
    Returns the number of paths."""
    import uuid

    from strandline.functions.terms import VOCAB, curie_to_iri
    from strandline.operators import paths
    from strandline.operators import properties as props
    from strandline.sources.adjacency import open_adjacency
    from strandline.sources.pages import store_pages
    from strandline.sources.package import ship
    from strandline.sources.shared import shared_dir
    from strandline.sources.stream import write_document

    ship(spark)
    start, end = spark.range(1).select(curie_to_iri(F.lit(start)), curie_to_iri(F.lit(end))).first()
    t = time.perf_counter()
    adjacency = open_adjacency(spark, f"{folder}/adjacency")
    lift = {"lift_start": subclasses, "lift_end": subclasses, "subclass": VOCAB + "subclass_of"}
    expected = int(paths.count_paths(adjacency, start, end, k, **lift).first()["path_count"])
    found = (paths.find_paths if k < 3 else paths.reduced_paths)(adjacency, start, end, k, limit, **lift)
    held = store_pages(found, f"{shared_dir(spark)}/answer-{uuid.uuid4().hex}", expected=expected if limit is None else min(expected, limit))
    rows = held.rows.orderBy("__range", "__at")
    listed = None
    if properties:
        wanted = paths.resource_list(held.rows.select(*held.columns), k, start, end)
        listed = props.grouped(props.properties(spark.read.parquet(f"{folder}/triple_table"), wanted)).orderBy("resource")
    about = {"end": end, "path_length": k, "query_time_ms": round(1000 * (time.perf_counter() - t)), "skipped_malformed_rows": 0, "start": start}
    return write_document(out, rows, paths.document(k, subclasses), about, listed)


def bench(spark: SparkSession, folder: str, start: str, end: str, lengths: list[int], page_sizes: list[int], output: str) -> dict:
    """The grid of lengths and page sizes; one JSON record of it is written to ``output/record``."""
    grid = []
    for k in lengths:
        for size in page_sizes:
            t = time.perf_counter()
            one = retrieve(spark, folder, start, end, k, f"{output}/{k}hop_{size}", None, size)
            wrote = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{output}/{k}hop_{size}/answer").agg(F.sum("length")).first()[0]
            grid.append({**one, "wall_time_s": round(time.perf_counter() - t, 3), "result_size_bytes": wrote})
    record = {"start_curie": start, "end_curie": end, "path_lengths": lengths, "page_sizes": page_sizes, "timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "benchmarks": grid}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{output}/record")
    return record


def convert(spark: SparkSession, archive: str, output: str, reverse: bool = False, ontology: str | None = None, codec: str = "gzip", level: int = 3) -> None:
    """Unpack once, then write edges, adjacency and all triples in parallel."""
    from strandline.functions.terms import curie_to_iri
    from strandline.operators import convert as whole
    from strandline.operators import graph, triples
    from strandline.sources import archive as source
    from strandline.sources import records
    from strandline.sources.adjacency import write_adjacency

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{output}/{name}")
        return spark.read.schema(df.schema).parquet(f"{output}/{name}")

    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last value stands
    source.register(spark)
    rows = store(spark.read.format("record_archive").option("path", archive).load(), "records")
    lines = {m: rows.where(F.col("member") == m).select("value") for m in source.MEMBERS}
    nodes, edges = records.node_rows(lines["nodes.jsonl"]), records.edge_rows(lines["edges.jsonl"])
    plain = store(edges.select(*(curie_to_iri(c).alias(c) for c in ("edge", "s", "p", "o"))), "edges")
    write_adjacency(graph.oriented(plain), f"{output}/adjacency")
    found = store(whole.all_triples(nodes, edges, whole.read_ontology(spark, ontology), reverse, store), "triple_table")
    records.write_lines(triples.lines(found), f"{output}/triples", codec, level)


if __name__ == "__main__":
    main()
