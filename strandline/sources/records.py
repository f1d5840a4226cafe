"""Node and edge records as JSON Lines, TSV bindings, and the sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strandline.functions.json_values import try_parsed
from strandline.functions.terms import json_text
from strandline.sources.package import ship


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines; only LF ends a line."""
    return spark.read.option("lineSep", "\n").text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select("value", try_parsed("value").alias("v")).select("value", F.coalesce("v", F.when(F.col("value").isNotNull(), F.raise_error(F.concat(F.lit("not a JSON record: "), F.substring("value", 1, 200))).cast("variant"))).alias("v"))


def category_list(v: str) -> str:
    """SQL for the categories of a record; a category that is not a list is ignored."""
    return f"CASE WHEN schema_of_variant(variant_get({v}, '$.category')) LIKE 'ARRAY%' THEN try_variant_get({v}, '$.category', 'array<string>') ELSE array() END"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return node_rows(read_lines(spark, path))


def node_rows(lines: DataFrame) -> DataFrame:
    """(id, categories, attrs VARIANT, value); a record without ``id`` is an error."""
    key = F.coalesce(F.expr("variant_get(v, '$.id', 'string')"), F.raise_error(F.concat(F.lit("node record without id: "), F.substring("value", 1, 200))).cast("string"))
    return _parsed(lines).select(key.alias("id"), F.expr(category_list("v")).alias("categories"), F.col("v").alias("attrs"), "value")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return edge_rows(read_lines(spark, path))


def edge_rows(lines: DataFrame) -> DataFrame:
    """(edge, s, p, o, categories, attrs VARIANT, value); a record without one of the four keys is an error."""
    rows = _parsed(lines)
    need = [F.expr(f"variant_get(v, '$.{k}', 'string')").alias(c) for k, c in (("id", "edge"), ("subject", "s"), ("predicate", "p"), ("object", "o"))]
    out = rows.select(*need, F.expr(category_list("v")).alias("categories"), F.col("v").alias("attrs"), "value")
    checked = [F.coalesce(c, F.raise_error(F.lit(f"edge record without {c}")).cast("string")).alias(c) for c in ("edge", "s", "p", "o")]
    return out.select(*checked, "categories", "attrs", "value")


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query results with a header of ``?name`` columns; malformed rows fail. Cells are taken as they stand,
    quotes and backslashes too; an empty cell is null."""
    df = spark.read.csv(path, sep="\t", header=True, mode="FAILFAST", quote="", escape="")
    return df.toDF(*[c.lstrip("?") for c in df.columns])


def bindings(lines: DataFrame, header: list[str]) -> DataFrame:
    """Lines of tab-separated values as the columns of ``header`` and ``malformed``: rows with another number of
    values are marked and keep nulls, blank lines are no rows."""
    text = F.regexp_replace("value", r"[\r\n]+\z", "")
    rows = lines.where(text != "").select(F.split(text, "\t", -1).alias("v"))
    bad = F.size("v") != len(header)
    return rows.select(*(F.when(~bad, F.col("v")[i]).alias(c.lstrip("?")) for i, c in enumerate(header)), bad.alias("malformed"))


def refuse_malformed(rows: DataFrame) -> DataFrame:
    """The rows of ``bindings`` without the mark; the first malformed one is an error, so no result is cut short."""
    mark = F.when(F.col("malformed"), F.raise_error(F.lit("malformed row of tab-separated values")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(mark).drop("malformed")


def write_lines(lines: DataFrame, path: str, codec: str = "gzip", level: int = 3) -> None:
    """Text parts, ``codec`` none, gzip or zstd (with names ending in .gz or .zst); ``level`` is that of zstd."""
    if codec != "zstd":
        lines.write.option("compression", codec).text(path)
        return
    # Hadoop's own zstd codec needs a native library that may be missing
    ship(lines.sparkSession)
    lines.sparkSession.dataSource.register(_ZstdLines)
    lines.select("value").write.format(_ZstdLines.name()).mode("append").option("path", path).option("level", level).save()


class _ZstdLines(DataSource):
    """One zstd file of lines a partition, visible only when its task is done."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _ZstdWriter(self.options["path"], int(self.options["level"]))


class _ZstdWriter(DataSourceWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        import zstandard
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        system.create_dir(top, recursive=True)
        context = TaskContext.get()
        name, draft = f"{top}/part-{context.partitionId():05d}.zst", f"{top}/_draft-{context.partitionId():05d}-{context.taskAttemptId()}"
        with system.open_output_stream(draft, compression=None) as raw, zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False) as out:
            for r in rows:
                out.write(r[0].encode() + b"\n")
        system.move(draft, name)
        return WriterCommitMessage()


def envelope(numbered: DataFrame, document: Column, count: int, start: str, end: str, k: int, millis: int, properties: DataFrame | None = None, malformed: int = 0) -> DataFrame:
    """One JSON object over ordered lines (``value``): end, paths, counts, properties by resource if given, start. The parts
    written from it, read in the order of their names, are one document. ``numbered`` has ``nth``."""
    spark = numbered.sparkSession
    comma = lambda last: F.when(last, F.lit("")).otherwise(F.lit(","))
    fixed = [(0, "{"), (1, f'"end": {json.dumps(end)},'), (2, '"paths": ['), (4, "],")]
    fixed += [(5, f'"path_count": {count},'), (6, f'"path_length": {k},'), (7, f'"query_time_ms": {millis},'), (8, f'"skipped_malformed_rows": {malformed},')]
    fixed += [(9, '"properties": {'), (11, "},")] if properties is not None else []
    fixed += [(12, f'"start": {json.dumps(start)}'), (13, "}")]
    lines = spark.createDataFrame([(a, 0, "", t) for a, t in fixed], "section int, nth long, key string, value string")
    each = numbered.select(F.lit(3).alias("section"), "nth", F.lit("").alias("key"), F.concat(document, comma(F.col("nth") == count - 1)).alias("value"))
    lines = lines.unionByName(each)
    if properties is not None:
        pair = lambda x: F.concat(F.lit('{"predicate":'), json_text(x["predicate"]), F.lit(',"value":'), json_text(x["value"]), F.lit("}"))
        own = properties.select("resource", F.concat(json_text("resource"), F.lit(":["), F.array_join(F.transform("properties", pair), ","), F.lit("]")).alias("text"))
        last = F.col("resource") == F.lit(properties.agg(F.max("resource")).first()[0])
        lines = lines.unionByName(own.select(F.lit(10).alias("section"), F.lit(0).cast("long").alias("nth"), F.col("resource").alias("key"), F.concat("text", comma(last)).alias("value")))
    return lines.orderBy("section", "nth", "key").select("value")


def write_paths(documents: DataFrame, path: str) -> None:
    """JSON Lines of ``document``, gzip."""
    documents.select(F.col("document").alias("value")).write.option("compression", "gzip").text(path)
