"""A sorted result that is stored once and read page by page: by number, or on from a token.

Rows get one text key in the order of all their columns (nulls first). They are dealt into ranges by key, sorted, and stored
with their range and place; ``bounds`` holds each range's keys, size and the rows before it. A page, wherever it lies, is a look
into the bounds and a filter on keys that skips files and row groups: no earlier row is read or counted. A token is the last key
of what was read, so whoever holds it goes on in another session. Steps that were finished before a kill are not done again.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a range is meant to hold.
RANGE_ROWS = 100_000
BOUNDS = "range int, low string, high string, n long, base long"


def sort_key(columns: list[str]) -> Column:
    """One string that orders as the string columns do one after the other, nulls first: values end with two characters that
    come before any other, and hold none of these."""
    def one(c: str) -> Column:
        return F.coalesce(F.concat(F.replace(F.col(c), F.lit("\x00"), F.lit("\x00\x02")), F.lit("\x00\x01")), F.lit("\x00\x00"))

    return F.concat(*(one(c) for c in columns))


def _finished(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def store_pages(rows: DataFrame, path: str, range_rows: int = RANGE_ROWS, expected: int | None = None) -> Pages:
    """Sort and store ``rows`` (string columns) under ``path``. ``expected`` is their number where it is known (see
    ``paths.count_paths``) and sets how many ranges there are; else the session's shuffle setting does."""
    spark, columns = rows.sparkSession, rows.columns
    if not _finished(spark, f"{path}/rows"):
        keyed = rows.withColumn("__key", sort_key(columns))
        many = [] if expected is None else [max(1, -(-expected // range_rows))]
        part = F.spark_partition_id()
        placed = keyed.repartitionByRange(*many, "__key").sortWithinPartitions("__key").withColumn("__range", part)
        placed = placed.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33))
        placed.write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/rows")
    if not _finished(spark, f"{path}/bounds"):
        held = spark.read.parquet(f"{path}/rows").groupBy(F.col("__range").alias("range")).agg(F.min("__key").alias("low"), F.max("__key").alias("high"), F.count("*").alias("n"))
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
        held.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return open_pages(spark, path)


def open_pages(spark: SparkSession, path: str) -> Pages:
    rows = spark.read.parquet(f"{path}/rows")
    return Pages(rows, spark.read.schema(BOUNDS).parquet(f"{path}/bounds"), [c for c in rows.columns if not c.startswith("__")])


@dataclass(frozen=True)
class Pages:
    rows: DataFrame
    bounds: DataFrame
    columns: list[str]

    def count(self) -> int:
        return self.bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def pages(self, size: int) -> DataFrame:
        """Every row with ``nth``, its number in the whole, and ``page``, those that ``follow`` gives one after the other: one
        job, whatever the number of pages."""
        if size < 1:
            raise ValueError("a page has at least one row")
        numbered = self.rows.join(self.bounds.select(F.col("range").alias("__range"), "base"), "__range").withColumn("nth", F.col("base") + F.col("__at"))
        return numbered.select(*self.columns, "nth", F.floor(F.col("nth") / size).cast("long").alias("page"))

    def _between(self, first: int, last: int) -> DataFrame:
        """Rows ``first`` to ``last`` (not included), with their number ``nth``."""
        near = self.bounds.where((F.col("base") < last) & (F.col("base") + F.col("n") > first)).orderBy("range")
        ends = near.agg(F.min("low"), F.max("high"), F.min("range"), F.max("range")).first()
        if ends[0] is None:
            return self.rows.where("false").select(*self.columns, F.lit(0).cast("long").alias("nth"))
        own = self.rows.where((F.col("__key") >= ends[0]) & (F.col("__key") <= ends[1]) & F.col("__range").between(ends[2], ends[3]))
        numbered = own.join(near.select(F.col("range").alias("__range"), "base"), "__range").withColumn("nth", F.col("base") + F.col("__at"))
        return numbered.where((F.col("nth") >= first) & (F.col("nth") < last)).orderBy("nth").select(*self.columns, "nth")

    def page(self, number: int, size: int) -> DataFrame:
        """One page (from 0) in order, with each row's number in the whole."""
        if size < 1 or number < 0:
            raise ValueError("pages are numbered from 0 and have at least one row")
        return self._between(number * size, (number + 1) * size)

    def after(self, token: str | None, size: int) -> tuple[DataFrame, str | None]:
        """(the next ``size`` rows behind ``token``, token to go on with); None begins, and None ends."""
        if size < 1:
            raise ValueError("a page has at least one row")
        key = None if token is None else json.loads(base64.urlsafe_b64decode(token))["after"]
        left = self.bounds if key is None else self.bounds.where(F.col("high") > key)
        # of the first range some rows may be behind us: without it, ``size`` rows are enough
        first = left.orderBy("range").first()
        if first is None:
            return self.rows.where("false").select(*self.columns), None
        last = left.where((F.col("range") == first["range"]) | (F.col("base") < first["base"] + first["n"] + size)).agg(F.max("high"), F.max("range")).first()
        own = self.rows.where((F.col("__key") <= last[0]) & F.col("__range").between(first["range"], last[1]))
        own = own if key is None else own.where(F.col("__key") > key)
        page = own.orderBy("__key").limit(size)
        ends = page.agg(F.max("__key"), F.count("*")).first()
        more = ends[1] == size and self.bounds.where(F.col("high") > ends[0]).take(1)
        return page.select(*self.columns), _token(ends[0]) if more else None

    def follow(self, size: int, token: str | None = None) -> Iterator[tuple[DataFrame, str | None]]:
        """All pages from ``token`` on."""
        while True:
            page, token = self.after(token, size)
            yield page, token
            if token is None:
                return


def _token(key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"after": key}).encode()).decode()
