"""The stored adjacency: oriented edges as a set, bucketed by their first node, hubs over several buckets.

A hop that joins on the first node finds the table dealt out already, so Spark shuffles the walks alone. A node with more
edges than ``hub`` is split into slots by a hash of the edge: its edges lie in as many buckets, and walks that reach it
are sent to each of them. The folder holds ``rows`` (Parquet, one sorted file a bucket), ``hubs`` (f, slots) and ``layout``
(one row), so that any session can open it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.graph import EDGE, Adjacency
from strandline.sources.shared import discard, stored

#: Edges a node may have in one slot, and rows a bucket is meant to hold: one task sorts a bucket, whatever the table's size.
HUB, BUCKET_ROWS = 1_000_000, 1_000_000
#: Nodes are counted by this many hashes first: only where a hash is seen more often than a hub are nodes told apart.
COUNTERS = 1 << 14
LAYOUT = "buckets int, split boolean"


def write_adjacency(
    edges: DataFrame, path: str, hub: int = HUB, bucket_rows: int = BUCKET_ROWS, least_buckets: int = 8, distinct: bool = False, made: dict[str, Column] | None = None, exact: bool = False,
) -> None:
    """Repeated rows of ``edges`` (f, dir, edge, pred, t) are written once; ``distinct`` says that there are none, which spares
    looking for them. ``made`` gives the five columns over other ones of ``edges``, of which equal rows make equal edges: those
    are what is shuffled, and the texts are made behind it. A hub is told by its rows, by those that differ if ``exact``.

    ``edges`` are read twice and shuffled once. A ``hub`` below ``HUB`` takes one more shuffle, which counts each node where its
    edges meet."""
    spark, own, made = edges.sparkSession, edges.columns, made or {c: F.col(c) for c in EDGE}
    f, hashed = made["f"], F.pmod(F.xxhash64(made["f"]), F.lit(COUNTERS))
    seen = edges.groupBy(hashed.alias("hash")).count().collect()
    buckets = min(max(least_buckets, -(-sum(r["count"] for r in seen) // bucket_rows)), 100_000)
    once = exact and not distinct
    rows, hubs, kept = edges.withColumn("n", F.lit(None).cast("long")), None, []
    if often := [r["hash"] for r in seen if r["count"] > max(hub, HUB)]:
        some = edges.where(hashed.isin(often))
        degrees = (some.distinct() if once else some).groupBy(f.alias("__hub")).agg(F.count("*").alias("n")).where(F.col("n") > max(hub, HUB))
        hubs = stored(degrees, "hubs")  # few, since each has a million rows
        kept.append(hubs)
        rows = edges.join(F.broadcast(hubs), f == F.col("__hub"), "left").select(*own, "n")
    slots = F.ceil(F.col("n") / hub).cast("int")
    slot = F.coalesce(F.pmod(F.xxhash64(*own), slots).cast("int"), F.lit(0))
    if hub < HUB:
        dealt = rows.withColumn("slot", slot).repartition(buckets, f, "slot").select(f.alias("__f"), *own, "n", "slot")
        each = F.count("*").over(Window.partitionBy("__f", "slot"))
        n = F.coalesce("n", F.when(each > hub, each))
        rows = stored((dealt.distinct() if once else dealt).withColumn("n", n).select(*own, "n"), "counted")
        kept.append(rows)
        hubs = rows.where("n is not null").select(f.alias("__hub"), "n").distinct()
    hubs = spark.createDataFrame([], "__hub string, n long") if hubs is None else hubs
    hubs.select(F.col("__hub").alias("f"), slots.alias("slots"), "n").write.parquet(f"{path}/hubs")
    split = not spark.read.parquet(f"{path}/hubs").isEmpty()
    rows, keys = (rows.select(*own, slot.alias("slot")), ["f", "slot"]) if split else (rows.select(*own), ["f"])
    # the same dealing as the buckets': one file each, and repeated rows meet in one task
    dealt = rows.repartition(buckets, f, *keys[1:]).select(f.alias("__f"), *own, *keys[1:])
    dealt = dealt if distinct else dealt.distinct()
    dealt = dealt.select(F.col("__f").alias("f"), *(made[c].alias(c) for c in EDGE[1:]), *keys[1:])
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (
        dealt.write.bucketBy(buckets, *keys).sortBy("f", "dir", "edge").option("path", f"{path}/rows").option("parquet.block.size", str(8 << 20))
        .option("compression", "zstd").format("parquet").saveAsTable(name)
    )
    spark.createDataFrame([(buckets, split)], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    discard(*kept)


def _name(path: str) -> str:
    return f"strandline_adjacency_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def open_adjacency(spark: SparkSession, path: str) -> Adjacency:
    """The adjacency that ``write_adjacency`` left under ``path``, in this or another session."""
    buckets, split = spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()
    name, keys = _name(path), "f, slot" if split else "f"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{c} string" for c in EDGE) + (", slot int" if split else "")
        where = f"{path}/rows".replace("'", "''")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY (f) INTO {buckets} BUCKETS LOCATION '{where}'")
    hubs = spark.read.schema("f string, slots int, n long").parquet(f"{path}/hubs") if split else None
    return Adjacency(spark.table(name), hubs, distinct=True, buckets=buckets)
