"""Edge records as they arrive: readStream of JSON Lines to an oriented adjacency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.graph import oriented
from strandline.sources.records import edge_rows


def stream_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(edge, s, p, o) of the records. One that is no JSON or lacks a key stops the stream, as it does a batch."""
    lines = spark.readStream.option("lineSep", "\n").text(folder).where(F.trim("value") != "")
    return edge_rows(lines).select("edge", "s", "p", "o")


def append_adjacency(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append both orientations to Parquet, all that is there now, exactly once."""
    return oriented(edges).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
