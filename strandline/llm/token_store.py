"""Operator 4: token ids in binary segments with Elias-Fano document boundaries.

A store is a folder of Parquet rows ``(shard, segment, n_docs, n_ids, payload)``. Spark's writers
make it, so it can stand in any file system Spark can write. ``payload`` is one self-contained
binary file image:

``TOKS`` | version u8 (2) | id width u8 (2 or 4 bytes) | nulls u32 | first doc_id i64 | Elias-Fano of
doc_id minus the first | Elias-Fano of the end offset of each document | ids, little-endian.

An opened segment holds these bytes and no decoded table: offsets and doc_ids come from ``select``.
Documents stand in ascending doc_id order over (shard, segment, place). Documents without a
doc_id come first (``nulls`` of them), repeated doc_ids stand side by side, ordered by text hash.
Null text is an empty document: only the end id. An empty table gives an empty store. Extra columns are not
read. A long text is encoded whole by one task, which holds its ids (4 bytes each).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import col, prepare, slices
from strandline.llm.elias_fano import EliasFano
from strandline.llm.tokens import ENCODED_BYTES, encoder, with_end

_HEAD = "<BBIq"
STORE_SCHEMA = "shard int, segment int, n_docs long, n_ids long, payload binary"


def pack_segment(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One segment's file image; ``ends`` are the documents' end offsets in ``ids``."""
    nulls = sum(x is None for x in doc_ids)
    own = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(own[0]) if len(own) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return b"".join([
        b"TOKS", struct.pack(_HEAD, 2, width, nulls, first),
        EliasFano.build((own - first).view(np.uint64)).to_bytes(), EliasFano.build(ends).to_bytes(),
        ids.astype(f"<u{width}").tobytes(),
    ])


def open_segment(raw: bytes) -> tuple[int, int, EliasFano, EliasFano, np.ndarray]:
    """(nulls, first doc_id, doc_id offsets, end offsets, ids) of a file image."""
    if raw[:4] != b"TOKS":
        raise ValueError("not a token segment")
    _, width, nulls, first = struct.unpack_from(_HEAD, raw, 4)
    docs, at = EliasFano.from_bytes(raw, 4 + struct.calcsize(_HEAD))
    ends, at = EliasFano.from_bytes(raw, at)
    return nulls, first, docs, ends, np.frombuffer(raw, f"<u{width}", offset=at)


def document_ids(raw: bytes, place: int) -> np.ndarray:
    """The ids of the document at ``place`` of a segment, by two selects."""
    _, _, _, ends, ids = open_segment(raw)
    return ids[ends.select(place - 1) if place else 0 : ends.select(place)]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment_ids: int = 1 << 20) -> None:
    """Encode every text and write the store; a segment closes at ``segment_ids`` ids or more."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seg = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        have = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            raw = pack_segment(names, ids, np.concatenate(ends))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())],
                names=["shard", "segment", "n_docs", "n_ids", "payload"],
            )

        for b in slices(batches, most=ENCODED_BYTES):
            ids, offs = with_end(*encoder(tokenizer).encode(col(b, "text")), end_id)
            names += col(b, "doc_id").to_pylist()
            parts.append(ids)
            ends.append(offs[1:] + have)
            have += len(ids)
            if have >= segment_ids:
                yield close()
                names, parts, ends, have, seg = [], [], [], 0, seg + 1
        if names:
            yield close()

    # rows of one doc_id, or of none, are dealt over several ranges too
    order = ["doc_id", "h", "nth"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nth"))
    (
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
        .mapInArrow(run, STORE_SCHEMA).write.option("compression", "zstd").parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, segment, place.

    ``start`` counts the ids of all documents before it in the whole store: sums of segment
    counts within a shard, then of shards, are added to the offset inside the segment.
    """
    prepare(spark)
    store = spark.read.schema(STORE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, seg, raw in zip(*(col(b, c).to_pylist() for c in ("shard", "segment", "payload"))):
                nulls, first, docs, ends, ids = open_segment(raw)
                for lo in range(0, len(ends), 4096):
                    place = np.arange(lo, min(lo + 4096, len(ends)))
                    e = ends.select(place)
                    s = np.concatenate([[ends.select(lo - 1) if lo else 0], e[:-1]])
                    crc = [zlib.crc32(ids[i:j].astype("<u4")) for i, j in zip(s, e)]
                    known = place[place >= nulls]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None] * (len(place) - len(known)) + (docs.select(known - nulls) + first).tolist(), pa.int64()), pa.array(s), pa.array(e - s), pa.array(crc, pa.int64()),
                            pa.array(np.full(len(e), shard), pa.int32()), pa.array(np.full(len(e), seg), pa.int32()), pa.array(place.astype(np.int32)),
                        ],
                        names=["doc_id", "inner", "n_tokens", "ids_crc32", "shard", "segment", "place"],
                    )

    rows = store.select("shard", "segment", "payload").mapInArrow(run, "doc_id long, inner long, n_tokens long, ids_crc32 long, shard int, segment int, place int")
    heads = store.select("shard", "segment", "n_ids")
    zero = F.coalesce
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", zero(F.sum("n").over(over), F.lit(0)).alias("before"))
    base = heads.withColumn("skip", zero(F.sum("n_ids").over(in_shard), F.lit(0))).join(shards, "shard").select("shard", "segment", (F.col("skip") + F.col("before")).alias("base"))
    return rows.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment", "place")
