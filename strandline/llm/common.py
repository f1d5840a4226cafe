"""Session, storage and Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.package import ship
from strandline.sources.shared import shared_dir

#: Text bytes that one numpy pass works on; bounds a task's memory for any document mix.
SLICE_BYTES = 1 << 20

#: Workers give freed arrays back to the system, so that reused ones stay small.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small: 2000 rows or 4 MB. Spark
    reads the two settings when it plans a job, so they stay in the session that runs these operators."""
    ship(spark)
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more, and let Spark drop the
    shuffle files behind them."""
    import gc

    for df in frames:
        path = getattr(df, "_strandline_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if frames:
        gc.collect()
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def fold(col: Column, n: int) -> Column:
    """crc32 of an id's text, modulo n; null ids give null."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (int64, one more than rows) of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n.astype(np.int64))
        i = 0
        while i < b.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(i, j - i)
            i = j


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` of all pairs."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep]
    heads = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=heads[1:])
    out[heads] = s
    out[heads[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int, kind: str) -> np.ndarray:
    have = _POW.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        x = np.full(size, _BASE if kind == "up" else _INV, np.uint64)
        x[0] = 1
        have = _POW[kind] = np.multiply.accumulate(x)
    return have[:n]


#: Longer spans are hashed one by one: a polynomial modulo a power of two is the same for some unlike texts of this kind.
POLYNOMIAL_BYTES = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand: a
    polynomial prefix sum modulo 2**64, shifted back by the base's inverse power; BLAKE2 for spans beyond
    ``POLYNOMIAL_BYTES``. Works on about ``SLICE_BYTES`` of ``data`` at a time."""
    size = ends - starts
    h = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(size <= POLYNOMIAL_BYTES)
    if len(short) and (np.diff(starts[short]) < 0).any():
        short = short[np.argsort(starts[short], kind="stable")]
    own, i = starts[short], 0
    while i < len(short):
        j = int(np.searchsorted(own, own[i] + SLICE_BYTES, "right"))
        at, low = short[i:j], own[i]
        part = data[low : ends[at].max()]
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(max(len(part), 1), "up")[: len(part)], out=c[1:])
        h[at] = (c[ends[at] - low] - c[starts[at] - low]) * _powers(len(part) + 1, "down")[starts[at] - low]
        i = j
    h = mix64(h ^ (size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    long = np.flatnonzero(size > POLYNOMIAL_BYTES)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), "little") for i, j in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def lowest(df: DataFrame, h: Column, most: int) -> DataFrame:
    """The rows of ``df`` that can be among the ``most`` distinct rows of smallest 64-bit hash ``h``: a few
    times as many. One pass counts distinct hashes by power of two (64 numbers), so that a sort with
    a limit gets about ``most`` rows, however many partitions there are."""
    share = (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    level = F.coalesce(F.least(F.floor(-F.log2(share)), F.lit(63)), F.lit(63)).cast("int")
    found, above, least = {r[0]: r[1] for r in df.select(level.alias("l"), h.alias("h")).groupBy("l").agg(F.approx_count_distinct("h")).collect()}, 0, 0
    for least in range(63, -1, -1):
        above += found.get(least, 0)
        if above >= 1.5 * most:
            break
    return df.where(level >= least)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int, max_bytes: int = 16 << 20) -> DataFrame:
    """At most ``max_rows`` labelled whole texts (doc_id, text, y) for fitting, none held out, of at
    most ``max_bytes`` bytes together.

    Rows are taken in the order of a hash of doc_id, whatever their length, until either bound is
    met. The small side of the join has at most ``max_rows`` rows of two numbers and is broadcast; only
    hashes and lengths of at most ``max_rows`` rows come to the driver to find the cut. Rows
    without id, label or text are not used; repeated rows count once, and a doc_id on many rows cannot
    exceed the bounds.
    """
    able = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), modulus) != held))
    few = (
        lowest(able, F.xxhash64("doc_id"), max_rows)
        .groupBy("doc_id").agg(F.max(label).cast("string").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    own = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")
    own = stored(own.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("o", F.xxhash64("doc_id")).dropDuplicates(["o", "h"]), "labelled")
    order = [F.col("o"), F.col("h")]
    first = own.select("o", "h", F.octet_length("text").cast("long").alias("n")).orderBy(*order).limit(max_rows).toArrow()
    if not first.num_rows:
        return own.select("doc_id", "text", "y")
    taken = int(np.searchsorted(np.cumsum(first["n"].to_numpy()), max_bytes, "right"))
    taken = max(1, min(taken, first.num_rows)) - 1
    cut = F.struct(F.lit(first["o"][taken].as_py()).alias("o"), F.lit(first["h"][taken].as_py()).alias("h"))
    return own.where(F.struct("o", "h") <= cut).select("doc_id", "text", "y")


def class_words(data: np.ndarray, offs: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs of bytes outside ``is_sep`` (256 flags) that do not cross documents:
    starts, ends and each word's document. Works on ``SLICE_BYTES`` at a time."""
    n, starts, ends = len(data), [], []
    for a in range(0, n, SLICE_BYTES):
        b = min(a + SLICE_BYTES, n)
        # the byte before the block and the one behind it; beyond the data nothing is a word
        w, head = np.zeros(b - a + 2, bool), np.zeros(b - a + 2, bool)
        low, high = max(a - 1, 0), min(b + 1, n)
        w[low - a + 1 : high - a + 1] = ~is_sep[data[low:high]]
        edges = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b, "right")]
        head[edges - a + 1] = True
        head[-1] |= b == n
        own = w[1:-1]
        starts.append(np.flatnonzero(own & (~w[:-2] | head[1:-1])) + a)
        ends.append(np.flatnonzero(own & (~w[2:] | head[2:])) + a + 1)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    s, e = np.concatenate(starts), np.concatenate(ends)
    return s, e, np.searchsorted(offs, s, "right") - 1


def counts_before(flags: np.ndarray, data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many bytes before each of the ascending ``positions`` are flagged (256 flags), ``SLICE_BYTES`` at a time."""
    out, base = np.zeros(len(positions), np.int64), 0
    for a in range(0, len(data), SLICE_BYTES):
        c = np.concatenate([[0], np.cumsum(flags[data[a : a + SLICE_BYTES]])])
        i, j = np.searchsorted(positions, [a, a + len(c) - 1])
        out[i:j] = base + c[positions[i:j] - a]
        base += int(c[-1])
    out[np.searchsorted(positions, len(data)) :] = base
    return out


def per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=docs)
