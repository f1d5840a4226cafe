"""Operator 6: exact Jaccard join of word n-gram sets with count-vector R-trees.

A text's words are runs of characters outside white space after lower-casing A-Z; its set holds
the 64-bit hashes of its distinct ``n``-word shingles (of the whole sequence, if shorter). Two
sets link when 100 * intersection >= ``percent`` * union.

1. Documents with equal sets form a class; only classes are compared.
2. Routing. In any global order of shingles, linked sets share a shingle among their first
   |A| - ceil(t |A|) + 1. The order puts frequent shingles last and is the hash order otherwise.
   Which shingles are frequent is counted over all routed rows; at most ``most_hot`` can be,
   because the threshold is rows / most_hot at least, so the list that is broadcast is bounded.
   A wrong guess would cost time, not results: any order is exact.
3. In every group of classes that share a shingle and a size band, shingles hash into ``GROUPS``
   token groups; a set is the point of its group counts. An R-tree (sort-tile packed) holds
   the points; the sum of coordinate minima with a node's upper corner bounds the overlap of any
   point below it, and the sum with a point bounds that pair's overlap.
4. First round: each class stands in two of its groups, groups larger than ``block`` in blocks that share
   a few classes. In each block the R-tree feeds a maximum spanning forest of the bounded similarities (Prim), so
   one candidate a class at most comes out, and, bounds being near the truth, nearly all components do.
   Pairs are verified on the texts' shingles, and components are formed. Groups whose classes are all in one
   component are done.
5. Last round: all candidate pairs of different components are verified, large groups as pairs of blocks. So
   a group of thousands of near copies costs a few pairs each, and no link between components is lost.

Null, empty and wordless texts have an empty set, link with nothing and are their own component;
so are rows without doc_id (component null). Repeated doc_ids give one row each. Extra columns
are not read; empty tables give no rows; a similarity of exactly ``percent`` links. Of a long text a task holds its bytes and about
50 bytes a word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import class_words, col, discard, mix64, prepare, slices, span_hashes, stored, text_bytes
from strandline.llm.components import components

GROUPS = 256
LEAF = 16
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA24BAED4963EE407)]


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in (document, hash) order: hashes, documents, set size per document."""
    data, offs = text_bytes(texts)
    docs = len(offs) - 1
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    s, e, doc = class_words(data, offs, _SEP)
    words = np.bincount(doc, minlength=docs)
    h = span_hashes(data, s, e)
    del s, e, data  # of a long text these are the most
    k = len(h) - n + 1
    keys, own = [], []
    if k > 0:
        x = np.zeros(k, np.uint64)
        for i in range(n):
            x = mix64(x + h[i : i + k] * _MULT[i % 8] + np.uint64(i // 8))
        ok = doc[:k] == doc[n - 1 :]
        keys.append(x[ok])
        own.append(doc[:k][ok])
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = (np.cumsum(words) - words)[short]
        x = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = words[short] > i
            x[has] = mix64(x[has] + h[first[has] + i] * _MULT[i % 8] + np.uint64(977))
        keys.append(x)
        own.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    if docs == 1:  # a text as long as its slice: one sort
        x = np.unique(np.concatenate(keys))
        return x, np.zeros(len(x), np.int64), np.array([len(x)])
    x, d = np.concatenate(keys), np.concatenate(own)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])[: len(x)]
    x, d = x[new], d[new]
    return x, d, np.bincount(d, minlength=docs)


def _set_names(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit names of each set."""
    ends = np.cumsum(size)
    out = np.zeros((len(size), 2), np.int64)
    for i, (a, b) in enumerate(zip(ends - size, ends)):
        if a < b:
            out[i] = np.frombuffer(hashlib.blake2b(x[a:b].tobytes(), digest_size=16).digest(), np.int64)
    return out


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of linked sets are in the same or in neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(percent / 100) + 1e-9).astype(np.int32)


def prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - -(-percent * size // 100) + 1, 0)


def packed(counts: np.ndarray) -> list[bytes]:
    """Each row of counts as bytes: one a group, four where a count needs them."""
    small = (counts < 256).all(1)
    return [(v.astype(np.uint8) if one else v.astype("<u4")).tobytes() for v, one in zip(counts, small)]


def unpacked(blobs: list[bytes]) -> np.ndarray:
    out = np.zeros((len(blobs), GROUPS), np.int32)
    short = np.array([len(x) == GROUPS for x in blobs], bool)
    for own, kind in ((short, np.uint8), (~short, "<u4")):
        out[own] = np.frombuffer(b"".join(x for x, o in zip(blobs, own) if o), kind).reshape(-1, GROUPS)
    return out


class RTree:
    """Sort-tile packed tree over count vectors; nodes keep upper corners and size ranges."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # tiles: by size first, then by the two fullest coordinates
        spread = np.argsort(-points.astype(np.float64).var(0))[:2]
        slabs = max(1, int(round((len(points) / LEAF) ** (1 / 3))))
        self.order = np.argsort(sizes, kind="stable")
        for k, d in enumerate(spread):
            cuts = np.array_split(self.order, slabs ** (k + 1))
            self.order = np.concatenate([c[np.argsort(points[c, d], kind="stable")] for c in cuts])
        self.points, self.sizes = points[self.order], sizes[self.order]
        heads = np.arange(0, len(points), LEAF)
        self.upper = np.maximum.reduceat(self.points, heads, axis=0)
        self.low = np.minimum.reduceat(self.sizes, heads)
        self.high = np.maximum.reduceat(self.sizes, heads)
        top = np.arange(0, len(heads), LEAF)
        self.top = (np.maximum.reduceat(self.upper, top, axis=0), np.minimum.reduceat(self.low, top), np.maximum.reduceat(self.high, top))

    def search(self, q: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the original order) that may link with the query, and their bounds."""
        def alive(upper, low, high):
            # a partner of size m needs overlap of percent * (n + m) / (100 + percent)
            fits = (100 * high >= percent * n) & (percent * low <= 100 * n)
            return fits & ((100 + percent) * np.minimum(upper, q).sum(1) >= percent * (n + np.maximum(low, -(-percent * n // 100))))

        t = np.flatnonzero(alive(*self.top))
        leaf = (t[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaf = leaf[leaf < len(self.low)]
        leaf = leaf[alive(self.upper[leaf], self.low[leaf], self.high[leaf])]
        at = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        bound = np.minimum(self.points[at], q).sum(1)
        m = self.sizes[at]
        ok = ((100 + percent) * bound >= percent * (n + m)) & (100 * m >= percent * n) & (100 * n >= percent * m)
        return self.order[at[ok]], bound[ok]


def _forest(ids: np.ndarray, size: np.ndarray, vec: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (a, b) of a maximum spanning forest of one block's candidate pairs, the most similar
    by bound first: thresholds split such a forest as they split the whole graph."""
    m = len(ids)
    if m <= LEAF:
        both = _dense(size, vec, percent)
        near = lambda i: ((j := np.flatnonzero(both[i])), both[i, j])
    else:
        tree = RTree(vec, size)
        near = lambda i: tree.search(vec[i], int(size[i]), percent)
    best, link, out = np.full(m, -1.0), np.full(m, -1), np.zeros(m, bool)
    a, b = [], []
    for _ in range(m):
        v = int(np.where(out, -2.0, best).argmax())
        out[v] = True
        if link[v] >= 0:
            a.append(link[v])
            b.append(v)
        j, bound = near(v)
        bound = np.minimum(bound, np.minimum(size[j], size[v]))
        like = bound / (size[j] + size[v] - bound)
        up = ~out[j] & (like > best[j])
        best[j[up]], link[j[up]] = like[up], v
    if a:
        x, y = ids[a], ids[b]
        yield np.minimum(x, y), np.maximum(x, y)


def _dense(size: np.ndarray, vec: np.ndarray, percent: int) -> np.ndarray:
    """Overlap bounds within one leaf; 0 where a pair cannot link."""
    bound = np.minimum(vec[:, None], vec[None]).sum(2)
    ok = ((100 + percent) * bound >= percent * (size[:, None] + size)) & (100 * size[:, None] >= percent * size) & (100 * size >= percent * size[:, None])
    np.fill_diagonal(ok, False)
    return np.where(ok, bound, 0)


def _across(ids: np.ndarray, size: np.ndarray, vec: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidate pairs (a, b) of different components in one group. ``side``: 0 and 1 in a pair of
    blocks (only pairs across)."""
    across = side.any() and not side.all()
    if len(ids) <= LEAF and not across:  # one leaf: compare its points at once
        ok = (_dense(size, vec, percent) > 0) & (ids[:, None] < ids) & (comp[:, None] != comp)
        i, j = np.nonzero(ok)
        if len(i):
            yield ids[i], ids[j]
        return
    # of two components one is not the largest: its members ask, and find the pairs of both
    names, count = np.unique(comp, return_counts=True)
    largest = names[count.argmax()]
    asking = np.flatnonzero(comp != largest)
    if not len(asking):
        return
    tree = RTree(vec, size)
    for i in asking:
        j, _ = tree.search(vec[i], int(size[i]), percent)
        # a pair that both members ask for is given once
        once = (side[i] == 0) if across else (ids[j] > ids[i])
        ok = (comp[j] != comp[i]) & ((comp[j] == largest) | once)
        if across:
            ok &= side[j] != side[i]
        j = j[ok]
        if len(j):
            yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _by_group(keys: list[str], percent: int, pairs_of):
    """mapInArrow over rows sorted by ``keys``: streams one group after another through ``pairs_of``
    (``_forest`` or ``_across``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[bytes] = set()
        out: list[tuple] = []

        def close(rows: list[tuple]) -> None:
            ids, size, comp, side = (np.concatenate([r[k] for r in rows]) for k in range(4))
            if len(ids) < 2:
                return
            vec = np.concatenate([r[4] for r in rows])
            order = np.argsort(ids, kind="stable")
            ids, size, comp, side, vec = ids[order], size[order], comp[order], side[order], vec[order]
            name = hashlib.blake2b(ids.tobytes() + side.tobytes(), digest_size=16).digest()
            if name in seen:  # near copies share many shingles: the same group again
                return
            if len(seen) > 50_000:  # a group seen longer ago is compared once more
                seen.clear()
            seen.add(name)
            out.extend(pairs_of(ids, size, vec, comp, side, percent))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                pairs = np.unique(np.concatenate([np.stack(o, 1) for o in out]), axis=0)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([col(b, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in keys])
            cols = [col(b, x).to_numpy(zero_copy_only=False) for x in ("id", "n", "comp", "side")]
            vec = unpacked(col(b, "vec").to_pylist())
            cuts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [b.num_rows]])
            for i, j in zip(cuts[:-1], cuts[1:]):
                own = tuple(k[:, i])
                if own != last and held:
                    close(held)
                    held = []
                last = own
                held.append((*(c[i:j] for c in cols), vec[i:j]))
            if len(out) > 2000:
                yield from flush()
        if held:
            close(held)
        yield from flush()

    return run


def _by_size(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts of about ``most`` bytes of text behind the compressed column ``z``, or one row."""
    import zstandard

    ends = np.cumsum([zstandard.frame_content_size(z) for z in col(batch, "z").to_pylist()])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, fan: int = 256) -> DataFrame:
    """The pairs (a, b) that link, decided on the whole texts' shingles.

    Texts travel compressed: a's once for every ``fan`` of its partners (so a hub is dealt over
    tasks), b's once a pair. A task holds one set of a while its partners stream by.
    """
    import zstandard

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            blobs = [z.compress((t or "").encode("utf-8", "replace")) for t in col(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([col(b, "id"), pa.array(blobs, pa.binary())], names=["id", "z"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held, sets = None, []
        for big in batches:
            for b in _by_size(big, 1 << 20):
                x, _, size = shingles(pa.array([z.decompress(t) for t in col(b, "z").to_pylist()], pa.binary()).cast(pa.string()), n)
                ends = np.cumsum(size)
                found = []
                for a, salt, o, i, j in zip(*(col(b, c).to_pylist() for c in ("a", "salt", "b")), ends - size, ends):
                    own = x[i:j]
                    if o is None:
                        if held != (a, salt):
                            held, sets = (a, salt), []
                        sets.append(own)
                        continue
                    for p in sets:
                        both = len(np.intersect1d(p, own, assume_unique=True))
                        if 100 * both >= percent * (len(p) + len(own) - both):
                            found.append((a, o))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = stored(texts.join(need, "id").mapInArrow(squeeze, "id long, z binary"), "jac-texts")
    discard(need)
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("salts"))
    members = own.withColumnRenamed("id", "b").join(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "b")
    heads = own.withColumnRenamed("id", "a").join(degree.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "a")
    rows = heads.select("a", "salt", F.lit(None).cast("long").alias("b"), "z").unionByName(members.select("a", "salt", "b", "z"))
    out = stored(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(decide, "a long, b long").distinct(), "jac-links")
    discard(own)
    return out


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85, most_hot: int = 50_000, least_hot: int = 256, block: int = 1024, shared: int = 16) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_verified (links of its class that were
    verified: all that the components needed, not every link inside a component)."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, d, size = shingles(col(b, "text"), n)
            name = _set_names(x, size)
            vec = np.bincount(d * GROUPS + (x & np.uint64(GROUPS - 1)).astype(np.int64), minlength=len(size) * GROUPS).reshape(-1, GROUPS)
            place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            lead = place < prefix(size, percent)[d]
            ends = np.concatenate([[0], np.cumsum(np.bincount(d[lead], minlength=len(size)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [col(b, "doc_id"), pa.array(size), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(packed(vec), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(x[lead].view(np.int64)))],
                names=["doc_id", "n", "s1", "s2", "vec", "lead"],
            )

    named = stored(base.mapInArrow(profile, "doc_id long, n long, s1 long, s2 long, vec binary, lead array<long>"), "jac-named")
    classes = stored(named.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("vec").alias("vec")), "jac-classes")

    def routed(hot: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(hot)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # equal sets route once a task
            h = sent.value
            for b in slices(batches):
                x, d, size = shingles(col(b, "text"), n)
                s1 = _set_names(x, size)[:, 0]
                fresh = np.zeros(len(size), bool)
                for i, s in enumerate(s1.tolist()):
                    if size[i] and s not in seen:
                        fresh[i] = True
                        seen.add(s)
                keep = fresh[d]
                x, d = x[keep], d[keep]
                if not len(x):
                    continue
                if len(h):
                    late = h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x
                    order = np.lexsort((x, late, d))
                    x, d = x[order], d[order]
                own = np.where(fresh, size, 0)
                place = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
                keep = place < prefix(size, percent)[d]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)), pa.array(s1[d[keep]])], names=["k", "s1"])

        return base.select("text").mapInArrow(run, "k long, s1 long")

    # the first pass counts the leading shingles in hash order, the second routes by the final order
    led = named.where("n > 0")
    least = max(least_hot, (led.agg(F.sum(F.size("lead"))).first()[0] or 0) // most_hot)
    often = led.select(F.explode("lead").alias("k"), "s1").groupBy("k").agg(F.count("*").alias("c"), F.min("s1").alias("lo"), F.max("s1").alias("hi"))
    # more than ``least`` routed rows each: at most ``most_hot`` of them
    hot = np.sort(np.array([r[0] for r in often.where((F.col("c") > least) & (F.col("lo") != F.col("hi"))).select("k").collect()], np.int64).view(np.uint64))
    rows = stored(routed(hot), "jac-rows")
    counts = rows.groupBy("k").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi")
    met = rows.join(counts.select("k"), "k").select("k", "s1").distinct().join(classes.select("s1", "id", "n"), "s1")
    log = -math.log(percent / 100)
    bands = F.floor(F.log(F.col("n")) / F.lit(log) + F.lit(1e-9)).cast("int")
    met = stored(met.select("k", "id", "n", bands.alias("band")), "jac-met")
    discard(rows)

    # every class stands in its band and the next, so neighbours in size meet in one group
    at = met.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    # near copies share many shingles: of groups with the same members one is kept
    members = at.groupBy("k", "band").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "id")).alias("y")).where("c > 1")
    sizes = members.groupBy("c", "x", "y").agg(F.min(F.struct("k", "band")).alias("g")).select("g.k", "g.band", "c").withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    # vectors follow only where they are compared
    of = stored(at.join(sizes, ["k", "band"]), "jac-of")
    discard(met)
    spread = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    keys, zero = ["k", "band", "i", "j"], F.lit(0)

    def candidates(rows: DataFrame, pairs_of) -> DataFrame:
        ready = rows.join(classes.select("id", "vec"), "id").repartition(*keys).sortWithinPartitions(*keys)
        return ready.select(*keys, "id", "n", "comp", "side", "vec").mapInArrow(_by_group(keys, percent, pairs_of), "a long, b long").distinct()

    # first round: each class in two of its groups, the largest and one by hash; about ``shared`` classes
    # of a group stand in all its blocks, so that near copies in different blocks meet
    texts = base.withColumnRenamed("doc_id", "id").where("id is not null")
    group, order = F.struct("k", "band", "blocks", "c"), F.xxhash64("k", "band")
    two = of.groupBy("id", "n").agg(F.max_by(group, F.struct("c", order)).alias("x"), F.min_by(group, order).alias("y"))
    two = two.select("id", "n", F.explode(F.array_distinct(F.array("x", "y"))).alias("g")).select("id", "n", "g.*")
    everywhere = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(1), "id"), F.col("c")) < shared)
    at_block = F.explode(F.when(everywhere, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array(spread)))
    tried = stored(candidates(two.select("k", "band", at_block.alias("i"), zero.alias("j"), "id", "n", F.col("id").alias("comp"), zero.alias("side")), _forest), "jac-pairs")
    links = _verify(tried, texts, n, percent)
    comps = stored(components(links), "jac-comps")

    def mixed() -> DataFrame:
        """Rows of the groups that still hold several components."""
        rows = of.join(comps.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        open_ = rows.groupBy("k", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k", "band")
        return rows.join(open_, ["k", "band"])

    # last round: all that is left
    left = mixed().withColumn("own", spread)
    # pairs of blocks (i, j), i <= j: a class of block s is on side 0 of (s, j) and on side 1 of (i, s)
    other = F.explode(F.sequence(zero, F.col("blocks") - 1))
    left = left.withColumn("o", other).select("k", "band", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "id", "n", "comp", (F.col("own") > F.col("o")).cast("int").alias("side"))
    rest = stored(candidates(left, _across).join(tried, ["a", "b"], "left_anti"), "jac-rest")
    if rest.take(1):
        more = _verify(rest, texts, n, percent)
        links = links.unionByName(more)
        # the known components stand as stars, so few steps are left
        stars = comps.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        comps = stored(components(stars.unionByName(more)), "jac-comps")
    discard(of, rest)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_verified"))
    per_class = classes.select("s1", "s2", "id").join(comps, "id", "left").join(degree, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"))
    linked = named.where("n > 0 and doc_id is not null").join(per_class, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_verified")
    alone = named.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_verified"))
    return linked.unionByName(alone)
