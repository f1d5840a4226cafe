"""Operator 9: approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two, multiplied three times by random signs and a fast Hadamard
transform, and assigned to the nearest signed axis. A table joins ``width`` such hashes into a
bucket; the width grows with the logarithm of the number of rows so that buckets keep about ``fill`` rows. Each query
probes its most promising buckets of every table (next-best axes, ranked by the loss of projection).

Recall: a sample of at most 256 queries is answered exactly first, and ``probes`` is doubled until the tables hold
``target`` of the sample's neighbours (at most until every bucket is probed). All queries then go through the tables.

What is shuffled: rows and probes carry ids and quantised vectors (two bytes a component, and how far they are off). A
candidate is left out only when its cosine is below that of ``k`` + 1 others whatever the quantisation did to them; all others
of a query, however many, fetch their vectors once and are ranked by exact cosine in double precision.

Scale: equal vectors are one class, of which only the ``k + 1`` smallest ids matter to any query,
so copies cost one candidate. Buckets with more than ``block`` rows or queries are dealt over a grid of row blocks and
query blocks, so no bucket lands in one task. (A direction that a large share of all different vectors has in common
stays quadratic in that share: their queries meet their rows in the grid.) Queries that found fewer than ``k``
neighbours meet all classes, in blocks of both.

Vectors that are null, empty, zero or hold null or non-finite components take no part; neither do rows without
id. Vectors of different dimensions have no cosine: each dimension is searched by itself. Repeated rows are rows: a
query finds its own copies, and each copy of a query asks alike. Of a query's candidates only its own row is left out.
Ties go to the smaller id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import col, discard, prepare, stored


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long)."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    def __init__(self, dim: int, tables: int, width: int, axes: int, seed: int):
        self.n = 1 << max(1, (dim - 1).bit_length())
        self.dim, self.tables, self.width = dim, tables, width
        self.axes = [self.n] * (width - 1) + [max(1, min(axes, self.n))]  # of the last hash of a table
        self.signs = np.random.default_rng(seed).integers(0, 2, (tables, width, 3, self.n)) * 2.0 - 1

    def project(self, x: np.ndarray, table: int, j: int) -> np.ndarray:
        y = np.zeros((len(x), self.n))
        y[:, : self.dim] = x
        for s in self.signs[table, j]:
            y = hadamard(y * s)
        return y[:, : self.axes[j]]

    def probes(self, x: np.ndarray, table: int, most: int) -> list[np.ndarray]:
        """Buckets of each row, best first: the nearest axes, then next-best ones by lost projection."""
        options, loss = [np.zeros((len(x), 1), np.int64)], [np.zeros((len(x), 1))]
        for j in range(self.width):
            p = self.project(x, table, j)
            size = np.abs(p)
            m = min(most, p.shape[1])
            top = np.argsort(-size, 1, kind="stable")[:, :m]
            rows = np.arange(len(x))[:, None]
            axis = 2 * top + (p[rows, top] < 0)
            cost = size.max(1, keepdims=True) - size[rows, top]
            code = (options[0][:, :, None] * (2 * p.shape[1]) + axis[:, None, :]).reshape(len(x), -1)
            cost = (loss[0][:, :, None] + cost[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, 1, kind="stable")[:, :most]
            options, loss = [code[rows, best]], [cost[rows, best]]
        return [options[0][:, i] for i in range(options[0].shape[1])]


def _plan(n: int, dim: int, fill: int) -> tuple[int, int]:
    """(hashes per table, axes of the last) for buckets of about ``fill`` rows: the number of buckets
    follows the number of rows."""
    full = 1 << max(1, (dim - 1).bit_length())
    bits = max(1.0, np.log2(max(n, 2) / fill))
    per = np.log2(2 * full)
    width = max(1, int(np.ceil(bits / per)))
    return width, max(1, int(round(2 ** (bits - per * (width - 1) - 1))))


def _matrix(arr: pa.Array, dim: int) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """At unit length; scaled first, so that neither tiny nor huge components are lost."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def quantised(x: np.ndarray) -> list[bytes]:
    """Unit vectors as two bytes a component, from minus to plus the vector's largest component. That one stands in front,
    and behind it the distance between the vector and what ``restored`` gives for it."""
    top = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30).astype(np.float32)
    q = np.rint(x / top * 32767).astype("<i2")
    off = np.sqrt(((_unit_again(q, top) - x) ** 2).sum(1)).astype(np.float32) * np.float32(1.001)
    return [t.tobytes() + e.tobytes() + r.tobytes() for t, e, r in zip(top, off, q)]


def _unit_again(q: np.ndarray, top: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32) * top
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None]


def restored(codes: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors close to those that ``quantised`` got, and how far they are off."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), 2 * dim + 8)
    head = raw[:, :8].copy().view(np.float32)
    return _unit_again(raw[:, 8:].copy().view("<i2"), head[:, :1]), head[:, 1]


def able(q: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's different c that can be among its ``k`` nearest, the true cosine lying within ``e`` of ``s``."""
    order = np.lexsort((c, q))
    order = order[np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (c[order][1:] != c[order][:-1])])[: len(q)]]
    order = order[np.lexsort((-(s - e)[order], q[order]))]
    own = q[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    sizes = np.diff(np.append(first, len(own)))
    low = (s - e)[order]
    least = np.where(sizes >= k, low[np.minimum(first + k - 1, len(own) - 1)], -np.inf) if len(own) else low
    return order[(s + e)[order] >= np.repeat(least, sizes)]


def _candidates(names: tuple[str, ...], parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for arrays in parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=list(names))


def _meeting(keys: list[str], dim: int, k: int, most: int = 400_000):
    """mapInArrow over queries and rows sorted by ``keys`` and ``ask`` (queries first): each group's rows that can be among
    a query's ``k`` nearest (q, c, s, e), as far as the task knows them."""
    rounding = np.float32(2e-7 * dim + 1e-6)  # of a scalar product in single precision

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        have, last = 0, None
        owners, asked, off = np.zeros(0, np.int64), np.zeros((0, dim), np.float32), np.zeros(0, np.float32)

        def merged() -> tuple[np.ndarray, ...]:
            q, c, s, e = (np.concatenate(x) for x in zip(*found))
            at = able(q, c, s, e, k)
            return q[at], c[at], s[at], e[at]

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([col(b, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in keys])
            ids, ask, z = col(b, "c").to_numpy(), col(b, "ask").to_numpy(zero_copy_only=False), col(b, "z")
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [b.num_rows]])
            for i, j in zip(cuts[:-1], cuts[1:]):
                own = tuple(key[:, i])
                if own != last:
                    last, owners, asked, off = own, np.zeros(0, np.int64), np.zeros((0, dim), np.float32), np.zeros(0, np.float32)
                m = i + int(ask[i:j].sum())
                if m > i:
                    x, e = restored(z[i:m].to_pylist(), dim)
                    owners, asked, off = np.append(owners, ids[i:m]), np.concatenate([asked, x]), np.append(off, e)
                if m == j or not len(owners):
                    continue
                x, e = restored(z[m:j].to_pylist(), dim)
                step = max(1, (1 << 20) // (j - m))
                for a in range(0, len(owners), step):
                    s = asked[a : a + step] @ x.T
                    wide = off[a : a + step, None] + e[None, :] + rounding
                    low = s - wide
                    least = -np.partition(-low, k - 1, 1)[:, k - 1 : k] if j - m > k else np.full((len(s), 1), -np.inf)
                    at, to = np.nonzero(s + wide >= least)
                    found.append((owners[a : a + step][at], ids[m:j][to], s[at, to], wide[at, to]))
                    have += len(at)
                    if have > most:
                        found = [merged()]
                        have = len(found[0][0])
                        if have > most // 2:  # many queries, or many that are equally near: what is merged goes on
                            yield from _candidates(("q", "c", "s", "e"), found)
                            found, have = [], 0
        if found:
            yield from _candidates(("q", "c", "s", "e"), [merged()])

    return run


def _sample(classes: DataFrame, dim: int, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most ``rows`` asking classes in hash order: their vectors, and the vectors of the exact ``k``
    nearest other classes of each with the number of its query."""
    some = classes.where("asks").orderBy(F.xxhash64("c"), "c").limit(rows).select("c", "v").collect()
    own, q = np.array([r["c"] for r in some], np.int64), np.array([r["v"] for r in some], float).reshape(-1, dim)
    sent = classes.sparkSession.sparkContext.broadcast((own, _unit(q) if len(q) else q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, u = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, c = _matrix(col(b, "v"), dim), col(b, "c").to_numpy()
            s = u @ _unit(x).T
            s[ids[:, None] == c[None, :]] = -np.inf
            m = min(k, len(c))
            top = np.argpartition(-s, m - 1, 1)[:, :m]
            i = np.repeat(np.arange(len(ids)), m)
            keep = np.isfinite(s[i, top.ravel()])
            i, j = i[keep], top.ravel()[keep]
            yield pa.RecordBatch.from_arrays([pa.array(i), col(b, "c").take(pa.array(j)), pa.array(s[i, j])], names=["i", "c", "s"])

    if not some:
        return q, q, own
    found = classes.select("c", "v").mapInArrow(run, "i long, c long, s double")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "c"))).where(F.col("r") <= k)
    near = F.broadcast(found.select("i", "c")).join(classes.select("c", "v"), "c").select("i", "v").collect()
    return _unit(q), _unit(np.array([r["v"] for r in near], float).reshape(-1, dim)) if near else q[:0], np.array([r["i"] for r in near], np.int64)


def _enough(lsh: CrossPolytope, sample: tuple[np.ndarray, np.ndarray, np.ndarray], probes: int, target: float) -> int:
    """Fewest probes (doubled from ``probes``) that find ``target`` of the sample's neighbours, at most all buckets."""
    q, near, owner = sample
    every = int(np.prod([2.0 * a for a in lsh.axes]))
    if not len(near):
        return min(probes, every)
    codes = [lsh.probes(near, t, 1)[0] for t in range(lsh.tables)]
    while probes < every:
        hit = np.zeros(len(near), bool)
        step = max(1, (1 << 21) // (probes * lsh.n))
        for a in range(0, len(q), step):
            mine = np.flatnonzero((owner >= a) & (owner < a + step))
            for t in range(lsh.tables):
                tried = np.stack(lsh.probes(q[a : a + step], t, probes), 1)
                hit[mine] |= (tried[owner[mine] - a] == codes[t][mine, None]).any(1)
        if hit.mean() >= target:
            return probes
        probes *= 2
    return every


OUT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int = 50, k: int = 5, **options) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` against all rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    prepare(spark)
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    out = spark.createDataFrame([], OUT)
    for (dim,) in ok.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        out = out.unionByName(_search(ok.where(F.size("v") == dim), dim, every, k, **options))
    return out


def _search(ok: DataFrame, dim: int, every: int, k: int, tables: int = 4, probes: int = 16, fill: int = 256, block: int = 4096, seed: int = 5, target: float = 0.95) -> DataFrame:
    spark = ok.sparkSession
    # classes of equal vectors, by a number of their own; ids of each class are kept beside
    named = ok.withColumn("h", F.sha2(F.array_join(F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ","), 256))
    asks = F.max(F.when(F.col("vec_id") % every == 0, F.lit(True)).otherwise(F.lit(False)))
    classes = stored(named.groupBy("h").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"), asks.alias("asks")).withColumn("c", F.monotonically_increasing_id()), "ann-classes")
    ids = stored(named.groupBy("h", "vec_id").agg(F.count("*").alias("copies")).join(classes.select("h", "c"), "h").select("c", "vec_id", "copies"), "ann-ids")
    n = classes.count()
    width, axes = _plan(n, dim, fill)
    lsh = CrossPolytope(dim, tables, width, axes, seed)
    sent = spark.sparkContext.broadcast(lsh)
    probes = _enough(lsh, _sample(classes, dim, k, 256), probes, target)

    def hashed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 20) // (most * lsh.n))
            for b in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
                x = _unit(_matrix(col(b, "v"), dim))
                z = pa.array(quantised(x), pa.binary())
                for t in range(lsh.tables):
                    codes = sent.value.probes(x, t, most)
                    rows = pa.array(np.tile(np.arange(len(x)), len(codes)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(np.concatenate(codes)), col(b, "c").take(rows), z.take(rows)], names=["t", "b", "c", "z"])

        return run

    shape = "t int, b long, c long, z binary"
    rows = classes.select("c", "v").mapInArrow(hashed(1), shape)
    asked = classes.where("asks").select("c", "v").mapInArrow(hashed(probes), shape)
    rows, asked = stored(rows, "ann-rows"), stored(asked, "ann-asked")
    keys, zero = ["t", "b", "i", "j"], F.lit(0)
    # only buckets of more than ``block`` rows or queries need a grid
    large = rows.groupBy("t", "b").agg(F.count("*").alias("n"), zero.cast("long").alias("m")).unionByName(asked.groupBy("t", "b").agg(zero.cast("long").alias("n"), F.count("*").alias("m")))
    large = stored(large.groupBy("t", "b").agg(F.ceil(F.sum("n") / block).cast("int").alias("x"), F.ceil(F.sum("m") / block).cast("int").alias("y")).where("x > 1 or y > 1"), "ann-large")

    def spread(side: DataFrame, own: str, many: str, at: str, other: str) -> DataFrame:
        """Each row stands in one of its own blocks, and there in every block of the other side."""
        if not large.take(1):
            return side.select("t", "b", zero.alias("i"), zero.alias("j"), "c", "z")
        met = side.join(large, ["t", "b"], "left")
        part = F.pmod(F.xxhash64("c"), F.greatest(F.coalesce(own, F.lit(1)), F.lit(1))).cast("int")
        copies = F.explode(F.sequence(zero, F.greatest(F.coalesce(many, F.lit(1)), F.lit(1)) - 1))
        return met.select("t", "b", part.alias(at), copies.alias(other), "c", "z").select(*keys, "c", "z")

    def meet(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
        both = asked.withColumn("ask", F.lit(True)).unionByName(rows.withColumn("ask", F.lit(False)))
        return both.repartition(*keys).sortWithinPartitions(*keys, F.desc("ask")).mapInArrow(_meeting(keys, dim, k + 1), "q long, c long, s float, e float")

    found = meet(spread(asked, "y", "x", "j", "i"), spread(rows, "x", "y", "i", "j"), keys)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What can be among the nearest of each query; rows are sorted by q. Of a query with very many, those known so far
        go on and the ``k + 1`` best are kept to compare others with."""
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if b.num_rows:
                held.append(tuple(col(b, x).to_numpy() for x in ("q", "c", "s", "e")))
            if sum(len(h[0]) for h in held) > 200_000:
                q, c, s, e = (np.concatenate(x) for x in zip(*held))
                at = able(q, c, s, e, k + 1)
                q, c, s, e = q[at], c[at], s[at], e[at]
                stay = q == q[-1]
                if stay.sum() > 100_000:
                    yield from _candidates(("q", "c"), [(q, c)])
                    stay = np.flatnonzero(stay)[: k + 1]  # by falling lower bound
                else:
                    yield from _candidates(("q", "c"), [(q[~stay], c[~stay])])
                held = [(q[stay], c[stay], s[stay], e[stay])]
        if held:
            q, c, s, e = (np.concatenate(x) for x in zip(*held))
            at = able(q, c, s, e, k + 1)
            yield from _candidates(("q", "c"), [(q[at], c[at])])

    narrow = lambda found: found.repartition("q").sortWithinPartitions("q").mapInArrow(narrowed, "q long, c long")
    hits = stored(narrow(found), "ann-hits")
    discard(rows, asked, large)

    # ids of a class: a query needs at most k + 1 of each, copies of a row included
    few = ids.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("copies", F.least("copies", F.lit(k + 1)))
    for by in (["c", "part"], ["c"]):
        few = few.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    few = stored(few.select("c", "vec_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")), "ann-few")

    # queries without k neighbours meet all classes
    got = hits.join(few.groupBy("c").agg(F.count("*").alias("n")), "c").groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    short = stored(classes.where("asks").select("c", "v").join(got.select(F.col("q").alias("c")), "c", "left_anti"), "ann-short")
    m = short.count()
    if m:
        groups, parts = -(-m // block), -(-n // (16 * block))
        copies = lambda many: F.explode(F.sequence(zero, F.lit(many - 1)))

        def coded(side: DataFrame) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([col(b, "c"), pa.array(quantised(_unit(_matrix(col(b, "v"), dim))), pa.binary())], names=["c", "z"])

            return side.select("c", "v").mapInArrow(run, "c long, z binary")

        part = lambda many: F.pmod(F.xxhash64("c"), F.lit(many)).cast("int")
        all_rows = coded(classes).select(part(parts).alias("p"), copies(groups).alias("g"), "c", "z")
        all_asked = coded(short).select(copies(parts).alias("p"), part(groups).alias("g"), "c", "z")
        more = narrow(meet(all_asked, all_rows, ["p", "g"]))
        hits = hits.join(short.select(F.col("c").alias("q")), "q", "left_anti").unionByName(more)

    def ranked_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact cosines of a query (its own row, without c, comes first) with its candidates, each once."""
        x, length, before = None, 0.0, (None, None)
        for b in batches:
            if not b.num_rows:
                continue
            q, part, own, v = col(b, "q").to_numpy(), col(b, "part").to_numpy(), col(b, "c"), _matrix(col(b, "v"), dim)
            # a power of two: no digit is lost, and no square is too large or too small
            v = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])
            lengths = np.sqrt((v * v).sum(1))
            heads = own.is_null().to_numpy(zero_copy_only=False)
            c, s = pc.fill_null(own, -1).to_numpy(), np.zeros(b.num_rows)
            starts = np.concatenate([[True], (q[1:] != q[:-1]) | (part[1:] != part[:-1])])
            for i, j in _runs(np.cumsum(starts)):
                if heads[i]:
                    x, length = v[i], lengths[i]
                # one order of summation for every pair, so equal pairs score equally in any task
                s[i:j] = np.einsum("ij,j->i", v[i:j], x) / (lengths[i:j] * length)
            same = np.concatenate([[(q[0], c[0]) == before], (q[1:] == q[:-1]) & (c[1:] == c[:-1])])
            before = (q[-1], c[-1])
            at = pa.array(np.flatnonzero(~heads & ~same))
            yield pa.RecordBatch.from_arrays([col(b, "q").take(at), col(b, "part").take(at), own.take(at), col(b, "least").take(at), pa.array(s).take(at)], names=["q", "part", "c", "least", "score"])

    # a query with many candidates is ranked in several tasks
    many = stored(hits.groupBy("q").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1"), "ann-many")
    some, parts = bool(many.take(1)), F.coalesce("parts", F.lit(1))
    dealt = hits.join(many, "q", "left").withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")) if some else hits.withColumn("part", zero)
    pairs = dealt.join(classes.select("c", "v", "least"), "c").select("q", "part", "c", "least", "v")
    heads = classes.where("asks").select(F.col("c").alias("q"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("least"), "v")
    heads = heads.join(many, "q", "left").withColumn("part", F.explode(F.sequence(zero, parts - 1))) if some else heads.withColumn("part", zero)
    both = pairs.unionByName(heads.select(*pairs.columns)).repartition("q", "part").sortWithinPartitions("q", "part", F.col("c").asc_nulls_first())
    scored = both.mapInArrow(ranked_parts, "q long, part int, c long, least long, score double")
    top = scored
    for by in (["q", "part"], ["q"]):
        top = top.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "least", "c"))).where(F.col("r") <= k + 1)
    each = top.join(few, "c").select("q", "c", "vec_id", "nth", "score")
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "nth"))).where(F.col("r") <= k + 1)
    lists = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "c", "nth"))).alias("l"))
    mine = ids.where(F.col("vec_id") % every == 0).select(F.col("c").alias("q"), F.col("vec_id").alias("query_id"), "copies")
    own = mine.join(lists, "q").withColumn("l", F.slice(F.filter("l", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["c"] == F.col("q")) & (x["nth"] == 1))), 1, k))
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return own.select("query_id", F.posexplode("l").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    return zip(edge[:-1].tolist(), edge[1:].tolist())
