"""Operator 2: removal of long byte strings that occur earlier, by sharded suffix arrays.

Every byte covered by a ``size``-byte string that also starts earlier (smaller doc_id, or the same document
and an earlier start) is removed; strings never cross documents and are judged on the input.

1. Anchors. A string of ``size`` bytes (a window) is represented by the position of its smallest
   ``GRAM``-byte hash (leftmost of equals). Equal windows have equal anchors at equal places, so only
   text around an anchor whose hash occurs twice or more can be repeated. Counting hashes is one
   aggregation; the rest of the text is left out of all that follows.
2. Shards. A shard is about one megabyte of text as it lies in its partition (pieces of long documents
   overlap by ``size`` - 1 bytes). Its suffix array is dense over the text that is left: suffixes are sorted by
   eight bytes, then groups still unsorted are refined by the ranks behind them, doubling the depth
   (Larsson-Sadakane). Kasai's scan gives the common prefixes; it runs in lanes, eight bytes at a time.
   Windows of one shard that share ``size`` bytes are settled there, and only the first of them goes on.
3. Across shards the anchored suffixes of all shards meet by anchor hash, with the bytes their windows reach,
   at most ``hot`` of one hash. They come in sorted runs, which are merged by binary search
   into two suffix orders, rightwards from the anchor and leftwards. Neighbours' common prefixes give, for any
   depth, the class of an anchor as a running sum; a window is the pair of its left and right class, and all
   but the first of a class are covered. Equal contexts are settled at once before that.
4. An anchor hash that occurs more than ``hot`` times (a line that many documents share) would be one task. Its
   windows, those left by step 2, go on by 128-bit fingerprints instead: Spark takes the first of each
   by a map-side aggregation, and any number of tasks shares the work.
5. Covered runs return to their documents, which are cut in one pass.

Null and empty texts have nothing to remove. Rows without doc_id are returned untouched. Rows with
the same doc_id and text are one document: they get the same result and never remove each other.
Different texts under one doc_id are different documents in the order of a hash of their text. Extra columns are not read.
An empty table gives no rows. Of equal strings, and of documents that tie by doc_id, the first in that order stays. A long text is
cut by the same spans as any other, within one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import col, discard, mix64, prepare, ragged_ranges, slices, stored, text_bytes

GRAM = 32
_B = [pow(0x9E3779B97F4A7C15 | 1, 1 << i, 1 << 64) for i in range(6)]


#: Positions worked on together, so that what stands between two steps stays in the processor's cache.
BLOCK = 1 << 14


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position: of four numbers of eight bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data, np.uint8), strides=(1,))
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        x = eight[a : min(a + BLOCK, n) + GRAM - 8].copy()
        x = x[:-8] * np.uint64(_B[3]) + x[8:]
        out[a : a + BLOCK] = mix64(x[:-16] * np.uint64(_B[4]) + x[16:])
    return out


def _lowest(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of the ``w`` hashes from each position."""
    n = len(h) - w + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        low, span = h[a : min(a + BLOCK, n) + w - 1], 1
        while 2 * span <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        m = min(BLOCK, n - a)
        out[a : a + m] = np.minimum(low[:m], low[w - span : w - span + m])
    return out


def anchors(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window start, number of windows, hash) of every anchor; positions
    are in the buffer, windows lie inside documents."""
    h = gram_hashes(data)
    w = size - GRAM + 1
    n = len(h) - w + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    low = _lowest(h, w)
    inside = np.ones(n, bool)
    tails = np.maximum(offs[:-1], offs[1:] - size + 1)  # windows from here on leave their document
    out = ragged_ranges(tails, offs[1:] - tails)
    inside[out[out < n]] = False
    # the leftmost place of the minimum stays until the start passes it or a smaller hash enters
    head = inside.copy()
    head[1:] &= (low[1:] != low[:-1]) | (h[: n - 1] == low[:-1]) | ~inside[:-1]
    start = np.flatnonzero(head)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    pos = start + w - 1
    pos = np.where(h[start] == low[start], start, pos)
    seek = np.flatnonzero((h[start] != low[start]) & ((start == 0) | (low[start] >= low[start - 1])))
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    for a in range(0, len(seek), 1 << 12):
        at = seek[a : a + (1 << 12)]
        pos[at] = start[at] + np.argmin(windows[start[at]], 1)
    before = np.cumsum(inside)
    count = np.diff(np.append(before[start] - 1, before[-1]))
    return pos, start, count, h[pos]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first bytes, the number of those bytes (``depth`` or more), each suffix's
    group of equals and the eight bytes from each position."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys = (keys << np.uint64(8)) | wide[i : i + n]
    order = np.argsort(keys)
    head = np.ones(n + 1, bool)
    head[1:n] = keys[order[1:]] != keys[order[:-1]]
    h = 8
    while h < depth:
        h *= 2
    rank = np.full(n + h, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    sorted_ = 8
    while sorted_ < h:
        at = np.flatnonzero(~(head[:n] & head[1:]))  # places of groups that are still unsorted
        p = order[at]
        key = rank[p] * (n + 1) + rank[p + sorted_] + 1
        s = np.argsort(key)
        order[at] = p[s]
        key = key[s]
        head[at[1:]] |= key[1:] != key[:-1]
        if len(at):
            rank[order[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
        sorted_ *= 2
    return order, rank[:n], keys, h


_BYTES = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)


def common_prefixes(order: np.ndarray, rank: np.ndarray, keys: np.ndarray, depth: int, lane: int = 64) -> np.ndarray:
    """Kasai's scan: bytes that each suffix of ``order`` shares with the one before it; ``depth`` stands for
    that many or more (suffixes of one group, whose mutual order says nothing). Positions are scanned
    in lanes of ``lane``, each carrying its prefix less one to the next position."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([keys, np.zeros(depth + 8, np.uint64)])
    found = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for t in range(lane):
        if len(starts) and starts[-1] + t >= n:
            starts, h = starts[:-1], h[:-1]
        if not len(starts):
            break
        p = starts + t
        q = before[p]
        h = np.where((q < 0) | (h >= depth), 0, np.maximum(h - 1, 0))
        h[(q >= 0) & (rank[p] == rank[q])] = depth
        live = np.flatnonzero((q >= 0) & (h < depth))
        while len(live):
            x = padded[p[live] + h[live]] ^ padded[q[live] + h[live]]
            h[live] += 8 - np.searchsorted(_BYTES, x, "right") - (x > 0)
            live = live[(x == 0) & (h[live] < depth)]
        found[p] = h
    return found[order]


def repeated_here(text: np.ndarray, windows: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """Whether each window (its start in ``text``, ascending) equals one of smaller ``rank``."""
    out = np.zeros(len(windows), bool)
    if len(windows) < 2:
        return out
    order, *rest = suffix_array(text, size)
    shared = common_prefixes(order, *rest)
    number = np.full(len(text), -1, np.int64)
    number[windows] = np.arange(len(windows))
    group = np.cumsum(shared < size)
    own = number[order]
    group, own = group[own >= 0], own[own >= 0]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.repeat(np.minimum.reduceat(rank[own], heads), np.diff(np.append(heads, len(own))))
    out[own] = rank[own] > first
    return out


def merged(keys: np.ndarray, run: int = 4096) -> np.ndarray:
    """Order of ``keys`` (byte strings of one width): sorted runs, merged in pairs by binary search of each
    run's keys in the other."""
    runs = [a + np.argsort(keys[a : a + run], kind="stable") for a in range(0, len(keys), run)]
    while len(runs) > 1:
        after = []
        for x, y in zip(runs[::2], runs[1::2]):
            out = np.empty(len(x) + len(y), np.int64)
            out[np.arange(len(x)) + np.searchsorted(keys[y], keys[x], "left")] = x
            out[np.arange(len(y)) + np.searchsorted(keys[x], keys[y], "right")] = y
            after.append(out)
        runs = after + ([runs[-1]] if len(runs) % 2 else [])
    return runs[0] if runs else np.zeros(0, np.int64)


def _sides(hash_: np.ndarray, place: np.ndarray, text: np.ndarray, base: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchored suffixes as rows of bytes: anchor hash, the bytes to the right (to the left, going
    leftwards), zeros, and their number plus one."""
    n = len(hash_)

    def side(first: np.ndarray, have: np.ndarray, step: int, most: int) -> np.ndarray:
        m = np.zeros((n, 8 + most + 1), np.uint8)
        m[:, :8] = hash_.astype(">u8")[:, None].view(np.uint8)
        r = np.repeat(np.arange(n), have)
        c = np.arange(len(r)) - np.repeat(np.cumsum(have) - have, have)
        m[r, 8 + c] = text[first[r] + step * c]
        m[:, -1] = have + 1
        return m

    return side(base + place, length - place, 1, size), side(base + place - 1, place, -1, size - GRAM)


def _ordered(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, bytes each shares with the one before it in that order; -1 for another anchor)."""
    order = merged(np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel())
    a, b = m[order[1:]], m[order[:-1]]
    differ = a[:, :-1] != b[:, :-1]
    shared = np.where(differ.any(1), np.argmax(differ, 1), m.shape[1] - 1)
    shared = np.minimum(shared - 8, np.minimum(a[:, -1], b[:, -1]).astype(np.int64) - 1)
    return order, np.concatenate([[-1], np.where(shared < 0, -1, shared)]) if len(m) else np.zeros(0, np.int64)


def settle(k: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, place: np.ndarray, text: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Covered runs (doc, tag, start, end) among anchored contexts. A row: anchor hash, document, its
    tag, start of its first window, anchor's place in the context, and the context's end in ``text``."""
    base = np.concatenate([[0], ends[:-1]])
    length = ends - base
    by = np.lexsort((start, tag, doc))
    k, doc, tag, start, place, base, length = (x[by] for x in (k, doc, tag, start, place, base, length))
    at = start + place
    ident = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1])])) if len(k) else np.zeros(0, np.int64)
    right, left = _sides(k, place, text, base, length, size)
    # equal contexts: all but the first are covered from end to end
    whole = np.concatenate([right, left], 1)
    _, first, same = np.unique(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    later = np.flatnonzero(ident != ident[first[same]])
    out = [(later, start[later], start[later] + length[later])]
    reps = np.sort(first)
    n, count = len(reps), length[reps] - size + 1
    place_, start_ = place[reps], start[reps]
    (ro, rl), (lo, ll) = _ordered(right[reps]), _ordered(left[reps])

    def placed(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        return where, np.maximum(shared, np.append(shared[1:], -1))[where]

    (rw, rmax), (lw, lmax) = placed(ro, rl), placed(lo, ll)
    low, high = np.maximum(np.maximum(size - rmax, place_ - count + 1), 0), np.minimum(lmax, place_)
    some = np.flatnonzero((low <= high) & (rmax >= GRAM))
    for o in range(size - GRAM + 1):  # windows whose anchor stands o bytes in
        own = some[(low[some] <= o) & (o <= high[some])]
        if len(own) < 2:
            continue
        key = np.cumsum(rl < size - o)[rw[own]] * (n + 1) + np.cumsum(ll < o)[lw[own]]
        order = np.argsort(key, kind="stable")  # rows are in the order of documents and starts
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lead = np.repeat(order[heads], np.diff(np.append(heads, len(key))))
        hit = own[order[ident[reps[own[order]]] != ident[reps[own[lead]]]]]
        s = start_[hit] + place_[hit] - o
        out.append((reps[hit], s, s + size))
    row, s, e = (np.concatenate(x) for x in zip(*out))
    return united(doc[row], tag[row], s, e)


def united(doc: np.ndarray, tag: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining runs of a document become one."""
    if not len(s):
        return doc, tag, s, e
    by = np.lexsort((s, tag, doc))
    doc, tag, s, e = doc[by], tag[by], s[by], e[by]
    owner = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    lift = np.cumsum(owner) * (int(e.max()) + 2)  # runs of different documents never touch
    reach = np.maximum.accumulate(e + lift)
    new = np.concatenate([[True], (s + lift)[1:] > reach[:-1]])
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:], len(s)) - 1
    return doc[heads], tag[heads], s[heads], (reach - lift)[lasts]


def pieces(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, row and first byte of each piece): shards of about ``most`` bytes. A longer text comes
    in several, which overlap by ``size`` - 1 bytes, so each window stands in just one."""
    for b in slices(batches, most=most):
        data, offs = text_bytes(col(b, "text"))
        if b.num_rows > 1 or len(data) <= 2 * most:
            yield b, data, offs, np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            continue
        for a in range(0, len(data) - size + 1, most):
            part = data[a : a + most + size - 1]
            yield b, part, np.array([0, len(part)]), np.zeros(1, np.int64), np.array([a])


def _fingerprints(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the ``size`` bytes from each start."""
    out = []
    for seed in (1, 2):
        mixed = mix64(data.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        h = np.zeros(len(starts), np.uint64)
        for i in range(size):
            h = h * np.uint64((0x5851F42D4C957F2D, 0xD1342543DE82EF95)[seed - 1]) + mixed[starts + i]
        out.append(mix64(h).view(np.int64))
    return out[0], out[1]


SENT = "k long, doc_id long, tag long, s long, e long, place int, ctx binary, w1 long, w2 long"


def remove_repeats(docs: DataFrame, size: int = 100, hot: int = 10_000, shard: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining text's bytes)."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    sound = base.where("doc_id is not null and text is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs, row, _ in pieces(batches, size, shard):
            pos, _, _, h = anchors(data, offs, size)
            d = row[np.searchsorted(offs, pos, "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), col(b, "doc_id").take(pa.array(d))], names=["k", "doc_id"])

    rows = stored(sound.mapInArrow(emit, "k long, doc_id long"), "sfx-anchors")
    again = stored(rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", (F.col("c") > hot).alias("hot")), "sfx-keys")
    # about 35 bytes of text an anchor: tasks of the same size whatever the input
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * 35 // (32 << 20))
    wanted = stored(rows.join(again, "k").groupBy("doc_id").agg(F.collect_set("k").alias("ks"), F.collect_set(F.when(F.col("hot"), F.col("k"))).alias("hs")), "sfx-wanted")
    discard(rows, again)

    def member(h: np.ndarray, lists: pa.Array) -> np.ndarray:
        own = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
        own = np.sort(own)
        return own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h if len(own) else np.zeros(len(h), bool)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(n: int, **cols) -> pa.RecordBatch:
            names = [c.split()[0] for c in SENT.split(", ")]
            kinds = {"place": pa.int32(), "ctx": pa.binary()}
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

        for b, data, offs, row, first in pieces(batches, size, shard):
            pos, start, count, h = anchors(data, offs, size)
            sel = np.flatnonzero(member(h, col(b, "ks")))
            if not len(sel):
                continue
            pos, start, count, h = pos[sel], start[sel], count[sel], h[sel]
            piece = np.searchsorted(offs, pos, "right") - 1
            # the shard's text: what the windows reach, parted by a byte that UTF-8 never has
            reach = np.zeros(len(data) + 1, np.int32)
            np.add.at(reach, start, 1)
            np.add.at(reach, start + count + size - 1, -1)
            inside = np.cumsum(reach)[:-1] > 0
            inside_at = np.flatnonzero(inside)
            broken = (np.diff(inside_at) > 1) | (np.searchsorted(offs, inside_at[1:], "right") != np.searchsorted(offs, inside_at[:-1], "right"))
            place = np.arange(len(inside_at)) + np.concatenate([[0], np.cumsum(broken)])
            text = np.full(int(place[-1]) + 1, 255, np.uint8)
            text[place] = data[inside_at]
            to = np.zeros(len(data), np.int64)
            to[inside_at] = place
            windows = ragged_ranges(start, count)
            names, tags = (col(b, c).to_numpy()[row] for c in ("doc_id", "tag"))
            by = np.lexsort((first, tags, names))
            fresh = np.concatenate([[True], (names[by][1:] != names[by][:-1]) | (tags[by][1:] != tags[by][:-1])])
            level = np.empty(len(by), np.int64)
            level[by] = np.cumsum(fresh)  # equal for repeated rows
            own = np.repeat(piece, count)
            gone = repeated_here(text, to[windows], (level[own] << 40) + windows - offs[own], size)
            if gone.any():
                i = own[gone]
                d, t, s, e = united(names[i], tags[i], windows[gone] - offs[i] + first[i], windows[gone] - offs[i] + first[i] + size)
                yield out(len(d), doc_id=pa.array(d), tag=pa.array(t), s=pa.array(s), e=pa.array(e))
            heads = np.cumsum(count) - count
            left = np.add.reduceat(~gone, heads) > 0
            often = member(h, col(b, "hs"))
            w = np.flatnonzero(np.repeat(often & left, count) & ~gone)
            for at in range(0, len(w), 50_000):
                x = w[at : at + 50_000]
                i, p = own[x], windows[x]
                w1, w2 = _fingerprints(data, p, size)
                yield out(len(x), doc_id=pa.array(names[i]), tag=pa.array(tags[i]), s=pa.array(p - offs[i] + first[i]), w1=pa.array(w1), w2=pa.array(w2))
            keep = np.flatnonzero(left & ~often)
            for at in range(0, len(keep), 20_000):
                x = keep[at : at + 20_000]
                i, m = piece[x], count[x] + size - 1
                ctx = data[ragged_ranges(start[x], m)]
                cuts = np.concatenate([[0], np.cumsum(m)]).astype(np.int32)
                yield out(
                    len(x), k=pa.array(h[x].view(np.int64)), doc_id=pa.array(names[i]), tag=pa.array(tags[i]), s=pa.array(start[x] - offs[i] + first[i]),
                    place=pa.array((pos[x] - start[x]).astype(np.int32)), ctx=pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(cuts), pa.py_buffer(ctx)]),
                )

    sent = stored(sound.join(wanted, "doc_id").select("doc_id", "tag", "text", "ks", "hs").mapInArrow(contexts, SENT), "sfx-contexts")
    discard(wanted)

    def meet(batches: Iterator[pa.RecordBatch], most: int = 30_000) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(t: pa.Table) -> pa.RecordBatch:
            k, doc, tag, start, place = (t[c].to_numpy().astype(np.int64) for c in ("k", "doc_id", "tag", "s", "place"))
            text, offs = text_bytes(t["ctx"])
            found = settle(k, doc, tag, start, place, text, offs[1:], size)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc_id", "tag", "s", "e"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= most:
                t = pa.Table.from_batches(held)
                k = t["k"].to_numpy()
                cut = int(np.searchsorted(k, k[-1], "left"))  # rows are in the order of k
                if cut:
                    yield close(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield close(t)

    runs = sent.where("k is not null").select("k", "doc_id", "tag", "s", "place", "ctx").repartition(parts, "k").sortWithinPartitions("k").mapInArrow(meet, "doc_id long, tag long, s long, e long")
    here = F.struct("doc_id", "tag", "s")
    shown = sent.where("w1 is not null").select("w1", "w2", "doc_id", "tag", "s")
    lead = shown.groupBy("w1", "w2").agg(F.min(here).alias("lead"))
    late = shown.join(lead, ["w1", "w2"]).where(here > F.col("lead")).select("doc_id", "tag", "s", (F.col("s") + size).alias("e"))
    runs = runs.unionByName(late).unionByName(sent.where("e is not null").select("doc_id", "tag", "s", "e"))
    runs = stored(runs.groupBy("doc_id", "tag").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e")), "sfx-runs")
    discard(sent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offs = text_bytes(col(b, "text"))
            removed, spans, kept = [], [], []
            for i, (s, e) in enumerate(zip(col(b, "s").to_pylist(), col(b, "e").to_pylist())):
                own = data[offs[i] : offs[i + 1]]
                if not s:
                    removed.append(0)
                    spans.append(0)
                    kept.append(own.tobytes())
                    continue
                mark = np.zeros(len(own) + 1, np.int64)
                np.add.at(mark, s, 1)
                np.add.at(mark, e, -1)
                gone = np.cumsum(mark)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return base.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "s", "e").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
