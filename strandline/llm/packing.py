"""Operator 10: packing documents into sequences of at most ``capacity`` tokens.

Lengths are small integers, so packing works on the histogram of piece lengths (at most
``capacity`` counts, whatever the corpus size) and not on single documents:

1. Every text is encoded where it is read; documents longer than the capacity are cut into
   pieces of exactly the capacity. Each piece gets a running number among the pieces of its
   length in its partition.
2. The driver solves the histogram by bin completion: around the largest length left it
   enumerates fillings of the rest that no swap dominates (Martello-Toth dominance: a filling is dropped if
   one or two of its items can give way to a longer one), tries the least waste first, and
   repeats the filling as often as the counts allow. The best-fit-decreasing packing is the first
   incumbent; a branch is cut when the L2 bound of the rest, or its waste so far, cannot beat
   the incumbent. ``max_nodes`` bounds the search, after which the incumbent stands.
3. The solution is a list of runs (filling, times). A piece's number within its length, counted
   over all partitions, finds its run, sequence and offset by binary search.

Null text is an empty document (the end id alone); empty tables give no rows; repeated rows are
packed as often as they occur; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import col, prepare, slices, stored
from strandline.llm.tokens import ENCODED_BYTES, encoder, with_end

Run = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), times


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit over the histogram: each filling takes the longest length that still fits."""
    left = {k: v for k, v in counts.items() if v}
    order = sorted(left, reverse=True)
    runs: list[Run] = []
    while order:
        room, filling, at = capacity, {}, 0
        while at < len(order):
            k = order[at]
            if k <= room and (n := min(room // k, left[k] - filling.get(k, 0))) > 0:
                filling[k] = n
                room -= n * k
            at += 1
            if not room:
                break
        times = min(left[k] // n for k, n in filling.items())
        runs.append((tuple(filling.items()), times))
        for k, n in filling.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return runs


def fillings(room: int, left: dict[int, int], most_waste: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, filling) of ``room`` by lengths of ``left``, least waste first, up to ``most_waste``: all but those
    dominated by a swap of one length, or of two for one, for a longer one that is left and still fits.

    Bit i of a mask says whether the lengths from some place on can sum up to i, so the enumeration
    enters no dead end.
    """
    lengths = sorted((k for k, v in left.items() if v and k <= room), reverse=True)
    masks = [1] * (len(lengths) + 1)
    whole = (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        k, m, n, step = lengths[i], masks[i + 1], min(left[lengths[i]], room // lengths[i]), 1
        while n:  # n copies by powers of two
            c = min(step, n)
            m |= (m << (c * k)) & whole
            n -= c
            step *= 2
        masks[i] = m

    def go(i: int, rest: int, took: tuple[tuple[int, int], ...]) -> Iterator[tuple[tuple[int, int], ...]]:
        while rest:
            while lengths[i] > rest or not masks[i] >> rest & 1:
                i += 1
            k = lengths[i]
            for n in range(min(left[k], rest // k), 0, -1):
                if masks[i + 1] >> (rest - n * k) & 1:
                    yield from go(i + 1, rest - n * k, (*took, (k, n)))
            if not masks[i + 1] >> rest & 1:
                return
            i += 1
        yield took

    def dominated(took: tuple[tuple[int, int], ...], slack: int) -> bool:
        used = dict(took)
        free = lambda a, b: any(left.get(j, 0) > used.get(j, 0) for j in range(a, min(b, room) + 1))
        if slack and any(free(k + 1, k + slack) for k in used):
            return True
        items = sorted(used)
        return any(free(a + b, a + b + slack) for x, a in enumerate(items) for b in items[x:] if a != b or used[a] > 1)

    for waste in range(min(room, most_waste) + 1):
        if masks[0] >> (room - waste) & 1:
            for took in go(0, room - waste, ()):
                if not dominated(took, waste):
                    yield waste, took


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello-Toth's L2: for every threshold k, items over capacity - k stand alone, those over
    half take a sequence each, and the rest from k on must fit what these leave or need more."""
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    mass = n * np.arange(capacity + 2)
    cn, cm = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(mass)])
    half = capacity // 2
    k = np.arange(half + 1)
    alone = cn[-1] - cn[capacity - k + 1]
    pairs, weight = cn[capacity - k + 1] - cn[half + 1], cm[capacity - k + 1] - cm[half + 1]
    need = np.maximum(0, -(-(cm[half + 1] - cm[k] - (pairs * capacity - weight)) // capacity))
    return int(max(-(-int(mass.sum()) // capacity), (alone + pairs + need).max()))


def pack_histogram(counts: dict[int, int], capacity: int, max_nodes: int = 4000, back: int = 32) -> list[Run]:
    """Bin completion branch and bound with the best-fit packing as incumbent.

    A node fills the sequence of the largest length left, as often as the counts allow, with its fillings in the
    order of waste. It is cut when the sequences so far and the L2 bound of the rest reach the incumbent, and
    it stops asking for fillings when their waste is more than a better packing can have. After a first dive the
    search goes back and forth over the last ``back`` fillings (only those are held, which bounds its memory); where
    it is through with them, or has turned 100 times, it starts again with the second filling at another depth.
    """
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    best = best_fit_decreasing(counts, capacity)
    size, bound = sum(t for _, t in best), lower_bound(counts, capacity) if counts else 0
    nodes = max_nodes

    def dive(skip: int, effort: int) -> None:
        """Depth first from the root; the filling at depth ``skip`` is the second one."""
        nonlocal best, size, nodes
        runs: list[Run] = []
        turned = 0
        # one entry a depth: what is left, sequences so far, waste so far, fillings still to try
        stack = [(dict(counts), 0, 0, None)]
        while stack and nodes > 0 and effort > 0 and size > bound:
            left, bins, waste, options = stack[-1]
            if options is None:
                nodes -= 1
                effort -= turned
                if not left:
                    if bins < size:
                        best, size = list(runs), bins
                    options = iter(())
                elif bins + lower_bound(left, capacity) >= size:
                    options = iter(())
                else:
                    top = max(left)
                    rest = dict(left)
                    rest[top] -= 1
                    options = fillings(capacity - top, rest, (size - 1) * capacity - total - waste)
                    if len(stack) - 1 == skip:
                        next(options, None)
                stack[-1] = (left, bins, waste, options)
            found = next(options, None)
            if found is None:
                turned = 1  # the way down is free, going back and forth is not
                stack.pop()
                if runs:
                    runs.pop()
                continue
            lost, filling = found
            take = dict(filling)
            top = max(left)
            take[top] = take.get(top, 0) + 1
            # a filling is repeated as long as better packings can afford its waste
            times = min(left[k] // n for k, n in take.items())
            if lost:
                times = max(1, min(times, ((size - 1) * capacity - total - waste) // lost))
            after = dict(left)
            for k, n in take.items():
                after[k] -= n * times
                if not after[k]:
                    del after[k]
            runs.append((tuple(sorted(take.items(), reverse=True)), times))
            stack.append((after, bins + times, waste + lost * times, None))
            if len(stack) > back:
                stack[-1 - back] = ({}, 0, 0, iter(()))  # not gone back to

    skip = -1
    while nodes > 0 and size > bound:
        before = nodes
        dive(skip, 100)
        skip += 1
        if nodes > before - 2:  # no such depth
            break
    return best


class Plan:
    """Runs turned into arrays: piece number within a length -> sequence and offset."""

    def __init__(self, runs: list[Run]):
        base = 0
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        for filling, times in runs:
            offset = 0
            for k, n in filling:
                first = seen.get(k, 0)
                rows.setdefault(k, []).append((first, base, offset, n, times))
                seen[k] = first + n * times
                offset += k * n
            base += times
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}
        self.sequences = base

    def place(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.rows[length]
        r = t[np.searchsorted(t[:, 0], number, "right") - 1]
        inner = number - r[:, 0]
        return r[:, 1] + inner // r[:, 3], r[:, 2] + (inner % r[:, 3]) * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Encoded documents as pieces, each numbered within its length and partition."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches, most=ENCODED_BYTES):
            ids, offs = with_end(*encoder(tokenizer).encode(col(b, "text")), end_id)
            n = np.diff(offs)
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            flat = ids.astype("<u4")
            a = offs[doc] + start
            crc = [zlib.crc32(flat[i : i + m]) for i, m in zip(a, length)]
            order = np.argsort(length, kind="stable")
            s = length[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            nth = np.empty(len(s), np.int64)
            nth[order] = np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [col(b, "doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, max_nodes: int = 4000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    # at most ``capacity`` rows come to the driver: one count per length
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = Plan(pack_histogram(counts, capacity, max_nodes))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    sent = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, see Plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            length, number = (col(b, c).to_numpy() for c in ("length", "number"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for g in np.split(order, cuts):
                seq[g], off[g] = p.place(int(length[g[0]]), number[g])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
