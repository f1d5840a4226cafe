"""Operator 1: benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. An item's
windows are its runs of ``window`` consecutive words (one shorter window if it has fewer). All
windows of all items stand in one automaton whose letters are word numbers. It is built in numpy, level by
level, and is three arrays: edges sorted by (state, word), where the edge's place is the child's number, failure links and
the nearest window that ends a state. A text is scanned once: a state depends on no more than ``window`` words, so
slices of text run through the automaton in lanes that start ``window`` - 1 words early. A hit's
words map to byte offsets of the original text by the words' own offsets.

Size: the driver reads the whole benchmark and each worker holds the automaton, at most 10 states of 16 bytes for
each of its words (measured: 151 bytes a word over 60,000 words; half a million words, about ten thousand
questions, are 76 MB). It grows with the benchmark only, never with the documents, and there is no switch at any size.
Words are compared by 64-bit hashes (BLAKE2 beyond 64 bytes).

Null or empty texts have no words: zero counts, no items. Items without words or without an id
are ignored. Repeated item_ids count once. Every row is scanned by itself: repeated rows and rows that share a doc_id
give one row each. Extra columns are not read, so clashing names do no harm.
Empty tables give no rows (documents) or no hits (benchmark). Texts of any length are scanned in blocks of words; of a long
text a task holds its bytes twice and 32 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandline.llm.common import class_words, col, prepare, ragged_ranges, slices, span_hashes, text_bytes

#: A-Z to a-z, the other ASCII characters that are not of a word to a space.
FOLD = np.array([32 if i < 48 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 127 else i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_SEP = FOLD == 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hash, row, start and end (in the buffer) of each word; and the rows' offsets in the buffer."""
    data, offs = text_bytes(texts)
    data = FOLD[data]
    starts, ends, row = class_words(data, offs, _SEP)
    return span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64), row, starts, ends, offs


class Automaton:
    """Aho-Corasick over word numbers. State 0 is the root, the child along edge i is state i + 1."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        rows = [(i, t) for i, t in items if i is not None and t]
        h, row, *_ = words_of(pa.array([t for _, t in rows], pa.string()))
        self.window = window
        self.names = np.array(sorted({i for i, _ in rows}), object)
        item = np.searchsorted(self.names, np.array([i for i, _ in rows], object)) if rows else np.zeros(0, np.int64)
        self.words, ids = np.unique(h, return_inverse=True)
        size = np.bincount(row, minlength=len(rows))
        many = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        start = ragged_ranges(np.cumsum(size) - size, many)
        length = np.repeat(np.minimum(size, window), many)
        owner = np.repeat(item, many)
        node = np.zeros(len(start), np.int64)
        edges, fails, depth = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        states = 1
        levels = []
        for d in range(window):
            on = np.flatnonzero(length > d)
            if not len(on):
                break
            key, inv = np.unique((node[on] << 32) | ids[start[on] + d], return_inverse=True)
            node[on] = states + inv
            edges.append(key)
            depth.append(np.full(len(key), d + 1))
            levels.append((states, key))
            states += len(key)
        self.edges, self.depth = np.concatenate(edges), np.concatenate(depth).astype(np.int8)
        self.fail = np.zeros(states, np.int32)
        self.out = np.zeros(states, np.int32)
        ends = np.zeros(states, bool)
        ends[node] = True
        ends[0] = False
        for d, (first, key) in enumerate(levels):
            own = first + np.arange(len(key))
            if d:
                self.fail[own] = self._next(self.fail[key >> 32], key & 0xFFFFFFFF)
            self.out[own] = np.where(ends[own], own, self.out[self.fail[own]])
        pairs = np.unique((node << 32) | owner) if len(node) else np.zeros(0, np.int64)
        self.pair_state, self.pair_item = pairs >> 32, pairs & 0xFFFFFFFF

    def _next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where each state goes by its word: along failure links until an edge fits, or to the root."""
        out = np.zeros(len(state), np.int64)
        open_, s, w = np.arange(len(state)), state.astype(np.int64), word
        while len(open_):
            key = (s << 32) | w
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[open_[hit]] = at[hit] + 1
            more = ~hit & (s > 0)
            open_, s, w = open_[more], self.fail[s[more]].astype(np.int64), w[more]
        return out

    def scan(self, h: np.ndarray, row: np.ndarray, lane: int = 128, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over the words of several texts: hit words as a mask, then each text's row and item of every
        occurring item (once). ``block`` words at a time, behind the few before them that a window may begin with."""
        none = np.zeros(0, np.int64)
        hit = np.zeros(len(h) + 1, np.int32)
        seen = none
        for a in range(0, len(h) if len(self.edges) else 0, block):
            low = max(0, a - self.window + 1)
            last, ended = self._found(h[low : a + block], row[low : a + block], lane)
            own = last + low >= a
            last, ended = last[own] + low, ended[own]
            np.add.at(hit, last - self.depth[ended] + 1, 1)
            np.add.at(hit, last + 1, -1)
            seen = np.unique(np.concatenate([seen, (row[last] << 32) | ended]))
        text, ended = seen >> 32, seen & 0xFFFFFFFF
        a, b = np.searchsorted(self.pair_state, ended, "left"), np.searchsorted(self.pair_state, ended, "right")
        item = self.pair_item[ragged_ranges(a, b - a)]
        both = np.unique((np.repeat(text, b - a) << 32) | item) if len(item) else none
        return np.cumsum(hit)[:-1] > 0, both >> 32, both & 0xFFFFFFFF

    def _found(self, h: np.ndarray, row: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end, and in which state."""
        none = np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ids = np.where(self.words[at] == h, at, -1)
        # a gap between texts leads back to the root
        gap = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
        place = np.arange(len(h)) + gap
        early = self.window - 1
        lanes = -(-(int(place[-1]) + 1) // lane)
        seq = np.full(early + lanes * lane, -1, np.int64)
        seq[early + place] = ids
        origin = np.zeros(len(seq), np.int64)
        origin[early + place] = np.arange(len(h))
        base = np.arange(lanes) * lane
        state = np.zeros(lanes, np.int64)
        where, what = [none], [none]
        for t in range(early + lane):
            w = seq[base + t]
            known = np.flatnonzero(w >= 0)
            after = np.zeros(lanes, np.int64)
            after[known] = self._next(state[known], w[known])
            state = after
            if t < early:
                continue
            found = np.flatnonzero(self.out[state])
            s = self.out[state[found]].astype(np.int64)
            while len(found):
                where.append(origin[base[found] + t])
                what.append(s)
                s = self.out[self.fail[s]].astype(np.int64)
                found, s = found[s > 0], s[s > 0]
        return np.concatenate(where), np.concatenate(what)


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long,word:long,n_words:long>>, item_ids array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())]))


def automaton(benchmark: DataFrame, window: int = 10) -> Automaton:
    """Of every item of ``benchmark`` (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return Automaton(((r[0], r[1]) for r in items.toLocalIterator()), window)


def annotate(docs: DataFrame, benchmark: DataFrame, into: str, window: int = 10) -> DataFrame:
    """Every column and row of ``docs``, and the number of hit words as column ``into``, which must
    not be there yet."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {into} already: name another one")
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(automaton(benchmark, window))
    schema = StructType([*docs.schema.fields, StructField(into, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, row, *_ = words_of(col(b, "text"))
            n = np.bincount(row[sent.value.scan(h, row)[0]], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, into])

    return docs.mapInArrow(run, schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans of hit words (byte offsets in the original UTF-8
    text, first word and number of words), item_ids in ascending order."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(automaton(benchmark, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for b in slices(batches):
            h, row, starts, ends, offs = words_of(col(b, "text"))
            mask, texts, found = auto.scan(h, row)
            n = np.bincount(row, minlength=b.num_rows)
            first = np.cumsum(n) - n
            # runs of hit words, which end with their text
            edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
            heads = np.flatnonzero(mask & (~before | edge))
            stop = np.append(~mask[1:] | edge[1:], True) if len(mask) else mask
            tails = np.flatnonzero(mask & stop)
            own = row[heads]
            spans = pa.StructArray.from_arrays(
                [pa.array(starts[heads] - offs[own]), pa.array(ends[tails] - offs[own]), pa.array(heads - first[own]), pa.array(tails - heads + 1)], fields=list(_SPANS.value_type)
            )
            names = pa.array(auto.names[found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    col(b, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(_ends(own, b.num_rows), spans, type=_SPANS),
                    pa.ListArray.from_arrays(_ends(texts, b.num_rows), names),
                ],
                names=["doc_id", "n_words", "spans", "item_ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _ends(row: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32))
