"""Operator 3: document quality by histogram gradient-boosted trees.

``features`` measures each whole text with byte and word statistics only. ``fit`` bins each
statistic by quantiles and boosts depth-limited trees on the logistic loss from bin histograms of
gradients. Trees are flattened into arrays (one row per tree, children of node i at 2i+1 and 2i+2)
and ``score`` walks all rows through all trees with array indexing.

Null and empty texts have all-zero statistics and get the score of such a row. Without labels
every score is 0.5; with one class only, the smoothed share of that class. Repeated rows are
scored alike; extra columns are not read. Empty tables give no rows. Of equally good splits the first feature and
lowest threshold stand. Of a long text a task holds its bytes and about 80 bytes a word, the rest in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import class_words, col, counts_before, fold, labelled_sample, per_doc, prepare, slices, span_hashes, text_bytes

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _flags(chars: bytes) -> np.ndarray:
    f = np.zeros(256, bool)
    f[list(chars)] = True
    return f


_UPPER, _LOWER, _DIGIT = (_flags(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_STOPS, _MARKS = _flags(b".,;:'\"?-()"), _flags(b"!#$%&*+/<=>@[\\]^_`{|}~")
NAMES = [
    "log_bytes", "upper", "lower", "digit", "high", "stops", "marks", "bang", "bar", "space", "newline", "words_log", "word_len",
    "word_len_spread", "same_as_before", "distinct", "distinct_pairs", "caps_words", "marked_words", "long_words", "lines_log",
    "same_lines", "line_words", "one_word_lines",
]


def features(texts: pa.Array) -> np.ndarray:
    data, offs = text_bytes(texts)
    docs = len(offs) - 1
    out = np.zeros((docs, len(NAMES)))
    size = np.diff(offs)
    if not len(data):
        return out
    whole = np.maximum(size, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.diff(counts_before(flag, data, offs)) / whole

    high = np.arange(256) >= 128
    out[:, 0] = np.log1p(size)
    for k, f in enumerate((_UPPER, _LOWER, _DIGIT, high, _STOPS, _MARKS, _flags(b"!"), _flags(b"|"), _SEP, _LINE)):
        out[:, 1 + k] = share(f)
    starts, ends, doc = class_words(data, offs, _SEP)
    n = np.bincount(doc, minlength=docs)
    some = np.maximum(n, 1)
    length = (ends - starts).astype(float)
    h = span_hashes(data, starts, ends)
    mean = per_doc(length, doc, docs) / some
    out[:, 11] = np.log1p(n)
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(per_doc(length**2, doc, docs) / some - mean**2, 0))
    if len(h):
        joined = doc[1:] == doc[:-1]
        out[:, 14] = per_doc(((h[1:] == h[:-1]) & joined).astype(float), doc[1:], docs) / some

        def distinct(key: np.ndarray, own: np.ndarray) -> np.ndarray:
            if docs == 1:  # a text as long as its slice: one sort
                return np.array([len(np.unique(key)) / max(len(key), 1)])
            order = np.lexsort((key, own))
            k, o = key[order], own[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])[: len(k)]
            return np.bincount(o[new], minlength=docs) / np.maximum(np.bincount(own, minlength=docs), 1)

        out[:, 15] = distinct(h, doc)
        pair = (h[:-1] * np.uint64(31) + h[1:])[joined]
        out[:, 16] = distinct(pair, doc[1:][joined]) if len(pair) else 0
        held = lambda flag: counts_before(flag, data, ends) - counts_before(flag, data, starts)
        out[:, 17] = per_doc(((held(_UPPER) > 1) & (held(_LOWER) == 0)).astype(float), doc, docs) / some
        out[:, 18] = per_doc((held(_MARKS) > 0).astype(float), doc, docs) / some
        out[:, 19] = per_doc((length > 20).astype(float), doc, docs) / some
    ls, le, ld = class_words(data, offs, _LINE)
    ln = np.bincount(ld, minlength=docs)
    lots = np.maximum(ln, 1)
    out[:, 20] = np.log1p(ln)
    if len(ls):
        lh = span_hashes(data, ls, le)
        order = np.lexsort((lh, ld))
        same = np.concatenate([[False], (lh[order][1:] == lh[order][:-1]) & (ld[order][1:] == ld[order][:-1])])
        out[:, 21] = per_doc(same.astype(float), ld[order], docs) / lots
        lw = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
        out[:, 22] = per_doc(lw.astype(float), ld, docs) / lots
        out[:, 23] = per_doc((lw <= 1).astype(float), ld, docs) / lots
    return out


@dataclass
class Forest:
    """Flattened trees: feature (-1 in leaves), threshold and value of each node."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = f[node]
                down = 2 * node + 1 + (x[rows, np.maximum(k, 0)] > t[node])
                node = np.where(k < 0, node, down)
            z += v[node]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Forest:
    """Boost ``trees`` trees of at most ``depth`` levels on labels 0/1."""
    nodes = 2 ** (depth + 1) - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Forest(base, np.full((0, nodes), -1), np.zeros((0, nodes)), np.zeros((0, nodes)), depth)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    z = np.full(len(y), base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t, v = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        live = [0]
        for level in range(depth + 1):
            after = []
            for node in live:
                own = np.flatnonzero(at == node)
                G, H = g[own].sum(), h[own].sum()
                v[node] = -rate * G / (H + ridge)
                if level == depth or len(own) < 2 * least:
                    continue
                keys = flat[own].ravel()
                m = x.shape[1] * width
                hg = np.bincount(keys, np.repeat(g[own], x.shape[1]), m).reshape(-1, width).cumsum(1)
                hh = np.bincount(keys, np.repeat(h[own], x.shape[1]), m).reshape(-1, width).cumsum(1)
                hn = np.bincount(keys, minlength=m).reshape(-1, width).cumsum(1)
                gain = hg**2 / (hh + ridge) + (G - hg) ** 2 / (H - hh + ridge) - G**2 / (H + ridge)
                gain[(hn < least) | (len(own) - hn < least)] = 0
                k, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[k, b] <= 1e-6 or b >= len(cuts[k]):
                    continue
                f[node], t[node] = k, cuts[k][b]
                at[own] = 2 * node + 1 + (binned[own, k] > b)
                after += [2 * node + 1, 2 * node + 2]
            live = after
        z += v[at]
        all_f.append(f)
        all_t.append(t)
        all_v.append(v)
    return Forest(base, np.array(all_f), np.array(all_t), np.array(all_v), depth)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, max_rows: int = 20_000, max_bytes: int = 256 << 20) -> Forest:
    """Fit on at most ``max_rows`` labelled documents (``max_bytes`` together) outside the held-out
    fold; only their statistics (``len(NAMES)`` numbers a row) come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(col(b, "text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), col(b, "y").cast(pa.int32()), col(b, "doc_id").cast(pa.int64())], names=["x", "y", "doc_id"])

    rows = labelled_sample(docs, labels, label, modulus, held, max_rows, max_bytes).mapInArrow(run, "x array<double>, y int, doc_id long").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    rows = rows.sort_by("doc_id")
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return fit(x, (rows["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """(doc_id, score) of every document."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([col(b, "doc_id").cast(pa.int64()), pa.array(sent.value.score(features(col(b, "text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held: int = 0, max_rows: int = 20_000) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    scored = score(docs, train(docs, labels, "quality", modulus, held, max_rows))
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
