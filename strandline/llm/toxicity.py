"""Operator 7: toxicity by subword-bag embeddings averaged into a linear softmax.

A text is lower-cased (ASCII and U+00C0-U+00DE) and cut into words of letters, digits and
non-ASCII characters. A word is the bag of itself and its byte n-grams (3 to 6, with one space on
either side as boundary), each hashed to one of ``2**bits`` embedding rows. A passage of ``span``
words is the average of its words, a word the average of its bag; a softmax over two classes
reads the average. Embeddings and softmax are trained jointly in numpy with Adagrad. Since a
label marks a whole document but a few words may earn it, training alternates: a toxic document is represented by its highest-scoring passage, a
clean one by its highest ones so far and others drawn at random; in the first round passages are
ranked by the log-odds of their n-grams' document counts.

A document's score is the highest probability over its passages (whole text, passages half
overlapping). As the softmax is linear, an embedding row only counts through its product with the
class difference, so scoring uses one number per row. Misspellings share most n-gram rows with
the word meant.

Null, empty and wordless texts get the probability of an empty passage (the bias alone), capped
below one half. Repeated rows score alike; of a text's passages with equal scores the first represents it; empty tables give no
rows. Long texts are scored in blocks of words. Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.common import class_words, col, fold, labelled_sample, prepare, ragged_ranges, slices, span_hashes, text_bytes

_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[65:91] = _SEP[97:123] = False
_SEP[128:] = False
SIZES = (3, 4, 5, 6)


def lowered(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + (up.astype(np.uint8) << 5)


def bags(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per n-gram size (word of each gram, its row), then each word's number of rows and document.
    The whole word counts as one more gram."""
    data = lowered(data)
    starts, ends, doc = class_words(data, offs, _SEP)
    n = len(starts)
    size = ends - starts
    at = np.zeros(n + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    flat = np.full(int(at[-1]) + 1, 32, np.uint8)  # " word word ... "
    flat[ragged_ranges(at[:-1] + 1, size)] = data[ragged_ranges(starts, size)]
    shift = np.uint64(64 - bits)
    total = size + 1  # bytes with the leading space
    out = []
    count = np.ones(n, np.int64)
    v = flat.astype(np.uint64)
    code = v.copy()
    word = np.repeat(np.arange(n), total)
    left = np.repeat(at[1:], total) - np.arange(len(word))  # to the closing space
    for k in range(2, max(SIZES) + 1):
        code = code[:-1] | (v[k - 1 :] << np.uint64(8 * (k - 1)))
        if k not in SIZES:
            continue
        ok = np.flatnonzero(left[: len(code)] >= k - 1)
        row = ((code[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)) >> shift
        own = word[ok]
        count += np.bincount(own, minlength=n)
        out.append((own, row.astype(np.int64)))
    out.append((np.arange(n), (span_hashes(data, starts, ends) >> shift).astype(np.int64)))
    return out, count, doc


#: Text bytes whose words are looked at together.
BLOCK = 512 << 10


def blocks(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``BLOCK`` bytes that cut no word: each ends at a separator or a text's end."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        while hi < n:
            nearest = offs[np.searchsorted(offs, hi, "left")]
            part = _SEP[data[hi : hi + 4096]]
            at = int(np.argmax(part)) if part.any() else len(part)
            hi = min(hi + at, int(nearest))
            if at < len(part) or hi == nearest:
                break
        yield lo, hi
        lo = hi


def block_words(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block with words: its lower-cased bytes, the words' starts and ends in them, their documents."""
    for lo, hi in blocks(data, offs):
        part = lowered(data[lo:hi])
        first = int(np.searchsorted(offs, lo, "right")) - 1
        last = int(np.searchsorted(offs, hi, "left"))
        starts, ends, doc = class_words(part, np.clip(offs[first : last + 1] - lo, 0, hi - lo), _SEP)
        if len(starts):
            yield part, starts, ends, (doc + first).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # 2**bits numbers, class difference of each embedding row
    bias: float
    bits: int
    span: int

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's mean weight and its document. Within a block of text a distinct word's bag is
        summed once."""
        scores, docs = [np.zeros(0)], [np.zeros(0, np.int32)]
        for part, starts, ends, doc in block_words(data, offs):
            _, head, inv = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
            flat, edge = spaced(part, starts[head], ends[head])
            grams, count, _ = bags(flat, edge, self.bits)
            s = np.zeros(len(head))
            for own, row in grams:
                s += np.bincount(own, self.weight[row], len(head)) if len(own) else 0
            scores.append((s / count)[inv])
            docs.append(doc)
        return np.concatenate(scores), np.concatenate(docs)

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offs = text_bytes(texts)
        docs = len(offs) - 1
        best = np.full(docs, -np.inf)
        if len(data):
            s, doc = self.words(data, offs)
            a, b, own = passages(doc, docs, self.span)
            if len(a):
                c = np.concatenate([[0], np.cumsum(s)])
                np.maximum.at(best, own, (c[b] - c[a]) / (b - a))
        z = np.where(np.isfinite(best), best + self.bias, min(self.bias, -0.1))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words parted by single spaces as one text, and its two offsets."""
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    flat = np.full(int((size + 1).sum()), 32, np.uint8)
    flat[ragged_ranges(at, size)] = data[ragged_ranges(starts, size)]
    return flat, np.array([0, len(flat)])


def passages(doc: np.ndarray, docs: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-overlapping passages as word ranges: starts, ends and documents."""
    n = np.bincount(doc, minlength=docs)
    step = max(1, span // 2)
    k = np.where(n > span, -(-(n - span) // step) + 1, (n > 0).astype(np.int64))
    own = np.repeat(np.arange(docs, dtype=np.int32), k)
    before = np.cumsum(n) - n
    a = (np.arange(len(own), dtype=np.int32) - np.repeat((np.cumsum(k) - k).astype(np.int32), k)) * np.int32(step)
    a += before.astype(np.int32)[own]
    return a, np.minimum(a + np.int32(span), (before + n).astype(np.int32)[own]), own


def _vocabulary(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct word's bag once: word number of every occurrence, flat rows, first row and
    number of rows of each word, document of every occurrence."""
    data, offs = text_bytes(texts)
    words, docs = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    rows, counts = [], []
    seen, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and their word numbers
    for part, starts, ends, doc in block_words(data, offs):
        h, head, inv = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(seen, h), max(len(seen) - 1, 0))
        new = seen[at] != h if len(seen) else np.ones(len(h), bool)
        own = np.empty(len(h), np.int32)
        own[~new] = number[at[~new]]
        own[new] = len(seen) + np.arange(new.sum(), dtype=np.int32)
        words.append(own[inv])
        docs.append(doc)
        if new.any():
            k = head[new]
            grams, count, _ = bags(*spaced(part, starts[k], ends[k]), bits)
            of, row = (np.concatenate([g[i] for g in grams]) for i in (0, 1))
            rows.append(row[np.argsort(of, kind="stable")].astype(np.int32))
            counts.append(count)
            seen, number = np.concatenate([seen, h[new]]), np.concatenate([number, own[new]])
            order = np.argsort(seen)
            seen, number = seen[order], number[order]
    words, doc = np.concatenate(words), np.concatenate(docs)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return words, row, np.cumsum(count) - count, count, doc


def fit(texts: pa.Array, y: np.ndarray, bits: int = 18, dim: int = 8, span: int = 2, rounds: int = 4, rate: float = 0.2, batch: int = 256, least: int = 4, seed: int = 7) -> Model:
    """Train on whole labelled texts (y in 0/1). Embedding rows met in fewer than ``least`` texts
    stay zero: they could only memorise."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << bits), -20.0, bits, span)
    rng = np.random.default_rng(seed)
    words, row, first, count, doc = _vocabulary(texts, bits)
    met, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    for lo in range(0, len(y), 256):  # texts in blocks: bounded memory
        i, j = np.searchsorted(doc, [lo, lo + 256])
        met_by = np.unique(words[i:j].astype(np.int64) * 256 + (doc[i:j] - lo))
        u = met_by // 256
        rows = np.unique(row[ragged_ranges(first[u], count[u])].astype(np.int64) * 256 + np.repeat(met_by % 256, count[u]))
        met += np.bincount(rows // 256, minlength=1 << bits)
        toxic += np.bincount(rows // 256, y[lo + rows % 256], 1 << bits)
    known = (met >= least).astype(np.float32)
    odds = known * (np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((met - toxic + 0.5) / (len(y) - y.sum() + 1)))
    a, b, p_doc = (x.astype(np.int32) for x in passages(doc, len(y), span))
    p_y = y.astype(np.int8)[p_doc]
    emb = ((rng.random((1 << bits, dim)) - 0.5) / dim * known[:, None]).astype(np.float32)
    soft = ((rng.random((dim, 2)) - 0.5) / dim).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sq_emb, sq_soft, sq_bias = (np.full(x.shape, 1e-5, np.float32) for x in (emb, soft, bias))

    def step(sel: np.ndarray) -> None:
        n = b[sel] - a[sel]
        w = words[ragged_ranges(a[sel], n)]
        c = count[w]
        r = row[ragged_ranges(first[w], c)]
        share = np.repeat((1 / np.repeat(n, n) / c).astype(np.float32), c) * known[r]
        ends = np.add.reduceat(c, np.cumsum(n) - n)
        heads = np.cumsum(ends) - ends
        hid = np.add.reduceat(emb[r] * share[:, None], heads, axis=0)
        z = hid @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        t = p_y[sel].astype(np.int64)
        d = p.astype(np.float32)
        d[np.arange(len(sel)), t] -= 1
        # the rarer class weighs as much as the other
        d *= np.where(t == 1, len(t) / max(2 * t.sum(), 1), len(t) / max(2 * (len(t) - t.sum()), 1))[:, None]

        g_soft, g_hid = hid.T @ d, d @ soft.T
        back = np.repeat(g_hid, ends, axis=0) * share[:, None]
        rows, inv = np.unique(r, return_inverse=True)
        g = np.stack([np.bincount(inv, back[:, k], len(rows)) for k in range(dim)], 1).astype(np.float32)
        sq_emb[rows] += g * g
        emb[rows] -= rate * g / np.sqrt(sq_emb[rows])
        np.add(sq_soft, g_soft * g_soft, out=sq_soft)
        np.subtract(soft, 0.1 * rate * g_soft / np.sqrt(sq_soft), out=soft)
        gb = d.sum(0)
        np.add(sq_bias, gb * gb, out=sq_bias)
        np.subtract(bias, 0.1 * rate * gb / np.sqrt(sq_bias), out=bias)

    hard = np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], p_doc[1:] != p_doc[:-1]]))  # each text's first passage
    many = np.diff(np.append(heads, len(p_doc)))
    weight = odds
    for _ in range(rounds):
        own = np.zeros(len(count))
        for lo in range(0, len(count), 100_000):  # words in blocks: bounded memory
            hi = min(len(count), lo + 100_000)
            own[lo:hi] = np.add.reduceat(weight[row[first[lo] : first[hi - 1] + count[hi - 1]]], first[lo:hi] - first[lo]) / count[lo:hi]
        z = np.empty(len(a), np.float32)
        for lo in range(0, len(a), 200_000):  # passages in blocks, too
            i, j = a[lo : lo + 200_000], b[lo : lo + 200_000]
            c = np.concatenate([[0], np.cumsum(own[words[i[0] : j[-1]]])])
            z[lo : lo + 200_000] = (c[j - i[0]] - c[i - i[0]]) / (j - i)
        top = np.flatnonzero(z == np.repeat(np.maximum.reduceat(z, heads), many))
        best = first_of(top, p_doc)
        other = heads + rng.integers(0, many)
        # a toxic text: its best passage; clean ones: all best passages so far and two others
        hard = np.union1d(hard, best[p_y[best] == 0])
        more = rng.integers(0, len(a), min(len(a), len(y)))
        pick = np.unique(np.concatenate([best, hard, other[p_y[other] == 0], more[p_y[more] == 0]]))
        for _ in range(2):
            pick = rng.permutation(pick)
            for i in range(0, len(pick), batch):
                step(pick[i : i + batch])
        weight = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
    return Model(weight, float(bias[1] - bias[0]), bits, span)


def first_of(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first index of each key in ``order``, which has equal keys side by side."""
    k = key[order]
    return order[np.concatenate([[True], k[1:] != k[:-1]])]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, max_rows: int = 6_000, max_bytes: int = 16 << 20, **options) -> Model:
    """Fit on at most ``max_rows`` labelled texts of at most ``max_bytes`` bytes together; those two
    parameters bound the sample. Texts of any length can be among them. One task fits them, so the driver gets
    the model alone."""
    bits, span = options.get("bits", 18), options.get("span", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches], schema).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        y = np.array([int(v) > 0 for v in rows["y"].to_pylist()], np.int64)
        text = rows["text"].combine_chunks()
        m = fit(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, y, **options)
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.astype("<f8").tobytes()], pa.binary()), pa.array([m.bias])], names=["weight", "bias"])

    sample = labelled_sample(docs, labels, label, modulus, held, max_rows, max_bytes).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y")
    schema = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("y", pa.string())])
    found = sample.repartition(1).mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(bytes(found["weight"]), "<f8"), found["bias"], bits, span) if found else fit(pa.array([], pa.string()), np.zeros(0, np.int64), bits=bits, span=span)


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """Every column of ``docs`` kept, and the score as column ``into``, which must not be there yet."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {into} already: name another one")
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=BLOCK):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(col(b, "text")))], names=[*b.schema.names, into])

    return docs.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held: int = 1, **options) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    scored = score(docs.select("doc_id", "text"), train(docs, labels, "toxic", modulus, held, **options))
    s = F.col("toxicity")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"), s.alias("score"), (s >= threshold).cast("int").alias("predicted"))
