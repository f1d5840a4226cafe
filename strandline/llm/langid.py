"""Operator 8: language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1/-1 drawn from a seed by its code
point. A trigram is bound as the product of its letters' vectors, the first permuted twice and the
second once (cyclic shifts). A document is the bundle (sum) of its trigrams; a language prototype
is the bundle of its training documents, each at unit length. A document gets the language whose
prototype has the largest cosine; ``score`` is that cosine, never below 0.

Letters are lower-cased code points whose Unicode category is a letter; all else parts words. A
null text and a text without letters get ``und`` and score 0, as does every text if nothing could
be learnt. A text without any trigram (one letter) has cosine 0 with all. Ties go to the language first in order. Repeated rows score alike, empty
tables give no rows; extra columns are not read. Texts of any length are bundled in pieces of about 1 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, col, fold, labelled_sample, prepare, slices

_NO_LETTER = re.compile(r"[\W\d_]")
_FOLDED: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or 32 for anything else."""
    global _FOLDED
    if _FOLDED is None:
        t = np.full(0x110000, 32, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _FOLDED = t
    return _FOLDED


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram codes, their documents, letters per document); gaps between words count as one letter. A text's
    last word has a gap behind it, its first word one in front only if the text has one there; a trigram
    has a letter in the middle and never crosses a document."""
    rows = texts.to_pylist()
    raw = "\n".join("" if t is None else t.replace("\n", " ") for t in rows) + "\n"
    cp = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(cp == 10)
    doc = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[-1], ends])))
    x = _letters()[cp]
    letter = x != 32
    n = np.bincount(doc[letter], minlength=len(rows))
    # one gap between words: drop a gap that follows a gap
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[1:] |= doc[1:] != doc[:-1]
    x, doc = x[keep].astype(np.int64), doc[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    ok = (doc[2:] == doc[:-2]) & (x[1:-1] != 32)
    return ((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])[ok], doc[2:][ok], n


class Space:
    """Random letter vectors and the trigram vectors bound from them."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng((self.seed, c)).integers(0, 2, self.size).astype(np.float32) * 2 - 1
        return self.letters[c]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        out = np.ones((len(codes), self.size), np.float32)
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            own, inv = np.unique((codes >> shift) & mask, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), turn) for c in own])[inv]
        return out


def pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        gap = _NO_LETTER.search(text, at + SLICE_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def bundles(texts: pa.Array, space: Space, block: int = 8_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(one bundled vector per text, letters per text); blocks bound the count matrix. A long text is bundled in pieces
    that begin where no letter stands, which have the same trigrams as the whole."""
    if len(texts) == 1 and len(texts[0].as_py() or "") > 2 * SLICE_BYTES:
        total, letters = np.zeros((1, space.size)), np.zeros(1, np.int64)
        for p in pieces(texts[0].as_py()):
            v, n = _bundled(pa.array([p], pa.string()), space, block)
            total, letters = total + v, letters + n
        return total.astype(np.float32), letters
    return _bundled(texts, space, block)


def _bundled(texts: pa.Array, space: Space, block: int) -> tuple[np.ndarray, np.ndarray]:
    codes, doc, n = trigrams(texts)
    out = np.zeros((len(n), space.size), np.float32)
    if not len(codes):
        return out, n
    own, inv = np.unique(codes, return_inverse=True)
    for lo in range(0, len(own), 4096):
        hi = min(lo + 4096, len(own))
        vec = space.bind(own[lo:hi])
        sel = (inv >= lo) & (inv < hi)
        step = max(1, block // (hi - lo))
        d, k = doc[sel], inv[sel] - lo
        for a in range(0, len(n), step):
            b = min(a + step, len(n))
            i, j = np.searchsorted(d, [a, b])
            if i < j:
                m = np.bincount((d[i:j] - a) * (hi - lo) + k[i:j], minlength=(b - a) * (hi - lo)).astype(np.float32)
                out[a:b] += m.reshape(b - a, hi - lo) @ vec
    return out, n


@dataclass
class Profiles:
    names: list[str]
    prototypes: np.ndarray  # one unit vector per language
    size: int
    seed: int

    def predict(self, texts: pa.Array, space: Space | None = None) -> tuple[list[str], np.ndarray]:
        v, n = bundles(texts, space or Space(self.size, self.seed))
        if not self.names:
            return ["und"] * len(n), np.zeros(len(n))
        cos = (v @ self.prototypes.T).astype(float) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        best = np.argmax(cos, 1)
        some = n > 0
        return [self.names[k] if s else "und" for k, s in zip(best, some)], np.where(some, np.clip(cos[np.arange(len(n)), best], 0, 1), 0.0)


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, max_rows: int = 8_000, max_bytes: int = 64 << 20, size: int = 1024, seed: int = 11) -> Profiles:
    """Prototypes from at most ``max_rows`` documents (``max_bytes`` together) outside the held-out fold. Each task bundles its
    own documents, so one vector per task and language comes to the driver, at most ``max_rows``."""
    few = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", modulus, held, max_rows, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = Space(size, seed), {}
        for b in slices(batches):
            v, n = bundles(col(b, "text"), space)
            v /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
            lang = np.array(col(b, "y").to_pylist(), object)
            for y in sorted(set(lang)):
                total[y] = total.get(y, 0) + v[lang == y].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["lang", "v"])

    sums: dict[str, np.ndarray] = {}
    for r in sorted(few.mapInArrow(run, "lang string, v array<double>").collect(), key=lambda r: (r["lang"], r["v"])):
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.array(r["v"])
    names = sorted(sums)
    p = np.array([sums[k] / max(np.linalg.norm(sums[k]), 1e-9) for k in names], np.float32).reshape(len(names), size)
    return Profiles(names, p, size, seed)


def assess(docs: DataFrame, modulus: int = 4, held: int = 2, **options) -> DataFrame:
    """Learn and predict: doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, modulus, held, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        space = Space(model.size, model.seed)
        for b in slices(batches, most=2 << 20):
            lang, s = model.predict(col(b, "text"), space)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(s, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score")
