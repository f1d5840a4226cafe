"""Quality rules by tokeniser fertility: how well public vocabularies fit a text's words.

Three measures come from two public vocabularies: characters per token (in both), the share of tokens that fall back
to single bytes, and the entropy of the tokens. Text of an odd kind (shouting, symbol noise, strings of
random characters, lists without function words, one line again and again) needs more or fewer tokens than others of its
language. The bands are learned from all documents: quartiles for each language (the table's ``lang``; the dominant script
where there is none) and size class (powers of two of the number of tokens), widened by ``Rules.reach`` interquartile
ranges and by at least ``Rules.slack`` of the median. Equal measurements count once, so copies do not move a band.

Base rules stand beside them: too few words, or too many words in repeated five-word windows.

Results in special cases: null, empty and wordless texts have no words and fail; null ids are rows like others;
repeated rows get equal verdicts; a language or size class with fewer than ``Rules.least`` different measurements uses the
bands of its language over all sizes, else none (nothing but the base rules rejects); an empty table gives no rows. Further
columns are left out. Texts are read in blocks of about 1 MB of whole words and lines; of a long text a task keeps its
bytes, one Arrow batch and 17 bytes a word. Words beyond 1000 characters are encoded in pieces of that length.

Words and lines are compared by the interpreter's keyed 64-bit hash (SipHash) within one document.
"""

from __future__ import annotations

import base64
import io
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, col, mix64, prepare, ragged_ranges, slices, stored, text_bytes

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: What does not begin a character of a word.
NOT_HEADS = SPACES + bytes(range(0x80, 0xC0))
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
NO_LETTERS = bytes(x for x in range(128) if x not in LETTERS)
#: Characters that are encoded at once, and distinct words (and bytes of them) that a worker remembers.
WORD_CHARS, MEMO, MEMO_BYTES = 1000, 200_000, 16 << 20
WINDOW = 5

# First code points of Unicode's blocks of letters and the script each range belongs to.
BLOCKS = [
    (0x0000, "other"), (0x00AA, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS, _NAMES = np.array([b for b, _ in BLOCKS], np.uint32), sorted({n for _, n in BLOCKS})
_OF = np.array([_NAMES.index(n) for _, n in BLOCKS])

MEASURES = ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, n_byte_tokens long, n_fallback long, token_entropy double"


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    most_repeated: int = 20  # of 100 words
    reach: float = 2.0
    slack: float = 0.04
    most_fallback: float = 0.02  # never fewer are too many
    least: int = 50


class Vocabularies:
    """Token counts of words in both vocabularies; each distinct word is encoded once while it is remembered."""

    def __init__(self, piece_path: str, byte_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = self.piece.get_piece_size()
        self.is_fallback = np.array([self.piece.is_byte(i) or self.piece.is_unknown(i) for i in range(self.size)])
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.held = 0
        # by word: byte-level tokens, where its piece ids begin in flat, and how many they are
        self.n_byte, self.at, self.n_piece = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        pieces, byte = self.piece.encode(texts, num_threads=1), self.byte.encode_ordinary
        base, n = len(self.memo), np.fromiter(map(len, pieces), np.int64, len(pieces))
        top, used = base + len(words), self.used + int(n.sum())
        while len(self.at) < top:
            self.n_byte, self.at, self.n_piece = (np.resize(x, 2 * len(x)) for x in (self.n_byte, self.at, self.n_piece))
        while len(self.flat) < used:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.n_byte[base:top] = [len(byte(" " + t)) for t in texts]
        self.at[base:top] = self.used + np.cumsum(n) - n
        self.n_piece[base:top] = n
        self.flat[self.used : used] = list(chain.from_iterable(pieces))
        self.used = used
        self.held += sum(map(len, words))
        self.memo.update(zip(words, range(base, top)))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Each word's number; valid until the next call."""
        if len(self.memo) > MEMO or self.held > MEMO_BYTES:
            self._fresh()
        new = list(set(words).difference(self.memo))
        if new:
            self._learn(new)
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def count(self, words: list[bytes], doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte-level tokens of each document, keys, counts): how often a document has a piece, its key being the document's
        number times ``size`` and the piece's id. ``doc`` has each word's document."""
        n_byte, keys, counts = np.zeros(docs, np.int64), [], []
        for part, own in encodable(words, doc):
            known = self.look_up(part)
            n_byte += np.bincount(own, weights=self.n_byte[known], minlength=docs).astype(np.int64)
            n = self.n_piece[known]
            key, count = np.unique(np.repeat(own * self.size, n) + self.flat[ragged_ranges(self.at[known], n)], return_counts=True)
            keys, counts = [*keys, key], [*counts, count]
        return n_byte, *merged(keys, counts)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def encodable(words: list[bytes], doc: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """All words with their documents, those beyond ``WORD_CHARS`` in pieces, about ``SLICE_BYTES`` at a time."""
    if max(map(len, words), default=0) > WORD_CHARS:
        parts, owner = [], []
        for w, d in zip(words, doc):
            text = w.decode() if len(w) > WORD_CHARS else ""
            own = [text[i : i + WORD_CHARS].encode() for i in range(0, len(text), WORD_CHARS)] or [w]
            parts += own
            owner += [d] * len(own)
        words, doc = parts, np.array(owner, np.int64)
    step = max(1, len(words) * SLICE_BYTES // max(SLICE_BYTES, sum(map(len, words))))
    for a in range(0, len(words), step):
        yield words[a : a + step], doc[a : a + step]


def blocks(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and their documents: a slice of short texts at once, a single text in blocks."""
    if len(texts) == 1:
        for words in word_blocks(texts[0]):
            yield words, np.zeros(len(words), np.int64)
        return
    lists = [t.split() for t in texts]
    yield list(chain.from_iterable(lists)), np.repeat(np.arange(len(texts)), np.fromiter(map(len, lists), np.int64, len(lists)))


def word_blocks(data: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes; none is cut."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            # up to the next white space
            cut = min((c for c in (data.find(SPACES[i : i + 1], end) for i in range(len(SPACES))) if c >= 0), default=len(data))
            end = cut
        yield data[at:end].split()
        at = end


def repeated_lines(data: bytes) -> int:
    seen = array("q", (hash(x) for x in (line.removesuffix(b"\n") for line in io.BytesIO(data)) if x.strip()))
    return len(seen) - len(np.unique(np.frombuffer(seen, np.int64))) if seen else 0


def script_of(data: bytes) -> str:
    """The script of most letters; ``other`` without letters."""
    counts = np.zeros(len(_NAMES), np.int64)
    counts[_NAMES.index("latin")] = len(data.translate(None, NO_LETTERS + bytes(range(128, 256))))
    wide, at = data.translate(None, bytes(range(128))), 0
    while at < len(wide):
        end = min(at + SLICE_BYTES, len(wide))
        while end < len(wide) and 0x80 <= wide[end] < 0xC0:
            end += 1
        points = np.frombuffer(wide[at:end].decode().encode("utf-32-le"), np.uint32)
        counts += np.bincount(_OF[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(_NAMES))
        at = end
    counts[_NAMES.index("other")] = 0
    return _NAMES[int(counts.argmax())] if counts.any() else "other"


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document (``counts`` words each, one after the other): words within five-word windows found twice or more in
    it. ``hashes`` is overwritten."""
    n, docs = len(hashes), len(counts)
    out = np.zeros(docs, np.int64)
    if n < WINDOW:
        return out
    ends = np.cumsum(counts)
    block = 1 << 20
    with np.errstate(over="ignore"):
        for a in range(0, n - WINDOW + 1, block):
            b = min(a + block, n - WINDOW + 1)
            h = hashes[a : b + WINDOW - 1].copy()
            w = mix64(np.searchsorted(ends, np.arange(a, b), "right").astype(np.uint64) + np.uint64(1))
            for j in range(WINDOW):
                w = mix64(w ^ h[j : j + b - a]) + np.uint64(j + 1)
            hashes[a:b] = w
    whole = np.zeros(n, bool)
    for end, count in zip(ends, counts):
        whole[end - count : max(end - WINDOW + 1, end - count)] = True
    ordered = np.sort(hashes[whole])
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(again):
        return out
    start = np.zeros(n, bool)
    for a in range(0, n, block):
        at = np.minimum(np.searchsorted(again, hashes[a : a + block]), len(again) - 1)
        start[a : a + block] = (again[at] == hashes[a : a + block]) & whole[a : a + block]
    covered = start.copy()
    for j in range(1, WINDOW):
        covered[j:] |= start[:-j]
    before = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
    return before[ends] - before[ends - counts]


def measured(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` and the columns of ``SCHEMA``, one row a document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabularies(piece_path, byte_path, pattern)
        for b in slices(batches):
            data, offs = text_bytes(col(b, "text"))
            raw, n = memoryview(data), b.num_rows
            texts = [bytes(raw[offs[i] : offs[i + 1]]) for i in range(n)]
            n_words, n_byte, hashes, keys, counts = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [], []
            for words, doc in blocks(texts):
                byte, key, count = known.count(words, doc, n)
                n_byte += byte
                n_words += np.bincount(doc, minlength=n)
                keys, counts = ([x] for x in merged([*keys, key], [*counts, count]))
                hashes.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
            key, count = merged(keys, counts)
            add = lambda weights: np.bincount(key // known.size, weights=weights, minlength=n)
            total = add(count)
            entropy = np.where(total > 0, np.log2(np.maximum(total, 1)) - add(count * np.log2(count)) / np.maximum(total, 1), 0.0)
            fallback = add(count * known.is_fallback[key % known.size])
            chars = [len(t.translate(None, NOT_HEADS)) for t in texts]
            symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            lines, scripts = list(map(repeated_lines, texts)), list(map(script_of, texts))
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            del hashes
            again = repeated_words(every, n_words)
            out = {k: col(b, k) for k in keep}
            out |= {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": again, "script": scripts}
            yield pa.record_batch(out | {"n_tokens": total.astype(np.int64), "n_byte_tokens": n_byte, "n_fallback": fallback.astype(np.int64), "token_entropy": entropy})

    own = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{own}, {SCHEMA}")


def with_measures(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``base_failed``, the measures rounded to what the bands resolve (1/1000), the band's ``group`` and ``size`` class."""
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 3)
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    group = F.coalesce(F.col("lang").cast("string"), F.concat(F.lit("script:"), "script"))
    return rows.withColumns({
        "base_failed": failed, "group": group, "size": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"), "chars_per_token": share("word_chars", "n_tokens"),
        "chars_per_byte_token": share("word_chars", "n_byte_tokens"), "fallback_share": share("n_fallback", "n_tokens"), "token_entropy": F.round("token_entropy", 3),
    })


def bands(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(group, size, measure columns of (low, high)) from the measurements that pass the base rules; ``size`` null: all sizes.

    Equal measurements are one row before anything is counted, and quartiles are taken from counts of rounded values:
    neither copies nor a language with most rows give a task more than its share."""
    own = rows.where(~F.col("base_failed")).select("group", "size", *MEASURES).distinct()
    value = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("x")
    counted = own.select("group", F.explode(F.array("size", F.lit(None).cast("int"))).alias("size"), value).groupBy("group", "size", "x.measure", "x.value").agg(F.count("*").alias("n"))
    quartiles = counted.groupBy("group", "size", "measure").agg(F.expr("percentile(value, array(0.25d, 0.5d, 0.75d), n)").alias("q"), F.sum("n").alias("n")).where(F.col("n") >= rules.least)
    q = F.col("q")
    wide = rules.reach * (q[2] - q[0])
    low, high = F.least(q[0] - wide, q[1] * (1 - rules.slack)), F.greatest(q[2] + wide, q[1] * (1 + rules.slack))
    # no share of single bytes is too small, and few of them are usual in any text
    low, high = F.when(F.col("measure") != "fallback_share", low).otherwise(0.0), F.when(F.col("measure") != "fallback_share", high).otherwise(F.greatest(high, F.lit(rules.most_fallback)))
    pair = F.struct(low.alias("low"), high.alias("high"))
    return quartiles.groupBy("group", "size").agg(*(F.max(F.when(F.col("measure") == m, pair)).alias(m) for m in MEASURES))


def verdicts(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with ``reasons`` (measures outside their band) and ``kept``. The bands are a stored table that
    Catalyst broadcasts if its size allows."""
    of = lambda name: F.struct(*MEASURES).alias(name)
    own = limits.where("size is not null").select("group", "size", of("__own"))
    wide = limits.where("size is null").select("group", of("__wide"))
    out = rows.join(own, ["group", "size"], "left").join(wide, "group", "left")

    def outside(m: str) -> Column:
        # entropy grows with a text's length: across sizes it says nothing
        band = F.col(f"__own.{m}") if m == "token_entropy" else F.coalesce(F.col(f"__own.{m}"), F.col(f"__wide.{m}"))
        return F.when(~F.col(m).between(band["low"], band["high"]), m)

    reasons = F.array_compact(F.array(*(outside(m) for m in MEASURES)))
    out = out.withColumn("reasons", reasons).drop("__own", "__wide")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def assess(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, rules: Rules = Rules()) -> DataFrame:
    """``piece_path`` is a sentencepiece model with byte fallback, ``byte_path`` a file of byte-level ranks and ``pattern``
    its split. One row a document: doc_id, the base counts, the measures, ``group``, ``reasons``, ``base_failed`` and ``kept``."""
    rows = with_measures(stored(measured(docs, piece_path, byte_path, pattern), "fertility"), rules)
    return verdicts(rows, stored(bands(rows, rules), "bands"))
