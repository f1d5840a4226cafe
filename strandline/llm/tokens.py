"""Exact, fast use of the public tokenizer files: split in numpy, encode each distinct piece once.

A tokenizer's ids for a text are the concatenation of the ids of its pre-tokens, so each
distinct pre-token needs the tokenizers library only once per worker. The split is done here
for texts of printable ASCII, line breaks, tabs and the letters U+00C0-U+00FF; any other
text (or one holding ``<|``) goes to the library whole, so ids are the library's for all texts. The split
rules are those of two kinds of file; a file's own rules are read from it, and any other file's texts all go
to the library whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from strandline.llm.common import ragged_ranges, text_bytes

#: Distinct pre-tokens, and bytes of them, kept per worker and tokenizer; beyond it the memo starts afresh.
MEMO, MEMO_BYTES = 500_000, 32 << 20

#: Text bytes encoded together: the more, the fewer times a common pre-token is looked up.
ENCODED_BYTES = 4 << 20

#: Fixed values: (normalizer, pre-tokenizer) of the tokenizer files that ``Splitter`` knows, by its ``spaced``.
RULES = {
    True: (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}


def rule_of(path: str) -> bool | None:
    """Which of the two split rules a tokenizer file has; None for any other file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"].get("dropout") or any(not t["content"].startswith("<|") for t in spec.get("added_tokens", [])):
        return None
    return next((k for k, v in RULES.items() if v == (spec.get("normalizer"), spec.get("pre_tokenizer"))), None)

_SPACE, _LETTER, _DIGIT, _OTHER, _BAD = 0, 1, 2, 3, 4
_CLASS = np.full(256, _BAD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # only behind 0xC3, see below
_CLASS[0xC3] = _LETTER
#: English endings that both tokenizers split off.
ENDINGS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")


class Splitter:
    """Pre-token starts and ends for one of the two split rules.

    ``spaced``: a space stays before the word that follows it and digits run together
    (byte-level rule); otherwise white space is dropped, digits stand alone and letters are
    lower-cased (word rule).
    """

    def __init__(self, spaced: bool):
        self.spaced = spaced

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, whether each document may be split here)."""
        n = len(data)
        k = _CLASS[data]
        prev = np.empty(n, np.uint8)
        prev[0:1], prev[1:] = 0, data[:-1]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        first[n] = True
        tail = (data >= 0x80) & (data < 0xC0)
        bad = (k == _BAD) | (tail & ((prev != 0xC3) | (data == 0x97) | (data == 0xB7)))
        nxt = np.empty(n, np.uint8)
        nxt[-1:], nxt[:-1] = 0, data[1:]
        bad |= (data == 0x3C) & (nxt == 0x7C)
        fine = np.ones(len(offs) - 1, bool)
        if bad.any():
            fine[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = False
        if not self.spaced:
            up = ((data >= 65) & (data <= 90)) | (tail & (prev == 0xC3) & (data <= 0x9E))
            data = data + (up.astype(np.uint8) << 5)
        kp = np.empty(n, np.uint8)
        kp[0:1], kp[1:] = _BAD, k[:-1]
        kp[first[:n]] = _BAD
        kn = np.empty(n, np.uint8)
        kn[-1:], kn[:-1] = _SPACE, k[1:]
        last = first[1:]
        sp = k == _SPACE
        if self.spaced:
            begin = np.where(
                sp,
                (kp != _SPACE) | (~last & (kn != _SPACE)),
                np.where(kp == _SPACE, prev != 32, k != kp),
            )
        else:
            begin = (k != kp) | (k == _DIGIT)
        begin[offs[:-1][offs[:-1] < n]] = True
        ap = np.flatnonzero((data == 39) & begin)
        if len(ap):
            doc_end = offs[np.searchsorted(offs, ap, "right")]
            for e in ENDINGS:
                hit = ap[ap + len(e) <= doc_end]
                for i in range(1, len(e)):
                    hit = hit[data[hit + i] == e[i]]
                begin[hit + 1] = False
                after = hit + len(e)
                after = after[after < n]
                begin[after] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        if not self.spaced:
            keep = k[starts] != _SPACE
            starts, ends = starts[keep], ends[keep]
        return data, starts, ends, fine


class Encoder:
    """Ids of many texts at once, as one flat array and offsets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        rule = rule_of(path)
        self.split = None if rule is None else Splitter(rule)
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[str, int] = {}
        self.at = np.zeros(1 << 16, np.int64)  # start of each piece's ids in flat
        self.len = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = self.held = 0

    def _learn(self, words: list[str]) -> None:
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        base, top = len(self.memo), self.used + len(flat)
        while len(self.at) < base + len(words):
            self.at, self.len = np.resize(self.at, 2 * len(self.at)), np.resize(self.len, 2 * len(self.len))
        while len(self.flat) < top:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.at[base : base + len(words)] = self.used + np.cumsum(n) - n
        self.len[base : base + len(words)] = n
        self.flat[self.used : top] = flat
        self.used = top
        self.held += sum(map(len, words))
        self.memo.update(zip(words, range(base, base + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat uint32 ids, offsets) of all texts; null is an empty text."""
        raw, offs = text_bytes(texts)
        docs = len(offs) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
        if self.split is None:
            return self._library(texts)
        data, starts, ends, fine = self.split(raw, offs)
        doc = np.searchsorted(offs, starts, "right") - 1
        keep = fine[doc]
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
        # where pieces stand in the buffer with gaps (white space was dropped), they are copied together
        size = ends - starts
        packed = data if int(size.sum()) == len(data) else data[ragged_ranges(starts, size)]
        at = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=at[1:])
        pieces = pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(packed)).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        slot = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(slot < 0)
        if len(unknown) and (len(self.memo) + len(unknown) > MEMO or self.held > MEMO_BYTES):
            self._fresh()
            unknown = np.arange(len(words))
        if len(unknown):
            slot[unknown] = np.arange(len(self.memo), len(self.memo) + len(unknown))
            self._learn([words[i] for i in unknown])
        slot = slot[pieces.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        n = self.len[slot].astype(np.int64)
        ids = self.flat[ragged_ranges(self.at[slot], n)]
        per_doc = np.bincount(doc, weights=n, minlength=docs).astype(np.int64)
        if not fine.all():
            ids, per_doc = self._whole(texts, fine, ids, per_doc)
        out = np.zeros(docs + 1, np.int64)
        np.cumsum(per_doc, out=out[1:])
        return ids, out

    def _library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)

    def _whole(self, texts: pa.Array, fine: np.ndarray, ids: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.cumsum(per_doc) - per_doc
        parts, at = [], 0
        odd = np.flatnonzero(~fine)
        got = self.tok.encode_batch_fast([texts[int(i)].as_py() or "" for i in odd], add_special_tokens=False)
        for i, e in zip(odd, got):
            parts += [ids[at : cut[i]], np.array(e.ids, np.uint32)]
            at = cut[i]
            per_doc[i] = len(e.ids)
        return np.concatenate([*parts, ids[at:]]), per_doc


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; its memo lives on between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offs: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Append id ``end`` to each document."""
    docs = len(offs) - 1
    return np.insert(ids, offs[1:], np.uint32(end)), offs + np.arange(docs + 1)
