"""Elias-Fano coding of non-decreasing integers, with select, in numpy."""

from __future__ import annotations

import struct

import numpy as np

_MAGIC = b"EF2\0"
_BLOCK = 512  # bits of the upper part per entry of the select directory
_STEP = _BLOCK // 8
#: Place of the i-th one bit of each byte.
_IN_BYTE = np.array([(([k for k in range(8) if b >> k & 1]) + [0] * 8)[:8] for b in range(256)], np.uint8)


class EliasFano:
    """``n`` non-decreasing integers in [0, u]: low bits packed, high bits in unary.

    Space is about n * (2 + log2(u / n)) bits and the select directory: one stored 32-bit count of ones for every
    512 upper bits. Values are read by ``select`` from these bytes; nothing is decoded on opening.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.bits, self.low, self.high, self.directory = n, bits, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        if (v[1:] < v[:-1]).any():
            raise ValueError("Elias-Fano needs non-decreasing values")
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        up = np.zeros(-(-(int(at[-1]) + 1) // _BLOCK) * _BLOCK, np.uint8)
        up[at] = 1
        ones = up.reshape(-1, _BLOCK).sum(1, dtype=np.int64)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        return cls(n, bits, low, np.packbits(up, bitorder="little"), directory)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.bits, len(self.low), len(self.high))
        return _MAGIC + head + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``at`` and the position behind it."""
        if raw[at : at + 4] != _MAGIC:
            raise ValueError("not an Elias-Fano block")
        n, bits, a, b = struct.unpack_from("<QBQQ", raw, at + 4)
        at += 4 + struct.calcsize("<QBQQ")
        low, high = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, bits, low, high, np.frombuffer(raw, "<u4", b // _STEP, at + a + b)), at + a + b + b // _STEP * 4

    def __len__(self) -> int:
        return self.n

    def select(self, i) -> np.ndarray | int:
        """Value ``i`` (an index or an array of them): the directory names the block of the i-th one bit, byte
        counts within the block its byte."""
        k = np.atleast_1d(np.asarray(i, np.int64))
        if len(k) and (k.min() < 0 or k.max() >= self.n):
            raise IndexError(i)
        block = np.searchsorted(self.directory, k, "right") - 1
        rest = k - self.directory[block]
        own = self.high.reshape(-1, _STEP)[block]
        ones = np.cumsum(np.bitwise_count(own), 1, dtype=np.int64)
        byte = (ones <= rest[:, None]).sum(1)
        rows = np.arange(len(k))
        rest -= np.where(byte > 0, ones[rows, np.maximum(byte - 1, 0)], 0)
        pos = block * _BLOCK + byte * 8 + _IN_BYTE[own[rows, byte], rest]
        out = (pos - k).astype(np.uint64) << np.uint64(self.bits)
        for bit in range(self.bits):
            a = k * self.bits + bit
            out |= ((self.low[a >> 3] >> (a & 7).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(bit)
        out = out.view(np.int64)
        return out if np.ndim(i) else int(out[0])
