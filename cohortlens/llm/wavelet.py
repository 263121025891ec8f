"""A wavelet matrix of token ids in one compressed byte string.

Layout, little endian: magic, number of tokens, bits, number of texts; the ids and token counts of the
texts; for each bit from the highest, the number of zeros and a zstandard frame of its packed bit-plane.
Rank samples are rebuilt when a plane is opened, one for every 512 bits.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"WVM1"
SAMPLE_BITS = 512
NO_KEY = -(1 << 63)
# Planes are divided and joined this many places at a time, which stay in a core's cache.
BLOCK = 1 << 15


def build(ids: np.ndarray, bits: int, keys: list[int | None] = (), counts: list[int] = ()) -> bytes:
    """The file of one shard; texts lie one after another, with their keys and token counts."""
    out = [MAGIC, struct.pack("<QIQ", len(ids), bits, len(counts)),
           np.array([NO_KEY if k is None else k for k in keys], dtype="<i8").tobytes(), np.array(counts, dtype="<u4").tobytes()]
    press, now = zstandard.ZstdCompressor(level=1), np.asarray(ids)
    for bit in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << bit)).astype(bool)
        zeros = len(now) - int(np.count_nonzero(ones))
        plane = press.compress(np.packbits(ones, bitorder="little").tobytes())
        out += [struct.pack("<QQ", zeros, len(plane)), plane]
        divided, a, b = np.empty_like(now), 0, zeros
        for at in range(0, len(now), BLOCK):
            # Places are faster than masks where bits change often.
            part, here = now[at:at + BLOCK], ones[at:at + BLOCK]
            low, high = np.flatnonzero(~here), np.flatnonzero(here)
            divided[a:a + len(low)], divided[b:b + len(high)] = part[low], part[high]
            a, b = a + len(low), b + len(high)
        now = divided
    return b"".join(out)


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, size: int, zeros: int, data: bytes):
        self.size, self.zeros, self.data = size, zeros, data

    @cached_property
    def ones(self) -> np.ndarray:
        packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data, max_output_size=self.size // 8 + 1), dtype=np.uint8)
        return np.unpackbits(packed, count=self.size, bitorder="little").view(bool)

    @cached_property
    def samples(self) -> np.ndarray:
        return np.append(0, np.add.reduceat(self.ones, np.arange(0, self.size, SAMPLE_BITS), dtype=np.int64).cumsum()) if self.size else np.zeros(1, int)

    def rank(self, i: int) -> int:
        """Ones before place ``i``."""
        at = i // SAMPLE_BITS
        return int(self.samples[at]) + int(np.count_nonzero(self.ones[at * SAMPLE_BITS:i]))

    def select(self, n: int, one: bool) -> int:
        """The place of the ``n``-th (from 0) one, or zero."""
        before = self.samples if one else np.minimum(np.arange(len(self.samples)) * SAMPLE_BITS, self.size) - self.samples
        at = int(np.searchsorted(before, n, side="right")) - 1
        part = self.ones[at * SAMPLE_BITS:(at + 1) * SAMPLE_BITS]
        return at * SAMPLE_BITS + int(np.flatnonzero(part if one else ~part)[n - int(before[at])])


class WaveletMatrix:
    """Opens a file of ``build``: access, counting and occurrence lookup touch one place of each plane."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.size, self.bits, texts = struct.unpack_from("<QIQ", data, 4)
        at = 24
        self.keys = [None if k == NO_KEY else k for k in np.frombuffer(data, "<i8", texts, at).tolist()]
        self.counts = np.frombuffer(data, "<u4", texts, at + 8 * texts).astype(np.int64)
        at += 12 * texts
        self.planes = []
        for _ in range(self.bits):
            zeros, length = struct.unpack_from("<QQ", data, at)
            self.planes.append(Plane(self.size, zeros, data[at + 16:at + 16 + length]))
            at += 16 + length

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for plane in self.planes:
            one = bool(plane.ones[i])
            i = plane.zeros + plane.rank(i) if one else i - plane.rank(i)
            value = 2 * value + one
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            a, b = plane.rank(start), plane.rank(stop)
            start, stop = (plane.zeros + a, plane.zeros + b) if token >> (self.bits - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` stands in [start, stop)."""
        a, b = self._range(token, start, self.size if stop is None else stop) if token < 1 << self.bits else (0, 0)
        return b - a

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> list[int]:
        """The places of ``token`` in [start, stop), ascending."""
        if token >= 1 << self.bits:
            return []
        a, b = self._range(token, start, self.size if stop is None else stop)
        places = []
        for i in range(a, b):
            for level in range(self.bits - 1, -1, -1):
                plane, one = self.planes[level], bool(token >> (self.bits - 1 - level) & 1)
                i = plane.select(i - plane.zeros if one else i, one)
            places.append(i)
        return places

    def tokens(self) -> np.ndarray:
        """All ids in order, as unsigned 32-bit numbers."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.size, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            plane, above = self.planes[level], np.empty(self.size, dtype=kind)
            now[plane.zeros:] |= kind(1 << (self.bits - 1 - level))
            a, b = 0, plane.zeros
            for at in range(0, self.size, BLOCK):
                part, here = above[at:at + BLOCK], plane.ones[at:at + BLOCK]
                low, high = np.flatnonzero(~here), np.flatnonzero(here)
                part[low], part[high] = now[a:a + len(low)], now[b:b + len(high)]
                a, b = a + len(low), b + len(high)
            now = above
        return now.astype(np.uint32)
