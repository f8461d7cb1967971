"""Whole texts as arrays: words, their hashes and the hashes of runs of words.

A word is a maximal run of characters other than space and the controls 0x09 to 0x0D. All of these are
single bytes in UTF-8 and never part of a longer sequence, so a text is cut and hashed on its bytes, many
texts at a time, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
SPREAD = 32

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, (SPREAD, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _random.integers(1, 2**63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of consecutive texts: byte spans into ``data``; text ``t`` owns words ``first[t]:first[t + 1]``."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word: one random number for each byte at each place, summed and mixed."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        inside = ~_IS_SPACE[self.data]
        opened = np.zeros(len(self.data), np.int64)
        opened[self.starts] = np.diff(self.starts, prepend=0)
        place = np.arange(len(self.data)) - np.cumsum(opened)
        inside[: self.starts[0]] = False
        value = _BYTE.ravel()[((place & (SPREAD - 1)) << 8) | self.data]
        long_run = np.flatnonzero((place >= SPREAD) & inside)
        if len(long_run):
            block = (place[long_run] >> 5).astype(np.uint64)
            value[long_run] = mix(value[long_run] + block * _FAR)
        value[~inside] = 0
        return mix(np.add.reduceat(value, self.starts) + (self.ends - self.starts).astype(np.uint64) * _FAR)


def as_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other and the byte offset of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def cut(data: np.ndarray, texts: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts that lie one after the other in ``data``."""
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[texts] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, texts, starts, ends, np.searchsorted(starts, texts))


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, words) for runs of whole texts of about ``size`` bytes, so that working arrays stay small."""
    data, bounds = as_bytes(texts)
    n, at = len(bounds) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield at, end, cut(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at], lower)
        at = end


def runs(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text) of every run of ``length`` words that stays inside one text."""
    counts = np.diff(first)
    room = np.maximum(counts - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), room)
    start = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    return start, text


def run_hashes(hashes: np.ndarray, start: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """The hash of the words ``start .. start + length`` for every start; families are independent."""
    total = np.full(len(start), length * int(_FAR) % 2**64, np.uint64)
    for k in range(length):
        total += hashes[start + k] * _STEPS[family, k % 64] if k < 64 else mix(hashes[start + k] + np.uint64(k)) * _STEPS[family, k % 64]
    return mix(total)
