"""Benchmark decontamination: which benchmark items does a document contain, exactly or nearly?

An item of L words is compared with windows of L words of every whole text (a shorter text is one window). Each
window has a 64-bit SimHash over its word shingles, weighted by how often they occur. Eight blocks of eight bits
index the items' fingerprints: two fingerprints within ``RADIUS`` differ in at most two bits of some block, so looking
up each block with up to two bits flipped finds every fingerprint within the radius. The weighted Jaccard
similarity of the shingles then decides exactly.

Windows that share no shingle with any item have similarity 0 and get no fingerprint. Items are given to the
tasks in parts of at most ``PART_BYTES`` of text; a larger benchmark takes more parts, each one pass over the texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.llm.words import cut, as_bytes, run_hashes, runs, slices

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 23
BLOCKS = 8
PART_BYTES = 16 << 20
FILTER_BITS = 22
OUT = "doc_id long, item_id long, similarity double, start_word long, window_words long"

_FLIPS = np.array(sorted({(1 << a) | (1 << b) for a in range(8) for b in range(8)} | {0}), np.int64)
_ONES = np.array([bin(v).count("1") for v in range(65536)], np.uint8)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    return bits * 2 - 1


def fingerprints(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash (as 8 bytes) of shingles start..end from prefix sums of their signs."""
    return np.packbits(prefix[end] - prefix[start] > 0, axis=1)


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(signs(hashes), axis=0, out=out[1:])
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[np.ascontiguousarray(a ^ b).view(np.uint16)].sum(axis=1)


@dataclass
class Index:
    """Items of one length: their fingerprints, shingles with weights, and the blocks' lookup table."""

    words: int
    ids: list[int]
    prints: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    order: np.ndarray
    bounds: np.ndarray

    @classmethod
    def build(cls, words: int, items: list[tuple[int, np.ndarray]]) -> Index:
        sets = [np.unique(h, return_counts=True) for _, h in items]
        prints = np.concatenate([fingerprints(prefix_sums(h), np.array([0]), np.array([len(h)])) for _, h in items])
        key = (np.arange(BLOCKS) * 256 + prints).ravel()
        order = np.argsort(key, kind="stable")
        return cls(words, [i for i, _ in items], prints, sets, order // BLOCKS, np.searchsorted(key[order], np.arange(BLOCKS * 256 + 1)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs of fingerprints within the radius."""
        probes = ((np.arange(BLOCKS) * 256)[None, :, None] + (prints[:, :, None] ^ _FLIPS)).reshape(len(prints), -1)
        n = self.bounds[probes + 1] - self.bounds[probes]
        total = n.sum(axis=1)
        window = np.repeat(np.arange(len(prints)), total)
        flat = n.ravel()
        at = np.repeat(self.bounds[probes].ravel(), flat) + np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
        pair = np.unique(window * len(self.ids) + self.order[at])
        window, item = pair // len(self.ids), pair % len(self.ids)
        ok = hamming(prints[window], self.prints[item]) <= RADIUS
        return window[ok], item[ok]


def similarity(shingles: np.ndarray, item: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: shared occurrences over all occurrences."""
    own, weight = item
    at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
    met = np.bincount(at[own[at] == shingles], minlength=len(own))
    shared = int(np.minimum(met, weight).sum())
    return shared / (len(shingles) + int(weight.sum()) - shared)


class Benchmark:
    """A part of the benchmark, ready to be looked up: built once per task from its ids and texts."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, bounds = as_bytes(pa.array(texts, pa.string()))
        words = cut(data, bounds, lower=True)
        h = words.hashes()
        by_size: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            if b > a:
                size = min(SHINGLE, int(b - a))
                by_size[size][int(b - a)].append((ids[i], run_hashes(h, np.arange(a, b - size + 1), size)))
        self.sizes = {size: [Index.build(n, items) for n, items in lengths.items()] for size, lengths in by_size.items()}
        self.known, self.filters, self.lengths = {}, {}, {}
        for size, indexes in self.sizes.items():
            shingle = np.concatenate([own for x in indexes for own, _ in x.shingles])
            where = np.concatenate([np.full(len(own), k) for k, x in enumerate(indexes) for own, _ in x.shingles])
            order = np.argsort(shingle, kind="stable")
            self.known[size], self.lengths[size] = shingle[order], where[order]
            self.filters[size] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[size][shingle & np.uint64((1 << FILTER_BITS) - 1)] = True

    def anchors(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Places whose shingle occurs in some item."""
        maybe = np.flatnonzero(self.filters[size][hashes & np.uint64((1 << FILTER_BITS) - 1)])
        known = self.known[size]
        return maybe[known[np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)] == hashes[maybe]]

    def search(self, size: int, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, start, words) of the best window per item in one text with shingles ``hashes``."""
        n = len(hashes)
        best: dict[int, tuple[float, int, int]] = {}
        longest = max(x.words for x in self.sizes[size])
        for span in np.split(places, np.flatnonzero(np.diff(places) > 2 * longest) + 1):
            low, high = max(0, int(span[0]) - longest), min(n, int(span[-1]) + longest)
            prefix = prefix_sums(hashes[low:high])
            left, right = (np.searchsorted(self.known[size], hashes[span], side=s) for s in ("left", "right"))
            length = np.repeat(span, right - left), self.lengths[size][np.repeat(left, right - left) + np.arange((right - left).sum()) - np.repeat(np.cumsum(right - left) - (right - left), right - left)]
            for k in np.unique(length[1]):
                index = self.sizes[size][k]
                width = min(index.words - size + 1, n)
                at = np.unique(length[0][length[1] == k])
                start = np.unique((at[:, None] - np.arange(width)).ravel())
                start = start[(start >= 0) & (start + width <= n)]
                for window, item in zip(*index.near(fingerprints(prefix, start - low, start + width - low))):
                    s = int(start[window])
                    value = similarity(hashes[s : s + width], index.shingles[item])
                    if value >= THRESHOLD and value > best.get(index.ids[item], (0.0, 0, 0))[0]:
                        best[index.ids[item]] = (value, s, width + size - 1)
        for item, (value, s, words) in sorted(best.items()):
            yield item, value, s, words


def find(benchmark: Benchmark, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column(0)
    rows = []
    for at, _, words in slices(batch.column(1), lower=True):
        h = words.hashes()
        for size in benchmark.sizes:
            start, text = runs(h, words.first, size)
            hashes = run_hashes(h, start, size)
            anchors = benchmark.anchors(size, hashes)
            owner = text[anchors]
            first = np.searchsorted(text, np.arange(len(words.first)))
            for group in np.split(anchors, np.flatnonzero(np.diff(owner)) + 1) if len(anchors) else ():
                t = int(text[group[0]])
                for item, value, s, n in benchmark.search(size, hashes[first[t] : first[t + 1]], group - first[t]):
                    rows.append((ids[at + t].as_py(), item, value, s, n))
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "similarity", "start_word", "window_words"])


def parts_of(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcast (ids, texts) of the benchmark in parts of about ``PART_BYTES``."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    for part in range(parts):
        held = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").collect()  # about PART_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast(([r["i"] for r in held], [r["t"] for r in held]))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are; texts are judged where they lie."""
    at, out = docs.columns.index(text), docs
    for sent in parts_of(benchmark, item_id, item_text):

        def run(batches, sent=sent):
            ready = Benchmark(*sent.value)
            for batch in batches:
                rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["row", "text"])
                clean = np.ones(batch.num_rows, bool)
                clean[np.unique(find(ready, rows).column(0).to_numpy())] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` and item with a window of similarity 0.75 or more: doc_id, item_id, similarity, start_word, window_words.

    The best window counts, the first of equals. A-Z are lower-cased. Null, empty and wordless texts and items match
    nothing; items under five words must occur whole. Rows with a null doc_id are reported with null; rows that
    repeat are reported each. An empty benchmark gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = []
    for sent in parts_of(benchmark, item_id, item_text):

        def run(batches, sent=sent):
            ready = Benchmark(*sent.value)
            for batch in batches:
                yield find(ready, batch)

        found.append(rows.mapInArrow(run, OUT))
    return reduce(DataFrame.unionByName, found)
