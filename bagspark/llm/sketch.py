"""A count-min sketch held by shards: estimates of how often a key occurs, never too low.

Row r of the sketch has 2^bits cells; a key falls into the cell named by the leading bits of its r-th hash.
A chunk sketches its own keys and sends each shard the rising numbers of its touched cells with their
counts (up to 255), which merge by addition. The shard adds up the chunks' partial sketches and answers
every chunk with the totals of the chunk's own cells. The least total over the rows is the estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from bagspark.llm.chunks import Chunks, merge
from bagspark.llm.packing import pack, pack_sorted, unpack, unpack_sorted

SHARD_BITS = 22
CELLS_PER_KEY = 8
TOP = 255


def sketch_bits(keys: int) -> int:
    """Cells in powers of two, about ``CELLS_PER_KEY`` for each key expected."""
    return max(SHARD_BITS, int(np.ceil(np.log2(max(keys, 1) * CELLS_PER_KEY))))


def cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(touched cells rising, the index of each key's cell among them)."""
    return np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)


def by_shard(rising: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, bounds) of rising cell numbers; shard s owns ``bounds[i]:bounds[i + 1]``."""
    shard = (rising >> np.uint64(SHARD_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[starts], np.append(starts, len(rising))


def send(chunk: int, families: list[np.ndarray], bits: int) -> list[dict]:
    """The partial sketch of a chunk's keys; ``families`` has one array of hashes per sketch row."""
    out = []
    for row, hashes in enumerate(families):
        sorted_cells = np.sort(hashes >> np.uint64(64 - bits))
        starts = np.flatnonzero(np.concatenate([[True], sorted_cells[1:] != sorted_cells[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        touched, counts = sorted_cells[starts], np.minimum(np.diff(starts, append=len(hashes)), TOP).astype(np.uint8)
        shards, bounds = by_shard(touched, bits)
        local = touched & np.uint64((1 << SHARD_BITS) - 1)
        out.append({
            "shard": (shards * len(families) + row).astype(np.int32), "chunk": np.full(len(shards), chunk, np.int32),
            "keys": [pack_sorted(local[a:b]) for a, b in zip(bounds[:-1], bounds[1:])],
            "extra": [pack(counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:])],
        })
    return out


def add_up(shard: int, table: pa.Table) -> list[dict]:
    """Totals of one shard of one sketch row, told to every chunk for its own cells."""
    total = np.zeros(1 << SHARD_BITS, np.uint8)
    chunks, keys, counts = (table.column(c).to_pylist() for c in ("chunk", "keys", "extra"))
    for k, c in zip(keys, counts):
        at = unpack_sorted(k).astype(np.int64)
        total[at] = np.minimum(total[at].astype(np.uint16) + unpack(c, np.uint8), TOP).astype(np.uint8)
    return [{"chunk": np.array(chunks, np.int32), "shard": np.full(len(chunks), shard, np.int32),
             "answer": [pack(total[unpack_sorted(k).astype(np.int64)]) for k in keys]}]


def estimates(families: list[np.ndarray], answers: pa.Table, bits: int) -> np.ndarray:
    """The estimate for every key of a chunk, in the order of the hashes."""
    told = dict(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist()))
    least = None
    for row, hashes in enumerate(families):
        touched, at = cells(hashes, bits)
        shards, _ = by_shard(touched, bits)
        totals = [unpack(told[int(s) * len(families) + row], np.uint8) for s in shards]
        own = np.concatenate(totals)[at] if totals else np.zeros(0, np.uint8)
        least = own if least is None else np.minimum(least, own)
    return least


def counted(chunks: Chunks, keys, bits: int):
    """Sends and merges the partial sketches; ``keys(table)`` gives the families of a chunk's keys."""
    return merge(chunks.send(lambda chunk, table: send(chunk, keys(table), bits)), add_up)
