"""Exact totals per key over all chunks, by the round trip of ``chunks``: one packed entry per key and chunk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from bagspark.llm.packing import pack, pack_sorted, unpack, unpack_sorted

SHARD_KEYS = 4 << 20
TOTALS = "chunk int, shard int, answer binary, n_keys long, total long"


def shift_for(keys: int) -> int:
    """The right shift that leaves a key's shard, for about ``SHARD_KEYS`` entries in each."""
    return 64 - max(0, int(np.ceil(np.log2(max(1, keys / SHARD_KEYS)))))


def shards(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, bounds) of rising keys."""
    shard = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[starts], np.append(starts, len(keys))


def send(chunk: int, keys: np.ndarray, columns: list[np.ndarray], shift: int) -> dict:
    """Rising distinct keys of a chunk with whole numbers to be added up."""
    shard, at = shards(keys, shift)
    return {"shard": shard.astype(np.int32), "chunk": np.full(len(shard), chunk, np.int32),
            "keys": [pack_sorted(keys[x:y]) for x, y in zip(at[:-1], at[1:])],
            "extra": [pack(np.concatenate([c[x:y] for c in columns]).astype(np.int64)) for x, y in zip(at[:-1], at[1:])]}


def total_up(columns: int, least: int = 1):
    """A kernel that answers each chunk's entries with the totals, those under ``least`` in column 0 as zero.

    The first chunk that has a key is told that it owns it (2 x total + 1 instead of 2 x total), so that something
    can be counted once per key. The row for chunk -1 has the number of keys with a total above 0 and the sum of column 0.
    """

    def kernel(shard: int, table: pa.Table) -> list[dict]:
        table = table.sort_by("chunk")
        chunks = table.column("chunk").to_numpy().astype(np.int32)
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        values = [unpack(x, np.int64).reshape(columns, -1) for x in table.column("extra").to_pylist()]
        at = np.cumsum([0, *map(len, keys)])
        distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        totals = np.stack([np.bincount(inverse, v, minlength=len(distinct)).astype(np.int64) for v in np.concatenate(values, axis=1)])
        enough = totals[0] >= least
        n_keys, total = int((totals[0] >= max(least, 1)).sum()), int(totals[0][enough].sum())
        told = np.where(enough, totals, 0)[:, inverse]
        told[0] *= 2
        told[0][first] += 1
        answers = [pack(told[:, x:y].ravel()) for x, y in zip(at[:-1], at[1:])]
        return [{"chunk": np.append(chunks, np.int32(-1)), "shard": np.full(len(chunks) + 1, shard, np.int32), "answer": [*answers, b""],
                 "n_keys": np.append(np.zeros(len(chunks), np.int64), n_keys), "total": np.append(np.zeros(len(chunks), np.int64), total)}]

    return kernel


def read(keys: np.ndarray, answers: pa.Table, columns: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals by column and key, whether the chunk owns the key) for the rising keys that were sent."""
    told = dict(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist()))
    shard, _ = shards(keys, shift)
    parts = [unpack(told[int(s)], np.int64).reshape(columns, -1) for s in shard]
    out = np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), np.int64)
    owned = (out[0] & 1).astype(bool)
    out[0] >>= 1
    return out, owned
