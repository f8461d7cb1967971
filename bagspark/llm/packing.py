"""Arrays of integers as small binary values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: equal high bytes of near values cost almost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(blob: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(blob[8:], n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising values as gaps, in the narrowest integers that hold them."""
    gaps = np.diff(values, prepend=values[:1] * 0)
    top = int(gaps.max()) if len(gaps) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return np.dtype(kind).itemsize.to_bytes(1, "little") + pack(gaps.astype(kind))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob[1:], f"u{blob[0]}"), dtype=np.uint64)
