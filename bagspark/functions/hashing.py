"""Reproducible pseudo-random numbers derived from keys instead of generator state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform in [0, 1): the first 32 bits of md5("seed|key|...") over 2^32."""
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
