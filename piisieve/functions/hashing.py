"""Deterministic per-row pseudo-random numbers from key hashes.

``rand()`` depends on partitioning and task retries; a hash of the row key does not, so reruns,
retries and other engines agree. unit = first 32 bits of md5(key) / 2^32, in [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_string(*cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def hash32(*cols) -> Column:
    return F.conv(F.substring(F.md5(key_string(*cols)), 1, 8), 16, 10).cast("long")


def unit_hash(*cols) -> Column:
    return hash32(*cols) / F.lit(4294967296.0)
