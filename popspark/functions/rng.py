"""Random numbers as functions of a key: results don't depend on partitioning and can be repeated in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_u(*parts) -> Column:
    """[0, 1): the first 52 bits of the parts' SHA-256."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def exponential(*parts) -> Column:
    return -F.ln(F.lit(1.0) - hash_u(*parts))
