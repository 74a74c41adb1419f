"""Populations from microdata: cells drawn by alias table, raked and scaled; content fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import hash_u
from .raking import MOST_CELLS, rake
from .weighted import cells


def alias_table(weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(keep, alias): slot j is cell j with probability keep[j], else cell alias[j]. One draw looks up one slot."""
    scaled = np.asarray(weights, dtype=float)
    if not len(scaled) or not scaled.sum() > 0:
        raise ValueError("no weight to draw from")
    scaled = scaled * len(scaled) / scaled.sum()
    keep, alias = np.ones(len(scaled)), np.arange(len(scaled))
    small, large = [i for i, v in enumerate(scaled) if v < 1], [i for i, v in enumerate(scaled) if v >= 1]
    while small and large:
        i, j = small.pop(), large.pop()
        keep[i], alias[i] = scaled[i], j
        scaled[j] -= 1 - scaled[i]
        (small if scaled[j] < 1 else large).append(j)
    return keep, alias


def scaled(df: DataFrame, total: float | None, weight: str = "weight") -> DataFrame:
    """df with weights that add up to total."""
    if total is None:
        return df
    return df.join(F.broadcast(df.agg((F.lit(float(total)) / F.sum(weight)).alias("_scale")))).withColumn(weight, F.col(weight) * F.col("_scale")).drop("_scale")


def from_microdata(spark: SparkSession, seeds: DataFrame, size: int, targets: Mapping[str, Mapping[str, float]], seed: int, traits: Sequence[str] = (), total: float | None = None, weight: str = "weight") -> DataFrame:
    """agent_id, the targets' attributes, traits, weight: seed rows drawn by weight, raked to the targets, scaled to total.

    Only declared attributes are kept, so drawing a seed row is drawing its joint cell: the seed is aggregated once and
    an agent costs one look-up in a broadcast table of at most MOST_CELLS slots.
    """
    dims = list(targets)
    rows = cells(seeds, dims, weight).where("weight > 0").orderBy(*dims).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError("too many joint cells in the seed")
    keep, alias = alias_table([r["weight"] for r in rows])
    columns = ", ".join(f"{d} string, _other_{d} string" for d in dims)
    slots = [(i, float(keep[i]), *(v for d in dims for v in (r[d], rows[alias[i]][d]))) for i, r in enumerate(rows)]
    table = spark.createDataFrame(slots, f"_slot long, _keep double, {columns}")
    pick = F.least(F.floor(hash_u(seed, "slot", F.col("agent_id")) * len(rows)), F.lit(len(rows) - 1))
    agents = spark.range(size).withColumnRenamed("id", "agent_id").withColumn("_slot", pick).join(F.broadcast(table), "_slot")
    own = hash_u(seed, "keep", F.col("agent_id")) < F.col("_keep")
    agents = agents.select("agent_id", *[F.when(own, F.col(d)).otherwise(F.col(f"_other_{d}")).alias(d) for d in dims], *[hash_u(seed + 1, t, F.col("agent_id")).alias(f"trait_{t}") for t in traits], F.lit(1.0).alias("weight"))
    return scaled(rake(agents, targets)[0], total)


def fingerprint(df: DataFrame) -> str:
    """16 hex digits of the content: equal whenever names, types' text and rows are, in any order and partitioning.

    Doubles count to nine places. Row digests are summed, so that the table needs no sorting.
    """
    import hashlib

    columns = sorted(df.columns)
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    values = F.to_json(F.struct(*[(F.round(c, 9) if c in floating else F.col(c)).cast("string").alias(c) for c in columns]))
    digest = F.sha2(values, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    found = df.agg(F.count("*").cast("string"), *parts).first()
    return hashlib.sha256("|".join([*columns, *(str(x) for x in found)]).encode()).hexdigest()[:16]
