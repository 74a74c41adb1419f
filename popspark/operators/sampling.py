"""Apportionment and sampling without replacement, seeded by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import exponential, hash_u
from .weighted import cells


def largest_remainder(grouped: DataFrame, total: int, order: Sequence[str], share: str = "share", least: int = 0) -> DataFrame:
    """grouped (a row a cell) with alloc: whole numbers that add up to total, at least `least` each; ties by order."""
    n = F.count("*").over(Window.partitionBy())
    quota = F.col(share) * (F.lit(total) - n * least)
    base = grouped.withColumn("_q", quota).withColumn("_f", F.floor("_q"))
    short = F.lit(total) - n * least - F.sum("_f").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_q") - F.col("_f")), *order))
    out = base.withColumn("_short", short).withColumn("_rank", rank)
    return out.withColumn("alloc", (F.col("_f") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0) + least).cast("long")).drop("_q", "_f", "_short", "_rank")


def stratified(df: DataFrame, n: int, dims: Sequence[str], seed: int, key: str, weight: str = "weight") -> DataFrame:
    """At least one row a cell, then by weight share; never more than a cell has."""
    alloc = largest_remainder(cells(df, dims, weight), n, dims, least=1).select(*dims, "alloc")
    rank = F.row_number().over(Window.partitionBy(*dims).orderBy(hash_u(seed, F.col(key)), key))
    return df.join(alloc, list(dims)).withColumn("_rank", rank).where(F.col("_rank") <= F.col("alloc")).drop("_rank", "alloc")


def weighted_sample(df: DataFrame, n: int, seed: int, key: str, weight: str | None = "weight") -> DataFrame:
    """n rows without replacement; with a weight, by exponential clocks."""
    clock = exponential(seed, F.col(key)) / F.col(weight) if weight else hash_u(seed, F.col(key))
    rows = df.where(F.col(weight) > 0) if weight else df
    return rows.withColumn("_clock", clock).orderBy("_clock", key).limit(n).drop("_clock")


def bernoulli(df: DataFrame, rate: float, seed: int, key: str, most: int | None = None) -> DataFrame:
    rows = df.where(hash_u(seed, F.col(key)) < rate)
    return rows if most is None else rows.orderBy(hash_u(seed, F.col(key)), key).limit(most)
