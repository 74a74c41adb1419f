"""Partial pooling of cells, poststratification, draws, intervals, contrasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .weighted import cells

LEAST, MOST, FLOOR = 1e-2, 1e4, 1e-12


def evidence(frame_cells: DataFrame, sample: DataFrame, dims: Sequence[str], k: int, p: str = "p", weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """by, dims, share, c0..: the sample's vectors, weighted to mean 1, summed into the frame's cells (empty ones too).

    by: columns of both tables that tell questions apart; everything is done within a question.
    """
    used = sample.where(F.col(p).isNotNull())
    mean = used.groupBy(*by).agg(F.avg(weight).alias("_mean"))
    joined = used.join(F.broadcast(mean), list(by)) if by else used.join(F.broadcast(mean))
    sums = joined.groupBy(*by, *dims).agg(*[F.sum(F.col(weight) / F.col("_mean") * F.col(p)[i]).alias(f"c{i}") for i in range(k)])
    return frame_cells.join(sums, [*by, *dims], "left").fillna(0.0, subset=[f"c{i}" for i in range(k)])


def pooled(counts: DataFrame, k: int, concentration: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """counts (a row a cell, c0..) with n, alpha, at_bound, mu0.., post0.., shrinkage.

    alpha by moments: sum mu (1 - mu) / between-cell variance - 1, within bounds; the upper one if fewer than two cells
    are occupied or they don't differ. at_bound: a fitted alpha is the lowest or the highest there is.
    """
    all_ = Window.partitionBy(*by)  # a row a cell: few
    n = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    out = counts.withColumn("n", n)
    for i in range(k):
        out = out.withColumn(f"mu{i}", F.sum(f"c{i}").over(all_) / F.sum("n").over(all_))
    between = sum((F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col(f"c{i}") / F.nullif("n", F.lit(0.0)) - F.col(f"mu{i}"), F.lit(2.0)))).over(all_) for i in range(k)), F.lit(0.0)) / F.sum("n").over(all_)
    within = sum((F.col(f"mu{i}") * (1 - F.col(f"mu{i}")) for i in range(k)), F.lit(0.0))
    occupied = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(all_)
    if concentration is None:
        out = out.withColumn("_between", between).withColumn("_within", within).withColumn("_occupied", occupied)
        fitted = F.col("_within") / F.nullif("_between", F.lit(0.0)) - 1
        alpha = F.when((F.col("_occupied") < 2) | (F.col("_between") <= 0), F.lit(MOST)).otherwise(F.least(F.greatest(fitted, F.lit(LEAST)), F.lit(MOST)))
    else:
        alpha = F.lit(float(concentration))
    out = out.withColumn("alpha", alpha).withColumn("at_bound", F.lit(concentration is None) & F.col("alpha").isin(LEAST, MOST))
    for i in range(k):
        out = out.withColumn(f"post{i}", (F.col("alpha") * F.col(f"mu{i}") + F.col(f"c{i}")) / (F.col("alpha") + F.col("n")))
    return out.withColumn("shrinkage", F.col("alpha") / (F.col("alpha") + F.col("n"))).drop("_between", "_within", "_occupied")


def long_options(df: DataFrame, k: int, prefix: str, keys: Sequence[str], value: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("option_ix"), F.col(f"{prefix}{i}").alias(value)) for i in range(k)]))
    return df.select(*keys, pairs.alias("x")).select(*keys, "x.*")


def poststratified(frame: DataFrame, sample: DataFrame, dims: Sequence[str], k: int, weight: str = "weight", concentration: float | None = None) -> DataFrame:
    """Pooled cells of the frame with their shares: what topline, segments and draws are made of."""
    return pooled(evidence(cells(frame, dims, weight), sample, dims, k, weight=weight), k, concentration)


def topline(posterior: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    sums = posterior.groupBy(*by).agg(*[(F.sum(F.col("share") * F.col(f"post{i}")) / F.sum("share")).alias(f"s{i}") for i in range(k)])
    return long_options(sums, k, "s", list(by), "share")


def segments(posterior: DataFrame, dims: Sequence[str], k: int) -> DataFrame:
    """dimension, level, option_ix, share: the same cells, reweighted within each level of each dimension."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dims]))
    sums = posterior.select(pairs.alias("x"), "*").select("x.*", "share", *[f"post{i}" for i in range(k)]).groupBy("dimension", "level")
    sums = sums.agg(*[(F.sum(F.col("share") * F.col(f"post{i}")) / F.sum("share")).alias(f"s{i}") for i in range(k)])
    return long_options(sums, k, "s", ["dimension", "level"], "share")


def draws(posterior: DataFrame, dims: Sequence[str], k: int, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """by, draw, option_ix, share: Dirichlet draws of every cell, summed by the cells' shares. Seeded by the cell's dims as JSON (null ones left out), so that questions pair by draw and no two cells share a name."""
    parameters = posterior.select(*by, F.to_json(F.struct(*dims)).alias("cell"), "share", F.array(*[F.greatest(F.col("alpha") * F.col(f"mu{i}") + F.col(f"c{i}"), F.lit(FLOOR)) for i in range(k)]).alias("a"))

    def sample(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["cell"].iloc[0]
        rng = np.random.default_rng([seed, *name.encode()])
        found = rng.dirichlet(np.asarray(rows["a"].iloc[0], dtype=float), n) * rows["share"].iloc[0]
        return pd.DataFrame({**{b: rows[b].iloc[0] for b in by}, "draw": np.repeat(np.arange(n), k), "option_ix": np.tile(np.arange(k), n), "part": found.ravel()})

    kinds = dict(posterior.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "draw int, option_ix int, part double"])
    parts = parameters.groupBy(*by, "cell").applyInPandas(sample, schema)
    return parts.groupBy(*by, "draw", "option_ix").agg(F.sum("part").alias("share"))


def interval(value: Column | str, level: float = 0.90) -> tuple[Column, Column]:
    """Equal-tailed exact quantiles."""
    low = round((1 - level) / 2, 12)
    both = F.percentile(value, F.array(F.lit(low), F.lit(1 - low)))
    return both[0], both[1]


def contrast(draws_a: DataFrame, draws_b: DataFrame, level: float = 0.90) -> DataFrame:
    """option_ix, difference, low, high, resolves: b - a, paired by draw; resolves if the interval leaves out 0."""
    both = draws_a.withColumnRenamed("share", "a").join(draws_b.withColumnRenamed("share", "b"), ["draw", "option_ix"]).withColumn("d", F.col("b") - F.col("a"))
    low, high = interval("d", level)
    out = both.groupBy("option_ix").agg(F.avg("d").alias("difference"), low.alias("low"), high.alias("high"))
    return out.withColumn("resolves", (F.col("low") > 0) | (F.col("high") < 0))


def interval_agreement(a: DataFrame, b: DataFrame, level: float = 0.90) -> DataFrame:
    """The largest difference of the two draws' interval ends."""
    ends = []
    for df, n in ((a, "a"), (b, "b")):
        low, high = interval("share", level)
        ends.append(df.groupBy("option_ix").agg(low.alias(f"low_{n}"), high.alias(f"high_{n}")))
    return ends[0].join(ends[1], "option_ix").agg(F.max(F.greatest(F.abs(F.col("low_a") - F.col("low_b")), F.abs(F.col("high_a") - F.col("high_b")))).alias("disagreement"))
