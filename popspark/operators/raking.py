"""Iterative proportional fitting on joint cells, synthesis, and checks of the fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash_u
from .weighted import all_marginals, cells

#: Joint cells the driver fits; attributes have few declared levels.
MOST_CELLS = 200_000


@dataclass
class Fit:
    iterations: int = 0
    converged: bool = False
    max_deviation: float = 0.0
    history: list[float] = field(default_factory=list)
    unreachable: list[tuple[str, str]] = field(default_factory=list)


def _checked(targets: Mapping[str, Mapping[str, float]]) -> None:
    for name, levels in targets.items():
        if any(v < 0 for v in levels.values()) or abs(sum(levels.values()) - 1) > 1e-8:
            raise ValueError(f"targets of {name} must be shares that add up to 1")


def fit_cells(codes: np.ndarray, weights: np.ndarray, targets: Sequence[np.ndarray], most: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, Fit]:
    """Factors a cell: every attribute in turn is scaled to its targets until no share is off by more than the tolerance.

    codes: (cells, attributes); a level that no weight reaches keeps its cells as they are.
    """
    if not weights.sum() > 0:
        raise ValueError("no weight to rake")
    now, out = weights.astype(float).copy(), Fit()
    sums = lambda i, w: np.bincount(codes[:, i], w, len(targets[i])) / w.sum()
    for out.iterations in range(1, most + 1):
        for i, goal in enumerate(targets):
            got = sums(i, now)
            factor = np.divide(goal, got, out=np.ones_like(got), where=got > 0)
            now *= factor[codes[:, i]]
        out.max_deviation = max(float(np.abs(sums(i, now) - goal).max()) for i, goal in enumerate(targets))
        out.history.append(out.max_deviation)
        if out.max_deviation <= tolerance:
            out.converged = True
            break
    return now, out


def rake(df: DataFrame, targets: Mapping[str, Mapping[str, float]], weight: str = "weight", most: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, Fit]:
    """df with its weight raked to the targets. One aggregation to joint cells, the fit on the driver, one join back."""
    _checked(targets)
    dims = list(targets)
    table = df.where(F.col(weight) > 0).dropna(subset=dims).groupBy(*dims).agg(F.sum(weight).alias("w")).orderBy(*dims).limit(MOST_CELLS + 1).collect()
    if len(table) > MOST_CELLS:
        raise ValueError("too many joint cells to rake")
    levels = {d: list(targets[d]) for d in dims}
    unknown = sorted({(d, r[d]) for r in table for d in dims if r[d] not in targets[d]})
    if unknown:
        raise ValueError(f"levels without a target: {unknown}")
    codes = np.array([[levels[d].index(r[d]) for d in dims] for r in table], dtype=int).reshape(len(table), len(dims))
    before = np.array([r["w"] for r in table], dtype=float)
    after, info = fit_cells(codes, before, [np.array([targets[d][x] for x in levels[d]]) for d in dims], most, tolerance)
    info.unreachable = [(d, x) for i, d in enumerate(dims) for j, x in enumerate(levels[d]) if targets[d][x] > 0 and not (codes[:, i] == j).any()]
    schema = ", ".join([*(f"{d} string" for d in dims), "_factor double"])
    factors = df.sparkSession.createDataFrame([(*(r[d] for d in dims), float(a / b)) for r, a, b in zip(table, after, before, strict=True)], schema)
    return df.join(F.broadcast(factors), dims).withColumn(weight, F.col(weight) * F.col("_factor")).drop("_factor"), info


def fidelity(df: DataFrame, targets: DataFrame, dims: Sequence[str], weight: str = "weight") -> DataFrame:
    """attribute, tae, max_deviation, srmse, worst_level, worst_deviation (signed) against targets (attribute, level, share)."""
    got = all_marginals(df, dims, weight).withColumnRenamed("share", "got")
    both = targets.where(F.col("attribute").isin(*dims)).join(got, ["attribute", "level"], "left").withColumn("d", F.coalesce("got", F.lit(0.0)) - F.col("share"))
    worst = F.max_by(F.struct("level", "d"), F.struct(F.abs("d").alias("size"), F.col("level")))  # ties: the last level
    return both.groupBy("attribute").agg(F.sum(F.abs("d")).alias("tae"), F.max(F.abs("d")).alias("max_deviation"), (F.sqrt(F.avg(F.col("d") * F.col("d"))) / F.avg("share")).alias("srmse"), worst["level"].alias("worst_level"), worst["d"].alias("worst_deviation"))


def joint_divergence(a: DataFrame, b: DataFrame, dims: Sequence[str], weight: str = "weight") -> DataFrame:
    """Half the summed difference of cell shares, over the cells of either."""
    x, y = (cells(df, dims, weight).select(*dims, F.col("share").alias(n)) for df, n in ((a, "sa"), (b, "sb")))
    return x.join(y, list(dims), "full").agg((0.5 * F.sum(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))))).alias("divergence"))


def draw_level(u, levels: Mapping[str, float]):
    """The level whose cumulative share first exceeds u."""
    out, total = F.lit(list(levels)[-1]), 1.0
    for name in reversed(list(levels)[:-1]):
        total = sum(v for k, v in list(levels.items())[: list(levels).index(name) + 1])
        out = F.when(u < total, F.lit(name)).otherwise(out)
    return out


def synthesize_independent(spark, size: int, targets: Mapping[str, Mapping[str, float]], seed: int, traits: Sequence[str] = ()) -> DataFrame:
    """agent_id, attributes drawn each from its own marginal, traits uniform, weight 1."""
    _checked(targets)
    agents = spark.range(size).withColumnRenamed("id", "agent_id")
    for name, levels in targets.items():
        agents = agents.withColumn(name, draw_level(hash_u(seed, name, F.col("agent_id")), levels))
    for name in traits:
        agents = agents.withColumn(f"trait_{name}", hash_u(seed + 1, name, F.col("agent_id")))
    return agents.withColumn("weight", F.lit(1.0))
