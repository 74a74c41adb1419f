"""From a sample's answers to everyone's: mean, cell means, softmax regression, baselines, trait noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash_u


def mean_vector(sample: DataFrame, k: int, weight: str | None = "weight") -> DataFrame:
    """One row with p, the (weighted) mean of the usable vectors."""
    w = F.col(weight) if weight else F.lit(1.0)
    return sample.where("p is not null").agg(F.array(*[F.sum(w * F.col("p")[i]) / F.sum(w) for i in range(k)]).alias("p"))


def by_mean(agents: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    return agents.join(F.broadcast(mean_vector(sample, k)))  # one row


def by_cell(agents: DataFrame, sample: DataFrame, dims: Sequence[str], k: int, weight: str = "weight") -> DataFrame:
    """Agents with the mean of their cell's sample, or of all the sample where the cell has none."""
    means = sample.where("p is not null").groupBy(*dims).agg(F.array(*[F.sum(F.col(weight) * F.col("p")[i]) / F.sum(weight) for i in range(k)]).alias("_cell"))
    return agents.join(means, list(dims), "left").join(F.broadcast(mean_vector(sample, k, weight).withColumnRenamed("p", "_all"))).withColumn("p", F.coalesce("_cell", "_all")).drop("_cell", "_all")


def uniform(k: int) -> Column:
    return F.array_repeat(F.lit(1.0 / k), k)


def prior(bank: DataFrame) -> DataFrame:
    """options, option_ix, share: the plain mean of toplines with as many options (bank: question_id, option_ix, topline)."""
    sized = bank.join(bank.groupBy("question_id").agg(F.count("*").alias("options")), "question_id")
    return sized.groupBy("options", "option_ix").agg(F.avg("topline").alias("share"))


class Softmax:
    """L2 softmax regression on one-hot attributes (first level left out) and traits, by Newton's method on the driver.

    The sample holds a few hundred rows by construction; agents are predicted by column expressions.
    """

    def __init__(self, levels: dict[str, Sequence[str]], traits: Sequence[str] = (), penalty: float = 1.0, most: int = 100):
        self.levels, self.traits, self.penalty, self.most = levels, list(traits), penalty, most

    def features(self) -> list[Column]:
        return [(F.col(a) == x).cast("double") for a, levels in self.levels.items() for x in levels[1:]] + [F.col(t).cast("double") for t in self.traits]

    def fit(self, sample: DataFrame, k: int, weight: str = "weight") -> Softmax:
        require(sample, [*self.levels, *self.traits], "the sample")
        rows = sample.where("p is not null").select(F.array(*self.features()).alias("x") if self.features() else F.array().cast("array<double>").alias("x"), "p", F.col(weight).cast("double").alias("w")).collect()
        if not rows:
            raise ValueError("no usable answers")
        x = np.array([[1.0, *r["x"]] for r in rows])
        p, w = np.array([r["p"] for r in rows], dtype=float), np.array([r["w"] for r in rows])
        self.live = [i for i in range(k) if (p[:, i] * w).sum() > 1e-9]
        self.k, m, f = k, len(self.live), x.shape[1]
        target = p[:, self.live]
        mass = target.sum(1) * w
        penal = np.full(f, self.penalty)
        penal[0] = 0.0
        beta = np.zeros((m, f))
        for _ in range(self.most):
            z = x @ beta.T
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            grad = ((q * mass[:, None] - target * w[:, None]).T @ x) + penal * beta
            h = np.zeros((m * f, m * f))
            for a in range(m):
                for b in range(m):
                    h[a * f : (a + 1) * f, b * f : (b + 1) * f] = (x * (mass * q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x
            h += np.diag(np.tile(penal, m)) + 1e-9 * np.eye(m * f)
            step = np.linalg.solve(h, grad.ravel()).reshape(m, f)
            beta -= step
            if np.abs(step).max() < 1e-12:
                break
        self.beta = beta
        return self

    def predict(self, agents: DataFrame) -> DataFrame:
        require(agents, [*self.levels, *self.traits], "the population")
        columns = self.features()
        z = [F.lit(float(b[0])) + sum((F.lit(float(c)) * f for c, f in zip(b[1:], columns, strict=True)), F.lit(0.0)) for b in self.beta]
        top = F.greatest(*z) if len(z) > 1 else z[0]
        e = [F.exp(v - top) for v in z]
        total = sum(e[1:], e[0])
        at = {i: v / total for i, v in zip(self.live, e, strict=True)}
        return agents.withColumn("p", F.array(*[at.get(i, F.lit(0.0)) for i in range(self.k)]))


def require(df: DataFrame, columns: Sequence[str], what: str = "the table") -> None:
    """An error that names the columns df lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")


def _shifted(agents: DataFrame, shift: Sequence[Column], k: int) -> DataFrame:
    z = [F.ln(F.greatest(F.col("p")[i], F.lit(1e-12))) + shift[i] for i in range(k)]
    top = F.greatest(*z)
    e = [F.exp(v - top) for v in z]
    total = sum(e[1:], e[0])
    return agents.withColumn("p", F.array(*[v / total for v in e]))


def trait_noise(agents: DataFrame, traits: Sequence[str], scale: float, seed: int, k: int, key: str = "agent_id") -> DataFrame:
    """Log answers shifted by centred traits times normal loadings, then renormalised; a scale of 0 changes nothing.

    Without traits every agent and option has a normal shift of its own, by hash of the agent's key.
    """
    if scale <= 0:
        return agents
    if not traits:
        radius = lambda i: F.sqrt(-2 * F.ln(1 - hash_u(seed, "radius", F.col(key), F.lit(i))))
        angle = lambda i: 2 * math.pi * hash_u(seed, "angle", F.col(key), F.lit(i))
        return _shifted(agents, [scale * radius(i) * F.cos(angle(i)) for i in range(k)], k)
    require(agents, traits, "the population")
    loading = np.random.default_rng(seed).normal(size=(len(traits), k))
    means = agents.agg(*[F.avg(t).alias(f"_m{j}") for j, t in enumerate(traits)])
    wide = agents.join(F.broadcast(means))  # one row
    shift = [scale * sum(((F.col(t) - F.col(f"_m{j}")) * float(loading[j, i]) for j, t in enumerate(traits)), F.lit(0.0)) for i in range(k)]
    return _shifted(wide, shift, k).drop(*[f"_m{j}" for j in range(len(traits))])


def trait(name: str, seed: int, key: str = "agent_id") -> Column:
    return hash_u(seed + 1, name, F.col(key))
