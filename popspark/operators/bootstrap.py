"""Bootstrap draws: the sample drawn again with replacement, refitted, and carried to the frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import hash_u
from .weighted import cells


def multiplicities(sample: DataFrame, draws: int, seed: int, key: str = "agent_id") -> DataFrame:
    """draw, key, times: n picks out of n rows for every draw.

    A sample is a few hundred archetypes by construction, so its rows are numbered in one window; the picks are spread
    over draws.
    """
    numbered = sample.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("number"), F.count("*").over(Window.partitionBy()).alias("n"))
    picks = numbered.select("n", F.col("number").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    hit = F.least(F.floor(hash_u(seed, "bootstrap", F.col("draw"), F.col("i")) * F.col("n")), F.col("n") - 1).alias("number")
    return picks.select("draw", hit).groupBy("draw", "number").agg(F.count("*").alias("times")).join(F.broadcast(numbered.select(key, "number")), "number").select("draw", key, "times")


def draws(frame: DataFrame, sample: DataFrame, dims: Sequence[str], k: int, n: int, seed: int, key: str = "agent_id", weight: str = "weight") -> DataFrame:
    """draw, option_ix, share for cell means over dims (no dims: the plain mean).

    Cell means are linear in the frame's cells, so a draw needs the cells' shares and never a pass over agents. A cell
    that a draw leaves empty takes the draw's mean of all.
    """
    used = sample.where("p is not null").select(key, "p", F.col(weight).cast("double").alias("w"), *dims)
    drawn = multiplicities(used, n, seed, key).join(F.broadcast(used), key).withColumn("w", F.col("w") * F.col("times"))
    vector = F.array(*[F.sum(F.col("w") * F.col("p")[i]) / F.sum("w") for i in range(k)])
    all_ = drawn.groupBy("draw").agg(vector.alias("all"))
    if not dims:
        return all_.select("draw", F.posexplode("all").alias("option_ix", "share"))
    shares = cells(frame, dims, weight).select(*dims, "share")
    # every draw meets every cell of the frame: draws x cells rows, both small by declaration
    wanted = shares.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = drawn.groupBy("draw", *dims).agg(vector.alias("own"))
    filled = wanted.join(own, ["draw", *dims], "left").join(all_, "draw").withColumn("p", F.coalesce("own", "all"))
    sums = filled.groupBy("draw").agg(F.array(*[F.sum(F.col("share") * F.col("p")[i]) / F.sum("share") for i in range(k)]).alias("p"))
    return sums.select("draw", F.posexplode("p").alias("option_ix", "share"))


def refitted(frame_cells: DataFrame, sample: DataFrame, refit, k: int, n: int, seed: int, key: str = "agent_id", weight: str = "weight") -> DataFrame:
    """draw, option_ix, share for any refit(sample, cells) -> matrix (a row a cell), in pandas, a group a draw.

    frame_cells: a row a cell with its share. Both tables go to every draw's task: a few hundred rows each.
    """
    import numpy as np
    import pandas as pd

    used = sample.where("p is not null")
    drawn = multiplicities(used, n, seed, key).join(F.broadcast(used), key)
    where = frame_cells.toPandas()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).assign(**{weight: rows[weight] * rows["times"]})
        share = where["share"].to_numpy()
        p = share @ np.asarray(refit(rows, where)) / share.sum()
        return pd.DataFrame({"draw": int(rows["draw"].iloc[0]), "option_ix": np.arange(k), "share": p})

    return drawn.groupBy("draw").applyInPandas(one, "draw int, option_ix int, share double")
