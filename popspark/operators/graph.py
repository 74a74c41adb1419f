"""Homophilous graphs and bounded-confidence influence, on edge lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import hash_u
from ..lineage import cut

#: Buckets that a cell's agents are numbered in.
BUCKETS = 256


def build(agents: DataFrame, dims: Sequence[str], mean_degree: int, homophily: float, seed: int, key: str = "agent_id") -> DataFrame:
    """src, dst: both directions of undirected edges, no loops.

    Every agent proposes max(1, round(mean_degree / 2)) ends: with probability homophily an agent of its own cell, else
    any. Agents are numbered within the cell and overall, so that a hash picks a number and an equi-join the agent.
    Numbering all agents is done by hash bucket and a running sum, not in one window.
    """
    tries = max(1, round(mean_degree / 2))
    cell = F.to_json(F.struct(*dims))  # no two cells share a name
    named = agents.select(F.col(key).alias("id"), cell.alias("cell")).withColumn("bucket", F.floor(hash_u(seed, "bucket", F.col("id")) * BUCKETS).cast("int"))
    groups = named.groupBy("cell", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("cell", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("cell_start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("start", F.coalesce(F.sum("n").over(overall), F.lit(0))).withColumn("cell_size", F.sum("n").over(Window.partitionBy("cell"))).withColumn("size", F.sum("n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("id")) - 1
    numbered = named.withColumn("r", rank).join(starts.drop("n"), ["cell", "bucket"]).select("id", "cell", (F.col("cell_start") + F.col("r")).alias("in_cell"), (F.col("start") + F.col("r")).alias("number"), "cell_size", "size")
    asked = numbered.select("id", "cell", "cell_size", "size", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("k"))
    u = lambda what: hash_u(seed, what, F.col("id"), F.col("k"))
    asked = asked.withColumn("own", u("own") < homophily).withColumn("pick", u("pick"))
    near = asked.where("own").select("id", "cell", F.least(F.floor(F.col("pick") * F.col("cell_size")), F.col("cell_size") - 1).alias("in_cell"))
    far = asked.where("not own").select("id", F.least(F.floor(F.col("pick") * F.col("size")), F.col("size") - 1).alias("number"))
    ends = near.join(numbered.select("cell", "in_cell", F.col("id").alias("other")), ["cell", "in_cell"]).select("id", "other")
    ends = ends.unionByName(far.join(numbered.select("number", F.col("id").alias("other")), "number").select("id", "other"))
    once = ends.where("id <> other").select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()
    return once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def homophily(edges: DataFrame, labels: DataFrame, key: str = "agent_id", label: str = "label") -> DataFrame:
    """Share of edges between equal labels; null without edges."""
    a, b = (labels.select(F.col(key).alias(e), F.col(label).alias(n)) for e, n in (("src", "ls"), ("dst", "ld")))
    return edges.join(a, "src").join(b, "dst").agg(F.avg((F.col("ls") == F.col("ld")).cast("double")).alias("homophily"))


def influence(responses: DataFrame, edges: DataFrame, rounds: int, confidence: float, susceptibility: float, k: int, key: str = "agent_id") -> DataFrame:
    """key, p after the rounds: agents move towards the mean of those neighbours whose answers are near enough (total variation); nobody heard: unchanged.

    The edges, dealt by their end, and each round but the last are written to the shared folder: no round is planned twice.
    """
    now = responses.select(F.col(key).alias("id"), "p")
    if rounds < 1 or susceptibility <= 0:
        return now.withColumnRenamed("id", key)
    edges = cut(edges.repartition("dst"), "edges")
    for i in range(rounds):
        pair = edges.join(now.select(F.col("id").alias("src"), F.col("p").alias("own")), "src").join(now.select(F.col("id").alias("dst"), F.col("p").alias("other")), "dst")
        far = F.aggregate(F.zip_with("own", "other", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2
        heard = pair.where(far <= confidence).groupBy("src").agg(*[F.avg(F.col("other")[j]).alias(f"m{j}") for j in range(k)])
        moved = F.array(*[F.col("p")[j] + susceptibility * (F.col(f"m{j}") - F.col("p")[j]) for j in range(k)])
        now = now.join(heard, now["id"] == heard["src"], "left").select("id", F.when(F.col("m0").isNotNull(), moved).otherwise(F.col("p")).alias("p"))
        if i < rounds - 1:
            now = cut(now, "round")
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    return now.select(F.col("id").alias(key), F.transform("p", lambda x: x / total).alias("p"))
