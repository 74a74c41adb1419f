"""Distances between estimated and published answers, calibration, skill, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def question_scores(rows: DataFrame, *key: str) -> DataFrame:
    """rows: key (question_id unless given), option_ix, p, t, se (may be null). A row a question with all distances."""
    key = key or ("question_id",)
    d = F.col("p") - F.col("t")
    running = F.sum(d).over(Window.partitionBy(*key).orderBy("option_ix"))
    out = rows.withColumn("d", d).withColumn("run", running).groupBy(*key).agg(
        F.avg(F.abs("d")).alias("mae"),
        F.max(F.abs("d")).alias("max_error"),
        (0.5 * F.sum(F.abs("d"))).alias("total_variation"),
        F.sum(F.abs("run")).alias("_emd"),
        F.count("*").alias("_k"),
        F.sum(F.col("d") * F.col("d")).alias("brier"),
        (-F.sum(F.col("t") * F.ln(F.greatest("p", F.lit(1e-12))))).alias("log_score"),
        F.avg((F.abs("d") <= 1.96 * F.col("se")).cast("double")).alias("within_interval"),
    )
    return out.withColumn("earth_mover", F.when(F.col("_k") < 2, 0.0).otherwise(F.col("_emd") / F.greatest(F.col("_k") - 1, F.lit(1)))).drop("_emd", "_k")


def coverage(rows: DataFrame) -> DataFrame:
    """rows: t, low, high. Share of published values inside their interval, ends included."""
    return rows.agg(F.avg(F.col("t").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"))


def skill(error: Column, baseline: Column) -> Column:
    """1 - error / baseline; without a baseline error 0 if there is no error, else minus infinity."""
    return F.when(baseline > 0, 1 - error / F.nullif(baseline, F.lit(0.0))).when(error <= 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))


def bins(value: Column, n: int = 10) -> Column:
    """The bin of a share, counted by edges i / n that it reaches; 1 falls into the last."""
    return F.least(sum((F.when(value >= i / n, 1).otherwise(0) for i in range(1, n)), F.lit(0)), F.lit(n - 1))


def reliability(rows: DataFrame, n: int = 10) -> DataFrame:
    """bin, mean_p, mean_t, rows for every bin (rows: p, t)."""
    got = rows.groupBy(bins(F.col("p"), n).alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("t").alias("mean_t"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").fillna(0, subset=["rows"])


def calibration_error(rows: DataFrame, n: int = 10) -> DataFrame:
    table = reliability(rows, n)
    return table.agg((F.sum(F.col("rows") * F.abs(F.col("mean_p") - F.col("mean_t"))) / F.sum("rows")).alias("ece"))


def correlation(a: str, b: str) -> Column:
    """0 where either is flat (the built-in corr divides by its spread and fails there), null for two rows or fewer."""
    flat = F.least(F.stddev_pop(a), F.stddev_pop(b)) <= 1e-9
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.when(F.count("*") > 2, F.when(flat, 0.0).otherwise(F.covar_pop(a, b) / spread))


def experiment_summary(rows: DataFrame, least: float = 0.03) -> DataFrame:
    """rows: gap_p, gap_t. Mean error of the gaps; share of right signs where the published gap is at least `least`; correlation of more than two."""
    big = F.abs("gap_t") >= least
    return rows.agg(
        F.avg(F.abs(F.col("gap_p") - F.col("gap_t"))).alias("gap_mae"),
        F.avg(F.when(big, (F.signum("gap_p") == F.signum("gap_t")).cast("double"))).alias("gap_sign"),
        correlation("gap_p", "gap_t").alias("gap_correlation"),
        F.count("*").alias("experiments"),
    )


def gates(spark: SparkSession, metrics: dict[str, float | None], rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """metric, bound, value, holds for rules (metric, 'min' or 'max', bound). A missing metric fails."""
    rows = []
    for name, kind, bound in rules:
        value = metrics.get(name)
        rows.append((name, kind, float(bound), None if value is None else float(value), value is not None and (value >= bound if kind == "min" else value <= bound)))
    return spark.createDataFrame(rows, "metric string, kind string, bound double, value double, holds boolean")
