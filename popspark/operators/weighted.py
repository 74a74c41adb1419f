"""Weighted aggregates: marginals, cells, means, distributions, design effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """df, once its weights are known to be there, finite, not negative and of a positive sum; an error says which isn't so. One pass over the column."""
    if weight not in df.columns:
        raise ValueError(f"the population has no column {weight}")
    w = F.col(weight).cast("double")
    odd = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    found = df.agg(F.count_if(odd).alias("odd"), F.count_if(w < 0).alias("negative"), F.sum(F.when(~odd, w)).alias("total")).first()
    if found["odd"]:
        raise ValueError("weights must be finite")
    if found["negative"]:
        raise ValueError("weights must not be negative")
    if not (found["total"] or 0) > 0:
        raise ValueError("weights must have a positive sum")
    return df


def item_records(df: DataFrame, items: Mapping[str, Sequence[str]], dims: Sequence[str] = (), weight: str = "weight", least: int = 100, least_segment: int = 60) -> DataFrame:
    """item, dimension, level, option_ix, option, share, n, n_eff, se: every item's published record, all items in one job.

    items: column -> its options in order. Rows without an answer among them, or without a positive weight, don't count.
    Items of fewer than `least` rows are left out; dimension and level are null for all rows together, else a segment of
    at least `least_segment` rows. se, of all rows only, is by Kish's effective size.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.array_position(F.array(*[F.lit(o) for o in names]), F.col(i)).cast("int").alias("place")) for i, names in items.items()]))
    w = F.col(weight).cast("double")
    rows = df.where(w > 0).select(pairs.alias("x"), w.alias("w"), *dims).select("x.*", "w", *dims).where("place > 0")
    cuts = F.array(F.struct(F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("string").alias("level")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dims])
    long = rows.select("item", "place", "w", F.explode(cuts).alias("c")).select("item", "place", "w", "c.*").where("dimension is null or level is not null")
    sums = long.groupBy("item", "dimension", "level", "place").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.count("*").alias("n"))
    whole = sums.groupBy("item", "dimension", "level").agg(F.sum("w").alias("total"), F.sum("w2").alias("squares"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("by"))
    enough = whole.where(F.col("n") >= F.when(F.col("dimension").isNull(), least).otherwise(least_segment))
    known = enough.where("dimension is null").select("item")
    names = df.sparkSession.createDataFrame([(i, j + 1, o) for i, options in items.items() for j, o in enumerate(options)], "item string, place int, option string")
    wide = enough.join(F.broadcast(known), "item").join(F.broadcast(names), "item")  # a row an item, and a row an option
    share = F.coalesce(F.element_at("by", F.col("place")), F.lit(0.0)) / F.col("total")
    n_eff = F.col("total") * F.col("total") / F.col("squares")
    return wide.select(
        "item", "dimension", "level", (F.col("place") - 1).alias("option_ix"), "option", share.alias("share"), "n", n_eff.alias("n_eff"),
        F.when(F.col("dimension").isNull(), standard_error(share, n_eff)).alias("se"),
    )


def shares(grouped: DataFrame, weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """A grouped table (a row a level or cell) with each row's share of the weight, within by."""
    return grouped.withColumn("share", F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))


def marginals(df: DataFrame, dim: str, weight: str = "weight") -> DataFrame:
    """level, share: without null levels."""
    sums = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("level")).agg(F.sum(weight).alias("weight"))
    return shares(sums).select("level", "share")


def all_marginals(df: DataFrame, dims: Sequence[str], weight: str = "weight") -> DataFrame:
    """attribute, level, share: all dimensions in one pass and one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("attribute"), F.col(d).cast("string").alias("level")) for d in dims]))
    long = df.select(pairs.alias("x"), F.col(weight).alias("weight")).select("x.*", "weight").where("level is not null")
    return shares(long.groupBy("attribute", "level").agg(F.sum("weight").alias("weight")), by=["attribute"]).drop("weight")


def cells(df: DataFrame, dims: Sequence[str], weight: str = "weight") -> DataFrame:
    """dims, weight, share: occupied cells, without those with a null dimension."""
    return shares(df.dropna(subset=list(dims)).groupBy(*dims).agg(F.sum(weight).cast("double").alias("weight")))


def cell_index(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """df with the position of its cell in the order of dims. Cells are few; they meet in one window."""
    ids = df.select(*dims).dropna().distinct().withColumn("cell_id", F.row_number().over(Window.orderBy(*dims)) - 1)
    return df.join(ids, list(dims))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def weighted_distribution(df: DataFrame, p: str, k: int, weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """by, option_ix, share: the weighted mean of vectors; rows without a vector don't count."""
    used = df.where(F.col(p).isNotNull())
    sums = used.groupBy(*by).agg(F.sum(weight).alias("_w"), *[F.sum(F.col(weight) * F.col(p)[i]).alias(f"_{i}") for i in range(k)])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("option_ix"), (F.col(f"_{i}") / F.col("_w")).alias("share")) for i in range(k)]))
    return sums.select(*by, pairs.alias("x")).select(*by, "x.*")


def weighted_shares(df: DataFrame, value: str, levels: Sequence, weight: str = "weight") -> DataFrame:
    """level, share among the given levels; null shares if nothing falls into them."""
    sums = df.where(F.col(value).isin(*levels)).agg(F.sum(weight).alias("_w"), *[F.sum(F.when(F.col(value) == level, F.col(weight)).otherwise(0)).alias(f"_{i}") for i, level in enumerate(levels)])
    pairs = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), (F.col(f"_{i}") / F.col("_w")).alias("share")) for i, level in enumerate(levels)]))
    return sums.select(pairs.alias("x")).select("x.*")


def kish(weight: Column) -> Column:
    """Effective sample size over finite positive weights; 0 without any."""
    w = F.when((weight > 0) & (weight < float("inf")), weight.cast("double"))
    return F.coalesce(F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w), F.lit(0.0))


def standard_error(share: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n))
