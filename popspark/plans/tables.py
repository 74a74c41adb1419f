"""The test tables as panels, targets and question banks; each binding also as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import Taxonomy, band

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EDGES, BANDS = (0, 2000, 4000, 6000, 8000), ("0-2k", "2k-4k", "4k-6k", "6k-8k", "8k+")
LENGTHS, LENGTH_BANDS = (0, 500, 1500, 4000), ("short", "medium", "long", "very long")
TAXONOMY = Taxonomy({"region": REGIONS, "segment": SEGMENTS, "balance_band": BANDS})
K = len(PRIORITIES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))


def panel_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: region, segment, balance_band, balance; weight: orders; p: their shares of order priorities."""
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("weight"), *[F.sum((F.col("o_orderpriority") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(PRIORITIES)])
    rows = read(spark, sf_dir, "customer").join(F.broadcast(nations(spark, sf_dir)), F.col("c_nationkey") == F.col("nation")).join(counts, F.col("c_custkey") == F.col("o_custkey"))
    p = F.array(*[F.col(f"n{i}") / F.col("weight") for i in range(K)])
    return rows.select(F.col("c_custkey").alias("agent_id"), "nation", "region", F.col("c_mktsegment").alias("segment"), band(F.col("c_acctbal"), EDGES, BANDS).alias("balance_band"), F.col("c_acctbal").alias("balance"), "weight", p.alias("p"))


def panel_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: lang, source, length_band, weight 1 + doc_id % 3."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("agent_id"), "lang", "source", band(F.col("n_chars"), LENGTHS, LENGTH_BANDS).alias("length_band"), (1 + F.col("doc_id") % 3).cast("double").alias("weight"))


def sample_d(spark: SparkSession, sf_dir: str, item: str = "quality") -> DataFrame:
    """Labelled documents of panel_d with p, one-hot in the item's two answers."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("agent_id"), F.col(item).alias("answer"))
    one_hot = F.array(*[(F.col("answer") == i).cast("double") for i in (0, 1)])
    return panel_d(spark, sf_dir).join(labels, "agent_id").withColumn("p", F.when(F.col("answer").isNotNull(), one_hot))


def bank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by nation: question_id, group_id, option_ix, topline, n, se."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = orders.groupBy(F.col("c_nationkey").alias("question_id")).agg(F.count("*").alias("n"), *[F.sum((F.col("o_orderpriority") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(PRIORITIES)])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("option_ix"), (F.col(f"n{i}") / F.col("n")).alias("topline")) for i in range(K)]))
    long = sums.select("question_id", "n", pairs.alias("x")).select("question_id", "n", "x.*")
    grouped = long.join(F.broadcast(nations(spark, sf_dir)), F.col("question_id") == F.col("nation")).withColumnRenamed("region", "group_id").drop("nation")
    return grouped.withColumn("se", F.sqrt(F.col("topline") * (1 - F.col("topline")) / F.col("n")))


_case = lambda c, edges, labels: "CASE " + " ".join(f"WHEN {c} >= {e} THEN '{x}'" for e, x in reversed(list(zip(edges, labels, strict=True)))) + " END"
PANEL_C = f"""nations AS (SELECT n_nationkey AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
counts AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS weight, {", ".join(f"CAST(sum(CASE WHEN o_orderpriority = '{x}' THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}" for i, x in enumerate(PRIORITIES))} FROM orders GROUP BY o_custkey),
panel AS (SELECT c_custkey AS agent_id, nation, region, c_mktsegment AS segment, {_case("c_acctbal", EDGES, BANDS)} AS balance_band, c_acctbal AS balance, weight, {", ".join(f"n{i} / weight AS p{i}" for i in range(K))}
  FROM customer JOIN nations ON c_nationkey = nation JOIN counts ON c_custkey = o_custkey)"""
PANEL_D = f"""panel AS (SELECT doc_id AS agent_id, lang, source, {_case("n_chars", LENGTHS, LENGTH_BANDS)} AS length_band, CAST(1 + doc_id % 3 AS DOUBLE) AS weight FROM documents),
sample AS (SELECT panel.*, CASE WHEN quality = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p0, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p1, quality FROM panel JOIN labels ON agent_id = doc_id WHERE quality IS NOT NULL)"""
BANK_Q = "nq AS (SELECT n_nationkey AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey), qc AS (SELECT c_nationkey AS question_id, o_orderpriority, count(*) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), qn AS (SELECT question_id, sum(m) AS n FROM qc GROUP BY 1), opts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(PRIORITIES)) + ") o(option_ix, option)), bank AS (SELECT qn.question_id, region AS group_id, CAST(n AS BIGINT) AS n, option_ix, coalesce(m, 0) / n::DOUBLE AS topline, sqrt(coalesce(m, 0) / n::DOUBLE * (1 - coalesce(m, 0) / n::DOUBLE) / n) AS se FROM qn CROSS JOIN opts LEFT JOIN qc ON qc.question_id = qn.question_id AND o_orderpriority = option JOIN nq ON nation = qn.question_id)"
U = lambda *parts: "(CAST(('0x' || substr(sha256(concat_ws('|', " + ", ".join(parts) + ")), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"
