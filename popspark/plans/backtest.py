"""The evaluation grid: every engine answers every question; a population is made once for all engines that share it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import score
from ..spec import Spec, from_dict, merge
from .predict import Question, predict

# fixed values: what each engine changes in a base spec
ENGINES: dict[str, dict] = {
    "uniform": {"predictor": {"kind": "uniform"}, "estimator": {"poststratify": False, "draws": 0}},
    "prior": {"predictor": {"kind": "prior"}, "estimator": {"poststratify": False, "draws": 0}},
    "hybrid": {},
    "hybrid-no-poststrat": {"estimator": {"poststratify": False, "draws": 0}},
    "hybrid-no-pooling": {"estimator": {"mrp": False}},
    "hybrid-cell-mean": {"predictor": {"propagator": "cell_mean"}},
    "hybrid-no-structure": {"predictor": {"propagator": "mean"}},
    "hybrid-independent-population": {"population": {"source": "fixture", "microdata": None}},
    "hybrid-with-influence": {"world": {"network": {"enabled": True}, "dynamics": {"enabled": True}}},
    "hybrid-100": {"predictor": {"archetypes": 100}},
    "hybrid-600": {"predictor": {"archetypes": 600}},
    "llm-every-agent": {"population": {"size": 600}, "predictor": {"kind": "llm"}},
}

# fixed values: (metric, 'min' or 'max', bound), for every provider and for real models only
GATES = [("questions", "min", 30), ("mae", "max", 0.16)]
MODEL_GATES = [("skill_mae", "min", 0.15), ("ece", "max", 0.06), ("interval_coverage", "min", 0.70), ("gap_sign", "min", 0.70), ("gap_mae", "max", 0.12)]
SKILLS = ("mae", "total_variation", "brier", "log_score", "gap_mae")
METRICS = ("mae", "max_error", "total_variation", "earth_mover", "brier", "log_score", "within_interval")


def questions_of(bank: DataFrame, only: Sequence[str] = ()) -> list[Question]:
    """The bank's questions in order, of the groups named or all (bank: question_id, group_id, text, option_ix, option)."""
    rows = bank if not only else bank.where(F.col("group_id").isin(*only))
    packed = rows.groupBy("question_id", "group_id", "text").agg(F.sort_array(F.collect_list(F.struct("option_ix", "option"))).alias("o"))
    return [Question(r["question_id"], r["group_id"], r["text"], tuple(x["option"] for x in r["o"])) for r in packed.orderBy("question_id").collect()]


def run(spark: SparkSession, base: Mapping, engines: Sequence[str] | Mapping[str, Mapping], bank: DataFrame, population, levels: Mapping[str, Sequence[str]], only: Sequence[str] = ()) -> DataFrame:
    """engine, question_id, group_id, option_ix, p, t, se, low, high, claims (whether an interval is claimed), calls.

    population(spec) makes a population; engines with equal population block and seed share one. The prior of a question
    is fitted without its group. engines: names of ENGINES, or engines of the user's own as name -> changes to the base spec.
    bank: question_id, group_id, text, option_ix, option, topline, se.
    """
    changes = engines if isinstance(engines, Mapping) else ENGINES
    unknown = sorted(set(engines) - set(changes))
    if unknown:
        raise ValueError(f"unknown engines: {', '.join(unknown)}")
    asked, made, out = questions_of(bank, only), {}, []
    if not asked:
        raise ValueError("no questions to score")
    truth = bank.select("question_id", "group_id", "option_ix", F.col("topline").alias("t"), "se")
    for name in engines:
        spec: Spec = from_dict(merge(base, changes[name]))
        key = (spec.population, spec.seed)
        if key not in made:
            made[key] = cut(population(spec), "population")
        found = predict(made[key], asked, spec, dict(levels), bank)
        rows = found.intervals(spec.estimator.level).withColumnRenamed("share", "p")
        out.append(rows.withColumns({"engine": F.lit(name), "claims": F.lit(found.draws is not None), "calls": F.lit(found.calls).cast("long")}))
    return reduce(DataFrame.unionByName, out).join(F.broadcast(truth), ["question_id", "option_ix"])


def by_question(rows: DataFrame) -> DataFrame:
    return score.question_scores(rows, "engine", "question_id")


def worst(rows: DataFrame, engine: str, n: int = 8) -> DataFrame:
    return by_question(rows.where(F.col("engine") == engine)).orderBy(F.desc("mae"), "question_id").limit(n)


def gaps(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """engine, id, gap_p, gap_t: second arm less first in the contrast option (experiments: id, arms, contrast_ix)."""
    arms = experiments.select("id", F.col("contrast_ix").alias("option_ix"), F.posexplode("arms").alias("arm", "question_id")).where("arm < 2")
    both = rows.join(F.broadcast(arms), ["question_id", "option_ix"])
    of = lambda c, i: F.max(F.when(F.col("arm") == i, F.col(c)))
    return both.groupBy("engine", "id").agg((of("p", 1) - of("p", 0)).alias("gap_p"), (of("t", 1) - of("t", 0)).alias("gap_t"))


def leaderboard(rows: DataFrame, experiments: DataFrame | None = None, against: str = "prior", least: float = 0.03) -> DataFrame:
    """A row an engine, best first: mean scores, calibration, coverage of claimed intervals, gaps, skill against a baseline."""
    means = by_question(rows).groupBy("engine").agg(F.count("*").alias("questions"), *[F.avg(m).alias(m) for m in METRICS])
    covered = F.avg(F.when(F.col("claims"), F.col("t").between(F.col("low"), F.col("high")).cast("double")))
    means = means.join(rows.groupBy("engine").agg(covered.alias("interval_coverage"), F.max("calls").alias("calls")), "engine")
    binned = rows.groupBy("engine", score.bins(F.col("p")).alias("bin")).agg(F.avg("p").alias("a"), F.avg("t").alias("b"), F.count("*").alias("n"))
    means = means.join(binned.groupBy("engine").agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))) / F.sum("n")).alias("ece")), "engine")
    skills = list(SKILLS[:-1])
    if experiments is not None:
        g = gaps(rows, experiments)
        right = F.when(F.abs("gap_t") >= least, (F.signum("gap_p") == F.signum("gap_t")).cast("double"))
        summed = g.groupBy("engine").agg(F.avg(F.abs(F.col("gap_p") - F.col("gap_t"))).alias("gap_mae"), F.avg(right).alias("gap_sign"), score.correlation("gap_p", "gap_t").alias("gap_correlation"))
        means, skills = means.join(summed, "engine", "left"), list(SKILLS)
    base = means.where(F.col("engine") == against).select(*[F.col(m).alias(f"_{m}") for m in skills])
    # at most one row: no baseline among the engines leaves skills null
    scored = means.join(F.broadcast(base), F.lit(True), "left")
    return scored.withColumns({f"skill_{m}": score.skill(F.col(m), F.col(f"_{m}")) for m in skills}).drop(*[f"_{m}" for m in skills]).orderBy("mae", "engine")


def failures(spark: SparkSession, board: DataFrame, engine: str, real_model: bool) -> DataFrame:
    """The gates that the engine misses."""
    row = board.where(F.col("engine") == engine).first()
    return score.gates(spark, row.asDict() if row else {}, GATES + (MODEL_GATES if real_model else [])).where("not holds")
