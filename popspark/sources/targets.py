"""Target marginals and question banks from JSON files, validated on reading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import Taxonomy

MARGINALS = "source map<string,string>, universe string, population_total double, records long, marginals map<string,map<string,double>>"
QUESTION = "id:string,text:string,options:array<string>,topline:array<double>,standard_error:array<double>,n:long,effective_n:double,experiment:string,arm_label:string,segments:map<string,map<string,array<double>>>"
BANK = f"year long, weight_variable string, questions array<struct<{QUESTION}>>, experiments array<struct<id:string,label:string,arms:array<string>,contrast_option:string>>"


def validate(marginals: Mapping[str, Mapping[str, float]], taxonomy: Taxonomy) -> None:
    """Every attribute known, its levels complete, its shares adding up to 1."""
    for name, shares in marginals.items():
        if name not in taxonomy.attributes:
            raise ValueError(f"unknown attribute {name}")
        if set(shares) != set(taxonomy.attributes[name]):
            raise ValueError(f"targets of {name} cover {sorted(shares)} instead of {sorted(taxonomy.attributes[name])}")
        if abs(sum(shares.values()) - 1) > 1e-6:
            raise ValueError(f"targets of {name} add up to {sum(shares.values()):.8f}")


class Targets:
    """Published shares by attribute, in the taxonomy's order, and the number of people they stand for."""

    def __init__(self, marginals: Mapping[str, Mapping[str, float]], taxonomy: Taxonomy, population_total: float | None = None):
        validate(marginals, taxonomy)
        self.marginals = {a: {x: float(shares[x]) for x in taxonomy.attributes[a]} for a, shares in marginals.items()}
        self.taxonomy, self.population_total = taxonomy, population_total

    @classmethod
    def load(cls, spark: SparkSession, path: str, taxonomy: Taxonomy) -> Targets:
        row = spark.read.schema(MARGINALS).json(path, multiLine=True).first()
        if row is None or row["marginals"] is None:
            raise ValueError(f"no marginals in {path}")
        return cls(row["marginals"], taxonomy, row["population_total"])

    def subset(self, attributes: Sequence[str]) -> Targets:
        missing = [a for a in attributes if a not in self.marginals]
        if missing:
            raise KeyError(f"no targets for {', '.join(missing)}")
        return Targets({a: self.marginals[a] for a in attributes}, self.taxonomy, self.population_total)

    def vector(self, attribute: str) -> list[float]:
        return list(self.marginals[attribute].values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """attribute, level, level_ix, share."""
        rows = [(a, x, i, share) for a, levels in self.marginals.items() for i, (x, share) in enumerate(levels.items())]
        return spark.createDataFrame(rows, "attribute string, level string, level_ix int, share double")


class QuestionBank:
    """questions: question_id, group_id, text, option_ix, option, topline, se, n, effective_n (a row an option); experiments: a row each."""

    def __init__(self, questions: DataFrame, experiments: DataFrame, segments: DataFrame | None = None):
        self.questions, self.experiments, self.segments = questions, experiments, segments

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuestionBank:
        raw = spark.read.schema(BANK).json(path, multiLine=True)
        items = raw.select(F.explode("questions").alias("q")).select("q.*")
        ragged = items.where((F.size("options") != F.size("topline")) | (F.size("options") != F.size("standard_error"))).select("id").limit(5).collect()
        if ragged:
            raise ValueError(f"options and answers differ in number: {[r['id'] for r in ragged]}")
        experiments = raw.select(F.explode("experiments").alias("e")).select("e.*")
        cls._check_experiments(items, experiments)
        key = [F.col("id").alias("question_id"), F.coalesce("experiment", "id").alias("group_id")]
        # options, toplines and errors are of one length: checked above
        wide = items.select(*key, "text", "arm_label", "n", "effective_n", F.posexplode(F.arrays_zip("options", "topline", "standard_error")).alias("option_ix", "x"))
        questions = wide.select("question_id", "group_id", "text", "arm_label", "option_ix", F.col("x.options").alias("option"), F.col("x.topline").alias("topline"), F.col("x.standard_error").alias("se"), "n", "effective_n")
        by_dimension = items.select(key[0], F.explode("segments").alias("dimension", "levels"))
        by_level = by_dimension.select("question_id", "dimension", F.explode("levels").alias("level", "shares"))
        segments = by_level.select("question_id", "dimension", "level", F.posexplode("shares").alias("option_ix", "share"))
        return cls(questions, experiments, segments)

    @staticmethod
    def _check_experiments(items: DataFrame, experiments: DataFrame) -> None:
        arms = experiments.select("id", "contrast_option", F.explode("arms").alias("arm"))
        both = arms.join(items.select(F.col("id").alias("arm"), "options"), "arm", "left")
        bad = both.groupBy("id").agg(
            F.count_if(F.col("options").isNull()).alias("unknown"),
            F.count_if(~F.array_contains("options", F.col("contrast_option"))).alias("absent"),
            F.count_distinct("options").alias("sets"),
        )
        for r in bad.where("unknown > 0 or absent > 0 or sets > 1").limit(5).collect():
            raise ValueError(f"experiment {r['id']}: " + ("an unknown arm" if r["unknown"] else "the contrast is not an option" if r["absent"] else "arms with different options"))

    def split(self, held_out: Sequence[str]) -> tuple[QuestionBank, QuestionBank]:
        """(the rest, the questions of the groups held out), each with its own segments and experiments."""
        held = F.col("group_id").isin(*held_out)

        def part(questions: DataFrame) -> QuestionBank:
            ids = questions.select("question_id", "group_id").distinct()
            segments = self.segments and self.segments.join(ids.select("question_id"), "question_id", "left_semi")
            return QuestionBank(questions, self.experiments.join(ids, self.experiments["id"] == ids["group_id"], "left_semi"), segments)

        return part(self.questions.where(~held)), part(self.questions.where(held))

    def gaps(self) -> DataFrame:
        """id, gap: the second arm's published share of the contrast option less the first's."""
        arms = self.experiments.select("id", F.col("contrast_option").alias("option"), F.posexplode("arms").alias("arm", "question_id")).where("arm < 2")
        both = arms.join(self.questions.select("question_id", "option", "topline"), ["question_id", "option"])
        return both.groupBy("id").agg((F.max(F.when(F.col("arm") == 1, F.col("topline"))) - F.max(F.when(F.col("arm") == 0, F.col("topline")))).alias("gap"))
