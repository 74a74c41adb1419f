"""Many questions in one job: engines answer a list of questions over one population."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts
from ..functions import answers
from ..operators import estimate, graph, propagate, sampling, weighted
from ..operators.weighted import cells
from ..sources import provider
from ..spec import Spec

UNPOOLED = 1e-6


@dataclass(frozen=True)
class Question:
    id: str
    group: str
    text: str
    options: tuple[str, ...]
    context: str = ""


@dataclass
class Predictions:
    """shares: question_id, option_ix, share; draws: question_id, draw, option_ix, share, or None where none are claimed; calls made; usable: question_id, asked, usable, failure_rate, where a provider was asked."""

    shares: DataFrame
    draws: DataFrame | None = None
    calls: int = 0
    usable: DataFrame | None = None

    def intervals(self, level: float) -> DataFrame:
        """shares with low and high: equal-tailed quantiles of the draws, of no width without draws."""
        if self.draws is None:
            return self.shares.withColumns({"low": F.col("share"), "high": F.col("share")})
        low, high = estimate.interval("share", level)
        return self.shares.join(self.draws.groupBy("question_id", "option_ix").agg(low.alias("low"), high.alias("high")), ["question_id", "option_ix"])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _uniform(like: DataFrame, questions: Sequence[Question]) -> DataFrame:
    rows = [(q.id, i, 1 / len(q.options)) for q in questions for i in range(len(q.options))]
    return like.sparkSession.createDataFrame(rows, "question_id string, option_ix int, share double")


def prior(bank: DataFrame) -> DataFrame:
    """question_id, option_ix, share: the mean of toplines with as many options in all other groups, renormalised; uniform without any.

    bank: question_id, group_id, option_ix, topline. Sums of all less sums of the group: groups are never paired.
    """
    sized = bank.join(bank.groupBy("question_id").agg(F.count("*").alias("k")), "question_id")
    own = sized.groupBy("group_id", "k", "option_ix").agg(F.sum("topline").alias("s"), F.count("*").alias("n"))
    every = own.groupBy("k", "option_ix").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = own.join(every, ["k", "option_ix"]).withColumn("left", F.col("all_n") - F.col("n"))
    mean = F.when(F.col("left") > 0, (F.col("all_s") - F.col("s")) / F.nullif("left", F.lit(0))).otherwise(1 / F.col("k"))
    shares = rest.select("group_id", "k", "option_ix", mean.alias("m"))
    total = shares.groupBy("group_id", "k").agg(F.sum("m").alias("total"))
    asked = sized.select("question_id", "group_id", "k", "option_ix")
    return asked.join(shares.join(total, ["group_id", "k"]), ["group_id", "k", "option_ix"]).select("question_id", "option_ix", (F.col("m") / F.col("total")).alias("share"))


def _offline(agents: DataFrame, questions: Sequence[Question], attributes: Sequence[str], k: int) -> DataFrame:
    """agents x questions with p by the offline provider: the questions are a literal of the plan."""
    asked = F.explode(F.array(*[F.struct(F.lit(q.id).alias("question_id"), F.lit(provider.system_text(q.text, q.options, q.context)).alias("_system")) for q in questions]))
    wide = agents.withColumn("_q", asked).select("*", "_q.*").drop("_q")
    prompt = F.concat(F.lit("Profile: "), answers.persona(attributes))
    return wide.withColumn("p", answers.stub_weights(F.col("_system"), prompt, k)).drop("_system")


def _answers(agents: DataFrame, questions: Sequence[Question], spec: Spec, k: int, ask: dict) -> DataFrame:
    attributes = spec.population.attributes
    if ask.get("complete") is None:
        return _offline(agents, questions, attributes, k)
    return _union([provider.respond(agents, attributes, q.text, q.options, context=q.context, **ask).withColumn("question_id", F.lit(q.id)) for q in questions])


def _carried(population: DataFrame, sample: DataFrame, spec: Spec, levels: dict[str, Sequence[str]], k: int, own_world: contracts.World | None = None) -> DataFrame:
    """One question's answers carried from the sample to everyone."""
    kind, dims, traits = spec.predictor.propagator, list(spec.predictor.stratify_by), [f"trait_{t}" for t in spec.population.traits]
    plain = sample.drop("question_id")
    if kind in contracts.propagators:
        everyone = contracts.propagators[kind](population, plain, spec, levels, k)
    elif kind == "mean":
        everyone = propagate.by_mean(population, plain, k)
    elif kind == "cell_mean":
        everyone = propagate.by_cell(population, plain, dims, k)
    else:
        used = {a: levels[a] for a in spec.population.attributes if a in levels}
        everyone = propagate.Softmax(used, traits).fit(plain, k).predict(population)
    everyone = propagate.trait_noise(everyone, traits, spec.predictor.trait_noise, spec.seed + 2, k)
    if own_world is not None:
        return own_world(everyone, spec, k)
    world = spec.world
    if world.network.enabled and world.dynamics.enabled:
        edges = graph.build(population, world.network.dimensions or spec.population.attributes[:1], world.network.mean_degree, world.network.homophily, spec.seed)
        moved = graph.influence(everyone, edges, world.dynamics.rounds, world.dynamics.confidence, world.dynamics.susceptibility, k)
        everyone = everyone.drop("p").join(moved, "agent_id")
    return everyone


def predict(population: DataFrame, questions: Sequence[Question], spec: Spec, levels: dict[str, Sequence[str]], bank: DataFrame | None = None, ask: dict | None = None, parts: contracts.Parts = contracts.Parts()) -> Predictions:
    """All questions by the spec's predictor and estimator, with one pass over the population a number of options.

    population: agent_id, attributes, trait_*, weight. Poststratified estimates come from the measured sample and the
    population's cells alone; carrying answers to every agent, and influence, are planned only where the estimate uses them.
    A world or an estimator of the user's own works on every agent's answers, so these are always carried then; a registered
    predictor answers for every agent by itself. Estimators of the user's own claim no draws.
    """
    ask, kind = ask or {}, spec.predictor.kind
    if kind in ("uniform", "classical"):
        return Predictions(_uniform(population, questions))
    if kind == "prior":
        if bank is None:
            raise ValueError("the prior needs a question bank")
        return Predictions(prior(bank).where(F.col("question_id").isin(*[q.id for q in questions])))
    by_k: dict[int, list[Question]] = {}
    for q in questions:
        by_k.setdefault(len(q.options), []).append(q)
    hybrid = kind == "hybrid"
    asked = sampling.stratified(population, spec.predictor.archetypes, spec.predictor.stratify_by, spec.seed, "agent_id") if hybrid else population
    size = asked.count()
    dims = list(spec.estimator.dimensions)
    shares, draws, usable = [], [], []

    def measure(responses: DataFrame, k: int) -> DataFrame:
        if parts.estimator is not None:
            return parts.estimator(responses, spec, k).select("question_id", "option_ix", "share")
        return weighted.weighted_distribution(responses, "p", k, by=["question_id"])

    for k, some in by_k.items():
        own = contracts.predictors.get(kind)
        sample = own(asked, some, spec, k) if own else _answers(asked, some, spec, k, ask)
        if hybrid and spec.estimator.poststratify and parts.world is None and parts.estimator is None:
            wanted = cells(population, dims).withColumn("question_id", F.explode(F.array(*[F.lit(q.id) for q in some])))
            counts = estimate.evidence(wanted, sample, dims, k, by=["question_id"])
            posterior = estimate.pooled(counts, k, None if spec.estimator.mrp else UNPOOLED, by=["question_id"])
            shares.append(estimate.topline(posterior, k, by=["question_id"]))
            if spec.estimator.draws:
                draws.append(estimate.draws(posterior, dims, k, spec.estimator.draws, spec.seed, by=["question_id"]))
        elif hybrid:
            everyone = [_carried(population, sample.where(F.col("question_id") == q.id), spec, levels, k, parts.world).withColumn("question_id", F.lit(q.id)) for q in some]
            shares.append(_union([measure(e, k) for e in everyone]))
        else:
            # dropping agents without a usable answer would weigh the population anew
            full = provider.filled(sample, k, ["question_id"])
            if parts.world is not None:
                full = _union([parts.world(full.where(F.col("question_id") == q.id).drop("question_id"), spec, k).withColumn("question_id", F.lit(q.id)) for q in some])
            shares.append(measure(full, k))
        if ask.get("complete") is not None:
            usable.append(provider.diagnostics(sample, ["question_id"]))
    return Predictions(_union(shares), _union(draws) if draws else None, 0 if kind in contracts.predictors else size * len(questions), _union(usable) if usable else None)
