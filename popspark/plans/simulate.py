"""One simulation: a population, its fit, every arm's answer, contrasts, and a record that repeats."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..contracts import Parts
from ..functions.taxonomy import Taxonomy
from ..lineage import cut
from ..operators import cost, estimate, raking, synthesis, weighted
from ..sources.cache import ResponseCache
from ..sources.targets import Targets
from ..spec import Spec
from .predict import Predictions, Question, predict

#: Largest error of any share that a population may have.
TOLERANCE = 1e-6


@dataclass
class Result:
    spec: Spec
    population: DataFrame
    predictions: Predictions
    meter: cost.Meter
    fingerprint: str
    fidelity: list[dict]
    rows: list[dict] = field(default_factory=list)
    contrasts: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)

    def share(self, option: str, arm: str | None = None) -> float:
        arm = arm or next(iter(self.spec.scenario.questions()))
        return next(r["share"] for r in self.rows if r["arm"] == arm and r["option"] == option)

    def gap(self, option: str, reference: str, other: str) -> float:
        return self.share(option, other) - self.share(option, reference)

    def record(self) -> dict:
        """Provenance and results; equal for equal spec, seed and population."""
        rounded = lambda rows: [{k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
        return {
            "name": self.spec.name, "seed": self.spec.seed, "spec": self.spec.fingerprint(), "population": self.fingerprint,
            "key": f"{self.spec.fingerprint()}:{self.spec.seed}:{self.fingerprint}",
            "fidelity": rounded(self.fidelity), "predictions": rounded(self.rows), "contrasts": rounded(self.contrasts), "diagnostics": rounded(self.diagnostics), "cost": self.meter.as_dict(),
        }

    def to_json(self) -> str:
        return json.dumps(self.record(), indent=2, sort_keys=True)


def synthesize(spark: SparkSession, spec: Spec, targets: Targets, microdata: DataFrame | None) -> DataFrame:
    """From microdata where the spec names it, else every attribute from its own marginal; raked and scaled either way."""
    block, wanted = spec.population, targets.subset(spec.population.attributes)
    if block.source == "marginals" and block.microdata:
        if microdata is None:
            raise ValueError("the spec names microdata: none given")
        return synthesis.from_microdata(spark, microdata, block.size, wanted.marginals, spec.seed, block.traits, wanted.population_total)
    drawn = raking.synthesize_independent(spark, block.size, wanted.marginals, spec.seed, block.traits)
    return synthesis.scaled(raking.rake(drawn, wanted.marginals)[0], wanted.population_total)


def checked_fit(population: DataFrame, targets: Targets, attributes) -> list[dict]:
    """tae, max_deviation and srmse an attribute; an error where the population misses its targets."""
    rows = [r.asDict() for r in raking.fidelity(population, targets.frame(population.sparkSession), attributes).orderBy("attribute").collect()]
    bad = [r["attribute"] for r in rows if r["max_deviation"] > TOLERANCE]
    if bad:
        raise RuntimeError(f"the population misses its targets for {', '.join(bad)}: a level that no drawn agent has, or targets that the seed can't meet together")
    return rows


def run(spark: SparkSession, spec: Spec, taxonomy: Taxonomy, targets: Targets, microdata: DataFrame | None = None, complete=None, prices=cost.PRICES, parts: Parts = Parts()) -> Result:
    """The spec's arms over one population. complete: the provider (see sources.provider), none for the offline one; parts: the user's own in place of built-in ones."""
    population = weighted.check_weights(cut((parts.synthesizer or synthesize)(spark, spec, targets, microdata), "population"))
    fit = checked_fit(population, targets, spec.population.attributes)
    arms, scenario = spec.scenario.questions(), spec.scenario
    questions = [Question(arm, scenario.question_id, text, scenario.options, scenario.context) for arm, text in arms.items()]
    meter, budget, model = cost.Meter(), cost.Budget(spec.budget.max_usd, spec.budget.max_calls), spec.predictor.provider
    ask = {}
    if complete is not None:
        cache = ResponseCache(spark, model.cache_dir, model.model) if model.cache_dir else None
        ask = dict(complete=complete, cache=cache, meter=meter, budget=budget, model=model.model, prices=prices, max_tokens=model.max_tokens, batch_size=model.batch_size, concurrency=model.max_concurrency)
    found = predict(population, questions, spec, dict(taxonomy.attributes), ask=ask, parts=parts)
    if not ask:
        budget.check(meter, found.calls)
        meter.calls += found.calls
    result = Result(spec, population, found, meter, synthesis.fingerprint(population), fit)
    place = {q.id: i for i, q in enumerate(questions)}
    if found.usable is not None:
        result.diagnostics = [r.asDict() for r in sorted(found.usable.collect(), key=lambda r: place[r["question_id"]])]
    for r in sorted(found.intervals(spec.estimator.level).collect(), key=lambda r: (place[r["question_id"]], r["option_ix"])):
        result.rows.append({"arm": r["question_id"], "option": scenario.options[r["option_ix"]], "share": r["share"], "low": r["low"], "high": r["high"]})
    first = questions[0].id
    for q in questions[1:]:
        if found.draws is not None:
            pair = [found.draws.where(found.draws["question_id"] == arm).drop("question_id") for arm in (first, q.id)]
            rows = [r.asDict() for r in estimate.contrast(*pair, spec.estimator.level).orderBy("option_ix").collect()]
        else:  # without draws nothing resolves
            gaps = [result.gap(o, first, q.id) for o in scenario.options]
            rows = [{"option_ix": i, "difference": d, "low": d, "high": d, "resolves": False} for i, d in enumerate(gaps)]
        result.contrasts += [{"arm": q.id, "reference": first, "option": scenario.options[r.pop("option_ix")], **r} for r in rows]
    return result
