"""Parts of a user's own: registered predictors and propagators, and a synthesizer, world and estimator of one run."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from popspark import contracts
from popspark import spec as specs
from popspark.functions.taxonomy import Taxonomy
from popspark.operators import weighted
from popspark.plans import backtest, simulate
from popspark.plans.predict import Question, predict
from popspark.publish import report
from popspark.sources.targets import Targets

LEVELS = {"g": ("a", "b")}
TARGETS = Targets({"g": {"a": 0.5, "b": 0.5}}, Taxonomy(LEVELS), 10.0)
ASKED = [Question("one", "x", "Is it?", ("yes", "no")), Question("two", "x", "Which?", ("r", "s", "t"))]


def given(**over):
    base = {"name": "s", "scenario": {"question_id": "q", "options": ["yes", "no"], "prompt": "Is it?"}, "population": {"attributes": ["g"], "size": 10}, "predictor": {"stratify_by": ["g"], "archetypes": 4}, "estimator": {"dimensions": ["g"], "draws": 0}}
    return specs.from_dict(specs.merge(base, over))


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(i, "ab"[i % 2], 1.0 + i % 2) for i in range(10)], "agent_id long, g string, weight double")


@pytest.fixture
def named():
    """Registers parts for one test."""
    added = []

    def add(registry, name, part):
        registry.add(name, part)
        added.append((registry, name))

    yield add
    for registry, name in added:
        del registry[name]


def first_option(population, questions, spec, k):
    """Agents of level a choose the first option, others the last."""
    p = F.array(*[(F.lit(i) == F.when(F.col("g") == "a", 0).otherwise(k - 1)).cast("double") for i in range(k)])
    return population.withColumn("question_id", F.explode(F.array(*[F.lit(q.id) for q in questions]))).withColumn("p", p)


def shares(found):
    return {(r["question_id"], r["option_ix"]): round(r["share"], 9) for r in found.shares.collect()}


def test_a_registered_predictor(people, named):
    with pytest.raises(specs.SpecError, match="kind is one of"):
        given(predictor={"kind": "firsts"})
    named(contracts.predictors, "firsts", first_option)
    found = predict(people, ASKED, given(predictor={"kind": "firsts"}), LEVELS)
    third = round(1 / 3, 9)
    assert shares(found) == {("one", 0): third, ("one", 1): round(2 / 3, 9), ("two", 0): third, ("two", 1): 0.0, ("two", 2): round(2 / 3, 9)}
    assert found.calls == 0 and found.draws is None
    for taken in ("firsts", "hybrid"):
        with pytest.raises(ValueError, match="taken"):
            contracts.predictors.add(taken, first_option)


def test_a_registered_propagator(people, named):
    def all_last(population, sample, spec, levels, k):
        return population.withColumn("p", F.array(*[F.lit(float(i == k - 1)) for i in range(k)]))

    named(contracts.propagators, "last", all_last)
    found = predict(people, ASKED[:1], given(predictor={"propagator": "last", "trait_noise": 0.0}, estimator={"poststratify": False}), LEVELS)
    assert shares(found) == {("one", 0): 0.0, ("one", 1): 1.0}


def test_world_and_estimator_of_a_users_own(people, named):
    named(contracts.predictors, "firsts", first_option)
    swapped = lambda population, spec, k: population.withColumn("p", F.reverse("p"))
    unweighted = lambda responses, spec, k: weighted.weighted_distribution(responses.withColumn("weight", F.lit(1.0)), "p", k, by=["question_id"])
    spec = given(predictor={"kind": "firsts"})
    assert shares(predict(people, ASKED[:1], spec, LEVELS, parts=contracts.Parts(world=swapped))) == {("one", 0): round(2 / 3, 9), ("one", 1): round(1 / 3, 9)}
    assert shares(predict(people, ASKED[:1], spec, LEVELS, parts=contracts.Parts(estimator=unweighted))) == {("one", 0): 0.5, ("one", 1): 0.5}
    one_sided = lambda responses, spec, k: responses.select("question_id", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("option_ix")).distinct().withColumn("share", (F.col("option_ix") == 0).cast("double"))
    carried = predict(people, ASKED[:1], given(), LEVELS, parts=contracts.Parts(estimator=one_sided))
    assert shares(carried) == {("one", 0): 1.0, ("one", 1): 0.0}


def test_a_synthesizer_of_a_users_own_and_dated_reports(spark, people):
    def made(spark, spec, targets, microdata):
        return people.withColumn("weight", F.lit(1.0))

    result = simulate.run(spark, given(), Taxonomy(LEVELS), TARGETS, parts=contracts.Parts(synthesizer=made))
    assert result.population.count() == 10 and abs(sum(r["share"] for r in result.rows) - 1) < 1e-9
    at = datetime(2020, 2, 29, 23, tzinfo=UTC)
    assert "2020-02-29" in report.markdown(result, at) and "<p>2020-02-29</p>" in report.html(result, at) and "2020-02-29" in report.accuracy([], at=at)


def test_engines_of_a_users_own(spark, people):
    rows = [(q, "x", "Is it?", i, o, 0.5, 0.01) for q in ("one", "two") for i, o in enumerate(("yes", "no"))]
    bank = spark.createDataFrame(rows, "question_id string, group_id string, text string, option_ix int, option string, topline double, se double")
    base = given().to_dict()
    out = backtest.run(spark, base, {"even": {"predictor": {"kind": "uniform"}}}, bank, lambda spec: people, LEVELS)
    assert {(r["engine"], r["p"]) for r in out.collect()} == {("even", 0.5)}
    with pytest.raises(ValueError, match="unknown engines: even"):
        backtest.run(spark, base, ["even"], bank, lambda spec: people, LEVELS)
