"""Specs, readers, synthesis, cost, bootstrap, simulations, the grid, reports and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark import __main__ as cli
from popspark import spec as specs
from popspark.functions import harmonize
from popspark.functions.taxonomy import Taxonomy
from popspark.operators import bootstrap, cost, estimate, raking, synthesis, weighted
from popspark.plans import backtest, simulate
from popspark.plans.predict import Question, predict
from popspark.publish import charts, report
from popspark.sources import provider
from popspark.sources.cache import ResponseCache
from popspark.sources.targets import QuestionBank, Targets, validate

LEVELS = {"g": ("a", "b", "c"), "h": ("x", "y")}
TAXONOMY = Taxonomy(LEVELS)
SHARES = {"g": {"a": 0.5, "b": 0.3, "c": 0.2}, "h": {"x": 0.6, "y": 0.4}}


def given(**over):
    base = {
        "name": "s", "seed": 5, "scenario": {"question_id": "q", "options": ["yes", "no"], "arms": [{"id": "one", "prompt": "Is it?"}, {"id": "two", "prompt": "Is it not?"}]},
        "population": {"attributes": ["g", "h"], "size": 500, "traits": ["openness"]},
        "predictor": {"stratify_by": ["g"], "archetypes": 40}, "estimator": {"dimensions": ["g"], "draws": 100},
    }
    return specs.merge(base, over)


@pytest.fixture(scope="module")
def targets():
    return Targets(SHARES, TAXONOMY, 1e6)


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(f"q{i}", f"g{i // 2}", f"Question {i}?", j, o, t, 0.02) for i in range(6) for j, (o, t) in enumerate([("yes", 0.3 + i / 20), ("no", 0.7 - i / 20)])]
    return spark.createDataFrame(rows, "question_id string, group_id string, text string, option_ix int, option string, topline double, se double")


def test_spec_round_trip_and_fingerprint(tmp_path):
    made = specs.from_dict(given())
    for name in ("s.json", "s.yaml"):
        if name.endswith("yaml"):
            pytest.importorskip("yaml")
        specs.dump(made, tmp_path / name)
        assert specs.load(tmp_path / name) == made
    assert made.fingerprint() == specs.from_dict(given()).fingerprint() != specs.from_dict(given(seed=6)).fingerprint()
    assert specs.from_dict(given(scenario={"arms": [], "prompt": "Is it?"})).scenario.questions() == {"default": "Is it?"}


@pytest.mark.parametrize(
    "over, place",
    [
        ({"what": 1}, "unknown keys"),
        ({"population": {"sizes": 3}}, "population: unknown"),
        ({"population": {"size": 0}}, "population: size"),
        ({"population": {"size": "many"}}, "population.size"),
        ({"population": {"size": True}}, "population.size"),
        ({"population": {"attributes": ["g", "g"]}}, "attributes are unique"),
        ({"scenario": {"options": ["yes"]}}, "options"),
        ({"scenario": {"arms": []}}, "a prompt or arms"),
        ({"predictor": {"kind": "magic"}}, "kind"),
        ({"estimator": {"dimensions": ["z"]}}, "estimator.dimensions"),
        ({"world": {"network": {"dimensions": ["z"]}}}, "world.network.dimensions"),
        ({"output": {"formats": ["pdf"]}}, "formats"),
    ],
)
def test_spec_refuses(over, place):
    with pytest.raises(specs.SpecError, match=place):
        specs.from_dict(given(**over))


def test_census_records(spark):
    rows = [("30", "1", "21", "1", "1", "10"), ("17", "1", "21", "1", "1", "10"), ("70", "2", "16", "9", "5", "3"), ("40", "9", "21", "1", "1", "1"), ("40", "1", "21", "1", "1", "0"), ("x", "1", "21", "1", "1", "1"), ("40", "1", "21", None, "1", "1")]
    got = harmonize.census(spark.createDataFrame(rows, "AGEP string, SEX string, SCHL string, RAC1P string, MAR string, PWGTP string")).orderBy("age_band").collect()
    assert [tuple(r) for r in got] == [("25-34", "male", "bachelors", "white", "married", 10.0), ("65+", "female", "high_school", "other", "never_married", 3.0)]


def test_survey_records_keep_items_and_nulls(spark):
    rows = [(2020, 98, 1, 3, 1, 1, 2.0, 8), (2020, 89, 2, 0, 3, 5, 1.0, 1), (2020, 40, 2, 0, 3, 5, None, 1)]
    got = harmonize.survey(spark.createDataFrame(rows, "year int, age int, sex int, degree int, race int, marital int, w double, item int"), "w").orderBy("age").collect()
    assert [(r["age_band"], r["education"], r["item"]) for r in got] == [("65+", "less_than_hs", 1), (None, "bachelors", 8)]


def test_targets_from_file(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"source": {"from": "here"}, "universe": "adults", "population_total": 1000, "records": 9, "marginals": SHARES}, indent=1))
    got = Targets.load(spark, str(path), TAXONOMY)
    assert got.vector("g") == [0.5, 0.3, 0.2] and got.population_total == 1000 and list(got.subset(["h"]).marginals) == ["h"]
    assert got.frame(spark).count() == 5
    with pytest.raises(KeyError):
        got.subset(["z"])
    for bad in ({"z": {"a": 1.0}}, {"h": {"x": 1.0}}, {"h": {"x": 0.6, "y": 0.6}}):
        with pytest.raises(ValueError):
            validate(bad, TAXONOMY)


def _bank_file(path, **over):
    ask = lambda i, t: {"id": i, "text": f"{i}?", "options": ["yes", "no"], "topline": [t, 1 - t], "standard_error": [0.01, 0.01], "n": 100, "effective_n": 90.0, "experiment": "e", "arm_label": i, "segments": {"g": {"a": [t, 1 - t]}}}
    body = {"year": 2020, "weight_variable": "w", "questions": [ask("p", 0.4), ask("q", 0.55)], "experiments": [{"id": "e", "label": "E", "arms": ["p", "q"], "contrast_option": "yes"}]}
    body["experiments"][0].update(over.get("experiment", {}))
    body["questions"][0].update(over.get("question", {}))
    path.write_text(json.dumps(body))
    return str(path)


def test_question_bank(spark, tmp_path):
    got = QuestionBank.load(spark, _bank_file(tmp_path / "b.json"))
    assert got.questions.count() == 4 and got.segments.count() == 4
    assert abs(got.gaps().first()["gap"] - 0.15) < 1e-12
    rest, held = got.split(["e"])
    assert rest.questions.count() == 0 and held.questions.count() == 4
    for i, over in enumerate(({"experiment": {"arms": ["p", "z"]}}, {"experiment": {"contrast_option": "maybe"}}, {"question": {"options": ["yes", "no", "so"]}}, {"question": {"options": ["yes", "so"]}})):
        with pytest.raises(ValueError):
            QuestionBank.load(spark, _bank_file(tmp_path / f"bad{i}.json", **over))


def test_alias_table_keeps_the_law():
    w = np.array([5.0, 0.0, 1.0, 3.0, 1.0])
    keep, alias = synthesis.alias_table(w)
    law = keep.copy()
    np.add.at(law, alias, 1 - keep)
    assert np.allclose(law / len(w), w / w.sum())
    with pytest.raises(ValueError):
        synthesis.alias_table([0.0])


def test_microdata_population(spark, targets):
    seeds = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 1.0), ("b", "y", 3.0), ("c", "x", 2.0), ("c", "y", 0.0), (None, "y", 9.0)], "g string, h string, weight double")
    make = lambda: synthesis.from_microdata(spark, seeds, 1000, SHARES, 3, ["t"], 1e6)
    a = make()
    assert a.count() == 1000 and abs(a.agg(F.sum("weight")).first()[0] - 1e6) < 1e-3
    assert a.where("g = 'c' and h = 'y'").count() == 0
    assert max(r["max_deviation"] for r in simulate.checked_fit(a, targets, ["g", "h"])) < 1e-6
    assert synthesis.fingerprint(a) == synthesis.fingerprint(make().repartition(7)) != synthesis.fingerprint(a.where("agent_id > 0"))


def test_a_population_off_target_is_refused(spark, targets):
    drawn = raking.synthesize_independent(spark, 300, SHARES, 1)
    with pytest.raises(RuntimeError, match="misses its targets for g"):
        simulate.checked_fit(drawn.where("g <> 'c'"), targets, ["g", "h"])


def test_cost_and_budget(spark):
    rows = [("m", False, 1_000_000, 100_000, 1_000_000, 1_000_000), ("m", True, 5, 5, 5, 5), ("free", False, 9, 9, 0, 0)]
    calls = spark.createDataFrame(rows, "model string, cached boolean, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    meter = cost.Meter()
    meter.record(calls, {"m": (2.0, 10.0)})
    assert abs(meter.usd - (2.0 * 2.35 + 1.0)) < 1e-9 and (meter.calls, meter.cached_calls) == (2, 1)
    half = cost.Meter()
    half.record(calls, {"m": (2.0, 10.0)}, batch=True)
    assert abs(half.usd - meter.usd / 2) < 1e-12
    cost.Budget(10, 3).check(meter, 1)
    for budget in (cost.Budget(10, 2), cost.Budget(1, 9)):
        with pytest.raises(cost.BudgetExceeded):
            budget.check(meter, 1)


def test_bootstrap_agrees_with_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], float(1 + i % 3), [float(x) for x in rng.dirichlet([2, 2])]) for i in range(60)]
    sample = spark.createDataFrame(rows, "agent_id long, g string, weight double, p array<double>")
    frame = spark.createDataFrame([(i, "abc"[i % 3], 1.0) for i in range(300)], "agent_id long, g string, weight double")
    times = bootstrap.multiplicities(sample, 20, 9).toPandas()
    assert (times.groupby("draw")["times"].sum() == 60).all()
    got = {(r["draw"], r["option_ix"]): r["share"] for r in bootstrap.draws(frame, sample, ["g"], 2, 20, 9).collect()}
    for draw, part in times.groupby("draw"):
        t = dict(zip(part["agent_id"], part["times"], strict=True))
        mean = lambda g: np.average([r[3][0] for r in rows if r[0] in t and r[1] in g], weights=[r[2] * t[r[0]] for r in rows if r[0] in t and r[1] in g])
        assert abs(got[draw, 0] - (mean("a") + mean("b") + mean("ab")) / 3) < 1e-12

    def refit(drawn, where):
        overall = np.average(np.stack(drawn["p"]), axis=0, weights=drawn["weight"])
        own = {g: np.average(np.stack(x["p"]), axis=0, weights=x["weight"]) for g, x in drawn.groupby("g")}
        return np.stack([own.get(g, overall) for g in where["g"]])

    same = {(r["draw"], r["option_ix"]): r["share"] for r in bootstrap.refitted(weighted.cells(frame, ["g"]).select("g", "share"), sample, refit, 2, 20, 9).collect()}
    assert same.keys() == got.keys() and all(abs(same[x] - got[x]) < 1e-12 for x in got)


def test_responder_uses_cache_and_budget(spark, tmp_path):
    def echo(texts, system, most):
        return [{"text": 'so: {"yes": 3, "no": 1}' if "g: a" in t else "unsure", "input_tokens": 10, "output_tokens": 5, "cache_read_tokens": 0, "cache_write_tokens": 0} for t in texts]

    agents = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "agent_id long, g string")
    cache, meter = ResponseCache(spark, str(tmp_path / "cache"), "m/1"), cost.Meter()
    ask = lambda **more: provider.respond(agents, ["g"], "Is it?", ["yes", "no"], complete=echo, **more)
    first = {r["agent_id"]: r["p"] for r in ask(cache=cache, meter=meter).collect()}
    assert len(first) == 10 and first[0] == [0.75, 0.25] and first[1] is None and (meter.calls, meter.input_tokens) == (2, 20)
    again = {r["agent_id"]: r["p"] for r in ask(cache=cache, meter=meter).collect()}
    assert again == first and meter.calls == 2
    plain = cost.Meter()
    assert ask(meter=plain).count() == 10 and plain.calls == 10
    with pytest.raises(cost.BudgetExceeded):
        ask(meter=cost.Meter(), budget=cost.Budget(1, 9))
    whole = provider.filled(ask(dedupe=True), 2)
    assert whole.where("p[0] = 0.75").count() == 10 and provider.diagnostics(ask()).first()["failure_rate"] == 0.5
    with pytest.raises(ValueError):
        provider.filled(ask().where("g = 'b'"), 2)


def test_batched_estimates_equal_single_ones(spark, targets):
    spec = specs.from_dict(given())
    population = simulate.synthesize(spark, spec, targets, None).cache()
    asked = [Question("one", "g", "Is it?", ("yes", "no")), Question("two", "g", "Is it not?", ("yes", "no")), Question("three", "g", "Which?", ("r", "s", "t"))]
    both = {(r["question_id"], r["option_ix"]): r["share"] for r in predict(population, asked, spec, LEVELS).shares.collect()}
    assert len(both) == 7
    for q in asked:
        alone = predict(population, [q], spec, LEVELS)
        assert all(abs(r["share"] - both[q.id, r["option_ix"]]) < 1e-12 for r in alone.shares.collect())
        assert abs(sum(v for k, v in both.items() if k[0] == q.id) - 1) < 1e-9


@pytest.mark.parametrize("propagator", ["multinomial_logit", "cell_mean", "mean"])
def test_direct_paths(spark, targets, propagator):
    spec = specs.from_dict(given(predictor={"propagator": propagator}, estimator={"poststratify": False, "draws": 0}, world={"network": {"enabled": True}, "dynamics": {"enabled": True, "rounds": 1}}))
    population = simulate.synthesize(spark, spec, targets, None)
    found = predict(population, [Question("one", "g", "Is it?", ("yes", "no"))], spec, LEVELS)
    rows = found.intervals(0.9).collect()
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-9 and all(r["low"] == r["share"] == r["high"] for r in rows)


def test_simulation_repeats_and_publishes(spark, targets, tmp_path):
    spec = specs.from_dict(given())
    one, two = (simulate.run(spark, spec, TAXONOMY, targets) for _ in range(2))
    assert one.record() == two.record() and one.meter.calls == 80
    assert all(r["low"] <= r["share"] <= r["high"] for r in one.rows) and len(one.contrasts) == 2
    assert abs(one.gap("yes", "one", "two") + one.gap("no", "one", "two")) < 1e-9
    files = {p.name: p.read_text() for p in report.publish(one, tmp_path)}
    assert json.loads(files["run.json"])["spec"] == spec.fingerprint()
    assert "| one | yes |" in files["report.md"] and files["report.html"].count("<svg") == 4
    single = simulate.run(spark, specs.from_dict(given(scenario={"arms": [], "prompt": "Is <it>?"}, output={"formats": ["html"]})), TAXONOMY, targets)
    (page,) = report.publish(single, tmp_path / "single")
    assert "Is &lt;it&gt;?" in page.read_text() and not single.contrasts
    with pytest.raises(cost.BudgetExceeded):
        simulate.run(spark, specs.from_dict(given(budget={"max_calls": 10})), TAXONOMY, targets)


def test_grid_scores_skill_and_gates(spark, targets, bank):
    made = []

    def population(spec):
        made.append(spec)
        return simulate.synthesize(spark, spec, targets, None)

    rows = backtest.run(spark, given(), ["uniform", "prior", "hybrid", "hybrid-no-poststrat", "llm-every-agent"], bank, population, LEVELS).cache()
    assert len(made) == 2 and rows.count() == 5 * 12
    experiments = spark.createDataFrame([(f"g{i}", [f"q{2 * i}", f"q{2 * i + 1}"], 0) for i in range(3)], "id string, arms array<string>, contrast_ix int")
    board = {r["engine"]: r for r in backtest.leaderboard(rows, experiments).collect()}
    uniform = np.mean([abs(0.5 - (0.3 + i / 20)) for i in range(6)])
    assert abs(board["uniform"]["mae"] - uniform) < 1e-12 and abs(board["prior"]["skill_mae"]) < 1e-12
    assert abs(board["uniform"]["skill_mae"] - (1 - uniform / board["prior"]["mae"])) < 1e-12
    assert board["uniform"]["interval_coverage"] is None and board["hybrid"]["interval_coverage"] is not None
    assert board["hybrid"]["calls"] == 40 * 6 and board["llm-every-agent"]["calls"] == 600 * 6 and board["uniform"]["gap_mae"] == pytest.approx(0.05)
    missed = {r["metric"] for r in backtest.failures(spark, backtest.leaderboard(rows, experiments), "uniform", True).collect()}
    assert {"questions", "interval_coverage"} <= missed
    assert backtest.worst(rows, "uniform", 2).count() == 2
    text = report.accuracy([r.asDict() for r in board.values()], [r.asDict() for r in backtest.gaps(rows, experiments).collect()])
    assert "Wording experiments" in text
    with pytest.raises(ValueError, match="unknown engines"):
        backtest.run(spark, given(), ["magic"], bank, population, LEVELS)


def test_prior_leaves_its_own_group_out(spark, targets, bank):
    spec = specs.from_dict(given(predictor={"kind": "prior"}))
    asked = backtest.questions_of(bank, ["g0"])
    assert [q.id for q in asked] == ["q0", "q1"] and asked[0].options == ("yes", "no")
    got = {(r["question_id"], r["option_ix"]): r["share"] for r in predict(None, asked, spec, LEVELS, bank).shares.collect()}
    assert abs(got["q0", 0] - np.mean([0.3 + i / 20 for i in range(2, 6)])) < 1e-12 and len(got) == 4


def test_charts_and_cells():
    assert charts.stacked_bar([("<a>", [0.4, 0.6])], ["x", "y"]).count("<rect") == 2
    assert "&lt;a&gt;" in charts.interval_plot([("<a>", 0.1, -0.2, 0.3)], low=-1)
    assert [report.number(v) for v in (None, float("nan"), 1234.5, 0.25, 7, "t", True)] == ["-", "-", "1,234", "0.2500", "7", "t", "True"]


def test_command_line(tmp_path, capsys):
    path = tmp_path / "new.json"
    assert cli.main(["version"]) == 0
    assert cli.main(["new", "mine", "--path", str(path)]) == 0 and cli.main(["new", "mine", "--path", str(path)]) == 1
    assert cli.main(["validate", str(path)]) == 0 and "fingerprint" in capsys.readouterr().out
    path.write_text('{"name": "x"}')
    assert cli.main(["validate", str(path)]) == 1 and "scenario: is required" in capsys.readouterr().err
    assert cli.main(["run", str(tmp_path / "none.json")]) == 1


def test_command_line_runs_and_evaluates(spark, tmp_path, monkeypatch):
    shares = {a: {x: 1 / len(v) for x in v} for a, v in harmonize.LEVELS.items()}
    (tmp_path / "t.json").write_text(json.dumps({"population_total": 1e6, "records": 1, "marginals": shares}))
    body = given(population={"attributes": list(harmonize.LEVELS), "targets": str(tmp_path / "t.json"), "size": 1500}, predictor={"stratify_by": ["sex"]}, estimator={"dimensions": ["sex"]})
    (tmp_path / "s.json").write_text(json.dumps(body))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["run", str(tmp_path / "s.json"), "--out", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/report.html").exists()
    bank = _bank_file(tmp_path / "b.json")
    assert cli.main(["eval", str(tmp_path / "s.json"), "--bank", bank, "--engines", "uniform,hybrid", "--out", str(tmp_path / "ev"), "--check"]) == 1  # too few questions
    assert len(json.loads((tmp_path / "ev/eval.json").read_text())) == 2
    assert cli.main(["eval", str(tmp_path / "s.json"), "--bank", bank, "--engines", "magic"]) == 1


def test_draws_pair_by_question(spark):
    frame = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "g string, share double").withColumn("question_id", F.explode(F.array(F.lit("p"), F.lit("q"))))
    sample = spark.createDataFrame([(i, q, "ab"[i % 2], 1.0, [0.2, 0.8]) for i in range(8) for q in "pq"], "agent_id long, question_id string, g string, weight double, p array<double>")
    post = estimate.pooled(estimate.evidence(frame, sample, ["g"], 2, by=["question_id"]), 2, by=["question_id"])
    drawn = {(r["question_id"], r["draw"], r["option_ix"]): r["share"] for r in estimate.draws(post, ["g"], 2, 10, 1, by=["question_id"]).collect()}
    assert len(drawn) == 40 and all(abs(drawn["p", d, 0] - drawn["q", d, 0]) < 1e-12 for d in range(10))
