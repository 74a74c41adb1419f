"""Checks, fills, records, extracts and names of cells."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.functions import harmonize
from popspark.functions.taxonomy import Taxonomy
from popspark.operators import estimate, graph, propagate, raking, weighted
from popspark.sources import extracts, provider
from popspark.sources.cache import NullCache, ResponseCache
from popspark.sources.targets import QuestionBank, Targets

CELLS = [("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None)]


def test_draws_keep_cells_whose_joined_names_collide(spark):
    rows = [(*cell, 0.25, 2.0, 0.5, 0.5, float(i), 1.0) for i, cell in enumerate(CELLS)]
    posterior = spark.createDataFrame(rows, "x string, y string, share double, alpha double, mu0 double, mu1 double, c0 double, c1 double")
    sums = estimate.draws(posterior, ["x", "y"], 2, 50, 3).groupBy("draw").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 50 and all(r["s"] == pytest.approx(1) for r in sums)
    assert estimate.draws(posterior.repartition(3), ["x", "y"], 2, 50, 3).count() == 100


def test_graph_keeps_cells_whose_joined_names_collide(spark):
    agents = spark.createDataFrame([(i, *CELLS[i % 2]) for i in range(200)], "agent_id long, x string, y string")
    edges = graph.build(agents, ["x", "y"], 6, 1.0, 5).collect()
    assert edges and all(r["src"] % 2 == r["dst"] % 2 for r in edges)


def test_concentration_at_its_bound(spark):
    same = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0)], "x int, c0 double, c1 double")
    unlike = spark.createDataFrame([(1, 9.0, 1.0), (2, 3.0, 7.0)], "x int, c0 double, c1 double")
    assert {r["at_bound"] for r in estimate.pooled(same, 2).collect()} == {True}
    assert {r["at_bound"] for r in estimate.pooled(unlike, 2).collect()} == {False}
    assert {r["at_bound"] for r in estimate.pooled(same, 2, 1e4).collect()} == {False}


def test_noise_without_traits(spark):
    agents = spark.range(4000).select(F.col("id").alias("agent_id"), F.array(F.lit(0.5), F.lit(0.5)).alias("p"))
    got = propagate.trait_noise(agents, [], 0.5, 3, 2)
    rows = {r["agent_id"]: r["p"] for r in got.collect()}
    assert all(sum(p) == pytest.approx(1) for p in rows.values())
    shift = [math.log(p[1] / p[0]) for p in rows.values()]
    assert abs(np.mean(shift)) < 0.05 and np.std(shift) == pytest.approx(0.5 * 2**0.5, rel=0.05)
    assert rows == {r["agent_id"]: r["p"] for r in propagate.trait_noise(agents.repartition(5), [], 0.5, 3, 2).collect()}
    assert propagate.trait_noise(agents, [], 0.0, 3, 2) is agents
    with pytest.raises(ValueError, match="trait_q"):
        propagate.trait_noise(agents, ["trait_q"], 0.5, 3, 2)


def test_unknown_fields_and_missing_columns_are_named(spark):
    frame = spark.createDataFrame([("a", [1.0, 0.0], 1.0)], "x string, p array<double>, weight double")
    with pytest.raises(ValueError, match="zz"):
        propagate.Softmax({"zz": ("a", "b")}).fit(frame, 2)
    with pytest.raises(ValueError, match="SCHL"):
        harmonize.census(frame.select(*[F.lit(1).alias(c) for c in ("AGEP", "SEX", "RAC1P", "MAR", "PWGTP")]))
    with pytest.raises(ValueError, match="degree.*wt"):
        harmonize.survey(frame.select(*[F.lit(1).alias(c) for c in ("age", "sex", "race", "marital")]), "wt")


@pytest.mark.parametrize(("values", "message"), [([1.0, float("nan")], "finite"), ([1.0, float("inf")], "finite"), ([1.0, None], "finite"), ([2.0, -1.0], "negative"), ([0.0, 0.0], "positive sum"), ([], "positive sum")])
def test_weights_are_checked(spark, values, message):
    with pytest.raises(ValueError, match=message):
        weighted.check_weights(spark.createDataFrame([(v,) for v in values], "weight double"))


def test_good_weights_pass_and_a_missing_column_is_named(spark):
    good = spark.createDataFrame([(1.0,), (0.0,)], "weight double")
    assert weighted.check_weights(good) is good
    with pytest.raises(ValueError, match="no column w"):
        weighted.check_weights(good, "w")


def test_unusable_answers_are_filled_by_question(spark):
    rows = [("q", 1, [0.2, 0.8]), ("q", 2, None), ("q", 3, [0.6, 0.4]), ("r", 1, [1.0, 0.0])]
    got = provider.filled(spark.createDataFrame(rows, "question_id string, agent_id int, p array<double>"), 2, ["question_id"])
    found = {(r["question_id"], r["agent_id"]): r["p"] for r in got.collect()}
    assert len(found) == 4 and found["q", 2] == pytest.approx([0.4, 0.6])
    with pytest.raises(ValueError, match="no usable answers"):
        provider.filled(spark.createDataFrame([(1, None)], "agent_id int, p array<double>"), 2)


def test_cache_counters_and_the_null_cache(spark, tmp_path):
    asked = spark.createDataFrame([("k1",), ("k2",)], "key string")
    cache, null = ResponseCache(spark, str(tmp_path), "m"), NullCache(spark)
    assert cache.hit_rate == 0 and len(cache) == 0
    cache.append(spark.createDataFrame([("k1", "t", 1, 1, 0, 0)], "key string, text string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"))
    cache.record(asked.count(), cache.lookup(asked)[1].count())
    assert (cache.hits, cache.misses, cache.hit_rate, len(cache)) == (1, 1, 0.5, 1)
    null.append(asked)
    assert len(null) == 0 and null.lookup(asked)[1].count() == 2 and null.lookup(asked)[0].count() == 0


def test_worst_level_of_a_fit(spark):
    frame = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "x string, weight double")
    targets = spark.createDataFrame([("x", "a", 0.6), ("x", "b", 0.2), ("x", "c", 0.2)], "attribute string, level string, share double")
    row = raking.fidelity(frame, targets, ["x"]).first()
    assert row["worst_level"] == "c" and row["worst_deviation"] == pytest.approx(-0.2)


def test_split_keeps_segments_and_experiments(spark):
    questions = spark.createDataFrame([("a1", "e"), ("a2", "e"), ("b", "b")], "question_id string, group_id string")
    experiments = spark.createDataFrame([("e", ["a1", "a2"])], "id string, arms array<string>")
    segments = spark.createDataFrame([("a1", "sex"), ("b", "sex")], "question_id string, dimension string")
    rest, held = QuestionBank(questions, experiments, segments).split(["e"])
    assert (rest.questions.count(), rest.experiments.count(), [r["question_id"] for r in rest.segments.collect()]) == (1, 0, ["b"])
    assert (held.questions.count(), held.experiments.count(), [r["question_id"] for r in held.segments.collect()]) == (2, 1, ["a1"])


def test_item_records_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["x", "y", "z", "?"])), None if rng.random() < 0.3 else str(rng.choice(["u", "v"])), str(rng.choice(["m", "f"])), float(rng.integers(-1, 4))) for _ in range(400)]
    rows += [("x", None, "rare", 1.0)] * 5
    items = {"one": ["x", "y", "z", "never"], "two": ["u", "v"], "three": ["w"]}
    frame = spark.createDataFrame([(*r, None) for r in rows], "one string, two string, sex string, weight double, three string")
    got = {(r["item"], r["dimension"], r["level"], r["option"]): r for r in weighted.item_records(frame, items, ["sex"]).collect()}
    want = {}
    for at, (item, options) in enumerate(list(items.items())[:2]):
        for dimension, level in ((None, None), ("sex", "m"), ("sex", "f"), ("sex", "rare")):
            used = [(r[at], r[3]) for r in rows if r[at] in options and r[3] > 0 and (level is None or r[2] == level)]
            if len(used) >= (100 if level is None else 60):
                total = sum(w for _, w in used)
                for o in options:
                    share = sum(w for a, w in used if a == o) / total
                    n_eff = total**2 / sum(w * w for _, w in used)
                    want[item, dimension, level, o] = (share, len(used), n_eff, (share * (1 - share) / n_eff) ** 0.5 if level is None else None)
    assert set(got) == set(want) and ("one", "sex", "rare", "x") not in got
    for key, (share, n, n_eff, se) in want.items():
        r = got[key]
        assert (r["share"], r["n"], r["n_eff"]) == (pytest.approx(share), n, pytest.approx(n_eff)) and (r["se"] is None if se is None else r["se"] == pytest.approx(se))


def test_zipped_csv_and_what_is_published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extracts, "CHUNK_ROWS", 2)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p1.csv", "id,sex,w\n1,1,2\n2,2,3\n3,,1\n")
        z.writestr("p2.csv", "w,id,sex\n5,4,2\n")
        z.writestr("read.txt", "no")
    rows = extracts.zipped_csv(spark, [str(tmp_path / "a.zip")], ["id", "w", "sex"])
    assert sorted((r["id"], r["w"]) for r in rows.collect()) == [(1.0, 2.0), (2.0, 3.0), (3.0, 1.0), (4.0, 5.0)]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("read.txt", "no")
    with pytest.raises(Exception, match="no CSV"):
        extracts.zipped_csv(spark, [str(tmp_path / "b.zip")], ["id"])
    people = rows.where("sex is not null").select("id", F.when(F.col("sex") == 1, "male").otherwise("female").alias("sex"), F.col("w").alias("weight"))
    levels = {"sex": ("male", "female")}
    made = extracts.write_marginals(people, levels, str(tmp_path / "marginals.json"), {"name": "test"}, "adults")
    assert made["records"] == 3 and made["marginals"]["sex"] == pytest.approx({"male": 0.2, "female": 0.8})
    targets = Targets.load(spark, str(tmp_path / "marginals.json"), Taxonomy(levels))
    assert targets.vector("sex") == pytest.approx([0.2, 0.8]) and targets.population_total == 10
    assert json.loads(next(iter(spark.read.text(str(tmp_path / "marginals.json")).collect()))["value"])["universe"] == "adults"
    extracts.write_microdata(people, str(tmp_path / "micro"), "id", share=1.0, most=2)
    back = spark.read.option("header", True).csv(str(tmp_path / "micro"))
    assert back.count() == 2 and back.columns == ["sex", "weight"]
