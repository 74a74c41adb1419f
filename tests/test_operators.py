"""Properties of the iterative and stochastic operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.functions import answers
from popspark.functions.taxonomy import Taxonomy, band
from popspark.operators import estimate, graph, propagate, raking, sampling, score
from popspark.sources.cache import ResponseCache


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "b", "c"][rng.integers(3)], ["x", "y"][rng.integers(2)], float(rng.integers(1, 5))) for i in range(400)]
    return spark.createDataFrame(rows, "agent_id long, g string, h string, weight double").cache()


def test_rake_hits_both_margins(panel):
    targets = {"g": {"a": 0.5, "b": 0.3, "c": 0.2}, "h": {"x": 0.9, "y": 0.1}}
    raked, info = raking.rake(panel, targets)
    assert info.converged and info.max_deviation <= 1e-9
    for d in targets:
        total = raked.agg(F.sum("weight")).first()[0]
        for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] / total - targets[d][r[d]]) < 1e-8


def test_rake_refuses_bad_targets(panel):
    with pytest.raises(ValueError, match="add up"):
        raking.rake(panel, {"g": {"a": 0.5, "b": 0.3, "c": 0.3}})
    with pytest.raises(ValueError, match="without a target"):
        raking.rake(panel, {"g": {"a": 0.5, "b": 0.5}})


def test_sampling_does_not_depend_on_partitions(panel):
    a = {r[0] for r in sampling.stratified(panel.repartition(1), 30, ["g"], 3, "agent_id").select("agent_id").collect()}
    b = {r[0] for r in sampling.stratified(panel.repartition(13), 30, ["g"], 3, "agent_id").select("agent_id").collect()}
    assert a == b and len(a) == 30


def test_graph_is_symmetric_without_loops_and_homophilous(panel):
    edges = graph.build(panel, ["g"], 8, 0.9, 5).cache()
    assert edges.where("src = dst").count() == 0
    assert edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).count() == edges.count() == edges.distinct().count()
    assert graph.homophily(edges, panel.withColumn("label", F.col("g"))).first()[0] > 0.7


def test_influence_narrows_and_keeps_sums(panel):
    answered = panel.withColumn("p", F.array((F.col("agent_id") % 10) / 10, 1 - (F.col("agent_id") % 10) / 10))
    edges = graph.build(panel, ["g"], 8, 0.5, 5)
    assert graph.influence(answered, edges, 0, 0.5, 0.5, 2).count() == 400
    moved = graph.influence(answered, edges, 2, 0.5, 0.5, 2)
    before, after = (df.agg(F.stddev(F.col("p")[0])).first()[0] for df in (answered, moved))
    assert after < before
    assert moved.where(F.abs(F.col("p")[0] + F.col("p")[1] - 1) > 1e-9).count() == 0


def test_softmax_reproduces_cell_shares_without_penalty(spark):
    rows = [(i, "a" if i % 2 else "b", 1.0, [0.8, 0.2] if i % 2 else [0.3, 0.7]) for i in range(40)]
    sample = spark.createDataFrame(rows, "agent_id long, g string, weight double, p array<double>")
    fitted = propagate.Softmax({"g": ("a", "b")}, penalty=1e-9).fit(sample, 2).predict(sample.drop("p"))
    got = {r["g"]: r["p"][0] for r in fitted.collect()}
    assert got["a"] == pytest.approx(0.8, abs=1e-6) and got["b"] == pytest.approx(0.3, abs=1e-6)


def test_draws_are_seeded_and_centred(panel):
    sample = panel.where("agent_id < 120").withColumn("p", F.array(F.lit(0.3), F.lit(0.7)))
    post = estimate.poststratified(panel, sample, ["g", "h"], 2)
    a = estimate.draws(post, ["g", "h"], 2, 300, 7)
    b = estimate.draws(post.repartition(5), ["g", "h"], 2, 300, 7)
    assert a.exceptAll(b.withColumn("share", F.col("share"))).count() < 10  # the same draws but for the order of sums
    assert a.where("option_ix = 1").agg(F.avg("share")).first()[0] == pytest.approx(0.7, abs=0.02)
    assert not any(r["resolves"] for r in estimate.contrast(a, a).collect())


def test_answers_parse(spark):
    cases = [('{"yes": 1, "no": 3}', [0.25, 0.75]), ('well {"yes": true} ok', [1.0, 0.0]), ('{"yes": -1, "no": 2}', [0.0, 1.0]), ("nothing", None), ('{"other": 1}', None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", answers.parse_answer(F.col("t"), ["yes", "no"]).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_bands_and_violations(spark):
    df = spark.createDataFrame([(17.0,), (18.0,), (65.0,), (None,)], "age double")
    assert [r[0] for r in df.select(band(F.col("age"), (18, 65), ("adult", "old"))).collect()] == [None, "adult", "old", None]
    tax = Taxonomy({"g": ("a", "b")})
    bad = tax.violations(spark.createDataFrame([("a",), ("z",), (None,)], "g string"), "g")
    assert [tuple(r) for r in bad.collect()] == [("z", 1)] and tax.cell_count(["g"]) == 2


def test_skill_and_bins(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.0, 0.0), (0.1, 0.0)], "e double, b double")
    assert [r[0] for r in df.select(score.skill(F.col("e"), F.col("b"))).collect()] == [0.5, 0.0, float("-inf")]
    edges = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "p double")
    assert [r[0] for r in edges.select(score.bins(F.col("p"))).collect()] == [0, 3, 9]


def test_cache_keeps_the_last_entry(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path), "m/1")
    asked = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert cache.lookup(asked)[1].count() == 2
    row = lambda t: spark.createDataFrame([("k1", t, 1, 1, 0, 0)], "key string, text string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    cache.append(row("old"))
    cache.append(row("new"))
    hits, misses = cache.lookup(asked)
    assert [r["text"] for r in hits.collect()] == ["new"] and [r[0] for r in misses.collect()] == ["k2"]
