"""Registry of the survey queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers, harmonize
from .functions.rng import hash_u
from .functions.taxonomy import crosswalk
from .lineage import cut
from .operators import bootstrap, cost, estimate, graph, propagate, raking, sampling, score, synthesis, weighted
from .plans import backtest
from .plans import tables as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
DP = 7


def _query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DP) for c in columns})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- projections, crosswalks, validation

@_query("band_documents", f"WITH {T.PANEL_D} SELECT agent_id, length_band FROM panel")
def _(spark, d):
    return T.panel_d(spark, d).select("agent_id", "length_band")


@_query("crosswalk_regions", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 4 THEN 'south' WHEN 3 THEN 'north' ELSE CASE WHEN n_regionkey IS NOT NULL THEN 'other' END END AS zone FROM nation")
def _(spark, d):
    return T.read(spark, d, "nation").select("n_nationkey", crosswalk(F.col("n_regionkey"), {0: "south", 4: "south", 3: "north"}, "other").alias("zone"))


@_query("harmonize_customers", f"WITH {T.PANEL_C} SELECT agent_id, region, segment, balance_band, weight FROM panel WHERE region IS NOT NULL AND segment IS NOT NULL AND balance_band IS NOT NULL AND weight > 0")
def _(spark, d):
    return T.panel_c(spark, d).dropna(subset=["region", "segment", "balance_band", "weight"]).where("weight > 0").select("agent_id", "region", "segment", "balance_band", "weight")


@_query("levels_violations", "SELECT o_orderpriority AS value, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def _(spark, d):
    from .functions.taxonomy import Taxonomy

    return Taxonomy({"o_orderpriority": T.PRIORITIES[:3]}).violations(T.read(spark, d, "orders"), "o_orderpriority")


@_query("encode_levels", f"WITH {T.PANEL_C} SELECT agent_id, CAST(list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], region) - 1 AS BIGINT) AS code FROM panel")
def _(spark, d):
    return T.panel_c(spark, d).select("agent_id", T.TAXONOMY.code("region", F.col("region")).cast("long").alias("code"))


@_query("persona_text", f"WITH {T.PANEL_C} SELECT agent_id, concat_ws('; ', 'region: ' || region, 'balance band: ' || balance_band) AS persona FROM panel")
def _(spark, d):
    return T.panel_c(spark, d).select("agent_id", answers.persona(["region", "balance_band"]).alias("persona"))


# -- weighted aggregates

@_query("marginals_segment", f"WITH {T.PANEL_C} SELECT segment AS level, round(sum(weight) / (SELECT sum(weight) FROM panel WHERE segment IS NOT NULL), {DP}) AS share FROM panel WHERE segment IS NOT NULL GROUP BY 1")
def _(spark, d):
    return _rounded(weighted.marginals(T.panel_c(spark, d), "segment"), "share")


@_query("marginals_all", f"WITH {T.PANEL_C}, long AS (SELECT 'region' AS attribute, region AS level, weight FROM panel UNION ALL SELECT 'segment', segment, weight FROM panel UNION ALL SELECT 'balance_band', balance_band, weight FROM panel) SELECT attribute, level, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY attribute), {DP}) AS share FROM long WHERE level IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return _rounded(weighted.all_marginals(T.panel_c(spark, d), ["region", "segment", "balance_band"]), "share")


@_query("cells_region_segment", f"WITH {T.PANEL_C} SELECT region, segment, sum(weight) AS weight, round(sum(weight) / sum(sum(weight)) OVER (), {DP}) AS share FROM panel GROUP BY 1, 2")
def _(spark, d):
    return _rounded(weighted.cells(T.panel_c(spark, d), ["region", "segment"]), "share")


@_query("cell_index_customers", f"WITH {T.PANEL_C} SELECT agent_id, CAST(dense_rank() OVER (ORDER BY region, segment) - 1 AS INTEGER) AS cell_id FROM panel")
def _(spark, d):
    return weighted.cell_index(T.panel_c(spark, d), ["region", "segment"]).select("agent_id", "cell_id")


@_query("weighted_mean_balance", f"WITH {T.PANEL_C} SELECT segment, round(sum(balance * weight) / sum(weight), 4) AS mean_balance FROM panel GROUP BY 1")
def _(spark, d):
    return T.panel_c(spark, d).groupBy("segment").agg(F.round(weighted.weighted_mean(F.col("balance"), F.col("weight")), 4).alias("mean_balance"))


@_query("weighted_distribution_priority", f"WITH {T.PANEL_C} " + " UNION ALL ".join(f"SELECT region, {i} AS option_ix, round(sum(weight * p{i}) / sum(weight), {DP}) AS share FROM panel GROUP BY 1" for i in range(T.K)))
def _(spark, d):
    return _rounded(weighted.weighted_distribution(T.panel_c(spark, d), "p", T.K, by=["region"]), "share")


@_query("weighted_shares_quality", f"WITH {T.PANEL_D} SELECT quality AS level, round(sum(weight) / sum(sum(weight)) OVER (), {DP}) AS share FROM sample WHERE quality IN (0, 1) GROUP BY 1")
def _(spark, d):
    return _rounded(weighted.weighted_shares(T.sample_d(spark, d), "answer", [0, 1]), "share")


@_query("kish_ess_documents", f"WITH {T.PANEL_D} SELECT lang, round(sum(weight) * sum(weight) / sum(weight * weight), {DP}) AS ess FROM panel GROUP BY 1")
def _(spark, d):
    return T.panel_d(spark, d).groupBy("lang").agg(F.round(weighted.kish(F.col("weight")), DP).alias("ess"))


@_query("share_se_quality", f"WITH {T.PANEL_D}, s AS (SELECT lang, sum(weight * p1) / sum(weight) AS share, sum(weight) * sum(weight) / sum(weight * weight) AS n FROM sample GROUP BY 1) SELECT lang, round(share, {DP}) AS share, round(sqrt(greatest(share * (1 - share), 0) / n), {DP}) AS se FROM s")
def _(spark, d):
    s = T.sample_d(spark, d).groupBy("lang").agg(weighted.weighted_mean(F.col("p")[1], F.col("weight")).alias("share"), weighted.kish(F.col("weight")).alias("n"))
    return _rounded(s.withColumn("se", weighted.standard_error(F.col("share"), F.col("n"))).drop("n"), "share", "se")


@_query("item_records_by_segment", f"WITH {T.PANEL_D} SELECT lang, length_band, CAST(count(*) AS BIGINT) AS n, round(sum(weight * p1) / sum(weight), {DP}) AS share FROM sample GROUP BY 1, 2 HAVING count(*) >= 10")
def _(spark, d):
    s = T.sample_d(spark, d).groupBy("lang", "length_band").agg(F.count("*").alias("n"), weighted.weighted_mean(F.col("p")[1], F.col("weight")).alias("share"))
    return _rounded(s.where("n >= 10"), "share")


_CUTS = ["NULL, NULL", "'length_band', length_band"]


@_query("item_records", f"""
WITH {T.PANEL_D}, rows_ AS (SELECT 'quality' AS item, ['bad', 'good'][quality + 1] AS option, quality AS option_ix, weight, length_band FROM sample WHERE quality IN (0, 1)),
long AS ({" UNION ALL ".join(f"SELECT item, option_ix, weight, {c.split(',')[0]} AS dimension, {c.split(',')[1]} AS level FROM rows_" for c in _CUTS)}),
t AS (SELECT item, dimension, level, sum(weight) AS total, sum(weight * weight) AS squares, count(*) AS n FROM long GROUP BY 1, 2, 3),
kept AS (SELECT * FROM t WHERE n >= CASE WHEN dimension IS NULL THEN 20 ELSE 10 END AND item IN (SELECT item FROM t WHERE dimension IS NULL AND n >= 20)),
o AS (SELECT * FROM (VALUES (0, 'bad'), (1, 'good')) v(option_ix, option)),
s AS (
  SELECT kept.*, o.option_ix, o.option, coalesce((SELECT sum(weight) FROM long l WHERE l.item = kept.item AND l.dimension IS NOT DISTINCT FROM kept.dimension
    AND l.level IS NOT DISTINCT FROM kept.level AND l.option_ix = o.option_ix), 0) / total AS share, total * total / squares AS n_eff FROM kept, o
)
SELECT item, CAST(dimension AS VARCHAR) AS dimension, CAST(level AS VARCHAR) AS level, CAST(option_ix AS INTEGER) AS option_ix, option, round(share, {DP}) AS share, n, round(n_eff, {DP}) AS n_eff,
  CASE WHEN dimension IS NULL THEN round(sqrt(greatest(share * (1 - share), 0) / n_eff), {DP}) END AS se FROM s
""")
def _(spark, d):
    answered = T.sample_d(spark, d).withColumn("quality", F.when(F.col("answer") == 0, "bad").when(F.col("answer") == 1, "good"))
    return _rounded(weighted.item_records(answered, {"quality": ["bad", "good"]}, ["length_band"], least=20, least_segment=10), "share", "n_eff", "se")


@_query("chunked_marginals_events", f"SELECT event_type AS level, round(sum(value) / sum(sum(value)) OVER (), {DP}) AS share, count(*) AS records FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    sums = T.read(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("level")).agg(F.sum("value").alias("weight"), F.count("*").alias("records"))
    return _rounded(weighted.shares(sums).drop("weight"), "share")


@_query("windowed_marginals_events", "SELECT date_trunc('day', ts) AS start, event_type AS level, round(sum(value), 4) AS weight, count(*) AS records FROM events GROUP BY 1, 2")
def _(spark, d):
    from .streaming.marginals import windowed_marginals

    return windowed_marginals(T.read(spark, d, "events"), "ts", "event_type", "value").withColumn("weight", F.round("weight", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- sampling

_ALLOC = f"""cells AS (SELECT region, segment, sum(weight) AS w FROM panel GROUP BY 1, 2),
q AS (SELECT *, w / sum(w) OVER () * (100 - count(*) OVER ()) AS quota, count(*) OVER () AS n FROM cells),
f AS (SELECT *, floor(quota) AS base, 100 - n - sum(floor(quota)) OVER () AS short FROM q),
alloc AS (SELECT region, segment, CAST(base + 1 + CASE WHEN row_number() OVER (ORDER BY quota - base DESC, region, segment) <= short THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM f)"""


@_query("largest_remainder_cells", f"WITH {T.PANEL_C}, {_ALLOC} SELECT * FROM alloc")
def _(spark, d):
    return sampling.largest_remainder(weighted.cells(T.panel_c(spark, d), ["region", "segment"]), 100, ["region", "segment"], least=1).select("region", "segment", "alloc")


@_query("stratified_sample_customers", f"WITH {T.PANEL_C}, {_ALLOC}, r AS (SELECT panel.*, alloc, row_number() OVER (PARTITION BY region, segment ORDER BY {T.U(chr(39) + '11' + chr(39), 'agent_id::VARCHAR')}, agent_id) AS k FROM panel JOIN alloc USING (region, segment)) SELECT agent_id, region, segment FROM r WHERE k <= alloc")
def _(spark, d):
    return sampling.stratified(T.panel_c(spark, d), 100, ["region", "segment"], 11, "agent_id").select("agent_id", "region", "segment")


@_query("weighted_sample_customers", f"WITH {T.PANEL_C} SELECT agent_id FROM panel WHERE weight > 0 ORDER BY -ln(1 - {T.U(chr(39) + '5' + chr(39), 'agent_id::VARCHAR')}) / weight, agent_id LIMIT 50")
def _(spark, d):
    return sampling.weighted_sample(T.panel_c(spark, d), 50, 5, "agent_id").select("agent_id")


@_query("bernoulli_sample_documents", f"SELECT doc_id FROM documents WHERE {T.U(chr(39) + '9' + chr(39), 'doc_id::VARCHAR')} < 0.1")
def _(spark, d):
    return sampling.bernoulli(T.read(spark, d, "documents"), 0.1, 9, "doc_id").select("doc_id")


# -- raking and synthesis

def _targets(spark, d) -> dict[str, dict[str, float]]:
    rows = T.read(spark, d, "supplier").join(F.broadcast(T.nations(spark, d)), F.col("s_nationkey") == F.col("nation")).groupBy("region").count().collect()
    total = sum(r["count"] for r in rows)
    got = {r["region"]: r["count"] / total for r in rows}
    return {"region": {x: got.get(x, 0.0) for x in T.REGIONS}, "segment": {x: (i + 3) / 25 for i, x in enumerate(T.SEGMENTS)}}


_STEPS = 10
_RAKE = f"""{T.PANEL_C}, tr AS (SELECT region, count(*) / (SELECT count(*) FROM supplier)::DOUBLE AS t FROM supplier JOIN nations ON s_nationkey = nation GROUP BY 1),
ts AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {(i + 3) / 25}::DOUBLE)" for i, x in enumerate(T.SEGMENTS))}) v(segment, t)),
r0 AS (SELECT region, segment, sum(weight) AS w FROM panel GROUP BY 1, 2), """ + ", ".join(
    f"a{i} AS (SELECT c.region, c.segment, w * t / (sum(w) OVER (PARTITION BY c.region) / sum(w) OVER ()) AS w FROM r{i - 1} c JOIN tr ON tr.region = c.region), r{i} AS (SELECT c.region, c.segment, w * t / (sum(w) OVER (PARTITION BY c.segment) / sum(w) OVER ()) AS w FROM a{i} c JOIN ts ON ts.segment = c.segment)"
    for i in range(1, _STEPS + 1)
)


@_query("rake_region_segment", f"WITH {_RAKE} SELECT region, segment, round(w / sum(w) OVER (), {DP}) AS share FROM r{_STEPS}")
def _(spark, d):
    raked, _info = raking.rake(T.panel_c(spark, d), _targets(spark, d))
    return _rounded(weighted.cells(raked, ["region", "segment"]).drop("weight"), "share")


@_query("rake_unreachable_levels", f"""
WITH {T.PANEL_C}, wanted AS (SELECT DISTINCT region FROM supplier JOIN nations ON s_nationkey = nation)
SELECT 'region' AS attribute, region AS level, CAST(20 AS INTEGER) AS iterations FROM wanted
WHERE region NOT IN (SELECT region FROM panel WHERE region <> 'ASIA' AND weight > 0)
""")
def _(spark, d):
    panel = T.panel_c(spark, d).where("region <> 'ASIA'")
    _raked, info = raking.rake(panel, _targets(spark, d), most=20)
    return spark.createDataFrame([(*x, info.iterations) for x in info.unreachable], "attribute string, level string, iterations int")


@_query("marginal_fidelity", f"WITH {T.PANEL_C}, t AS (SELECT 'segment' AS attribute, * FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {(i + 3) / 25}::DOUBLE)' for i, x in enumerate(T.SEGMENTS))}) v(level, share)), g AS (SELECT segment AS level, sum(weight) / sum(sum(weight)) OVER () AS got FROM panel GROUP BY 1), e AS (SELECT attribute, share, level, coalesce(got, 0) - share AS d FROM t LEFT JOIN g USING (level)) SELECT attribute, round(sum(abs(d)), {DP}) AS tae, round(max(abs(d)), {DP}) AS max_deviation, round(sqrt(avg(d * d)) / avg(share), {DP}) AS srmse, arg_max(level, abs(d)) AS worst_level, round(arg_max(d, abs(d)), {DP}) AS worst_deviation FROM e GROUP BY 1")
def _(spark, d):
    rows = [("segment", x, (i + 3) / 25) for i, x in enumerate(T.SEGMENTS)]
    return _rounded(raking.fidelity(T.panel_c(spark, d), spark.createDataFrame(rows, "attribute string, level string, share double"), ["segment"]), "tae", "max_deviation", "srmse", "worst_deviation")


@_query("joint_divergence_panels", f"WITH {T.PANEL_C}, a AS (SELECT region, segment, sum(weight) / sum(sum(weight)) OVER () AS s FROM panel WHERE agent_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT region, segment, sum(weight) / sum(sum(weight)) OVER () AS s FROM panel WHERE agent_id % 2 = 1 GROUP BY 1, 2) SELECT round(0.5 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), {DP}) AS divergence FROM a FULL JOIN b USING (region, segment)")
def _(spark, d):
    panel = T.panel_c(spark, d)
    return _rounded(raking.joint_divergence(panel.where("agent_id % 2 = 0"), panel.where("agent_id % 2 = 1"), ["region", "segment"]), "divergence")


_SYNTH_U = T.U("'21'", "'segment'", "range::VARCHAR")


@_query("synth_independence", f"SELECT range AS agent_id, CASE {' '.join(f'WHEN {_SYNTH_U} < {sum((j + 3) / 25 for j in range(i + 1))} THEN {chr(39)}{x}{chr(39)}' for i, x in enumerate(T.SEGMENTS[:-1]))} ELSE '{T.SEGMENTS[-1]}' END AS segment, {T.U(chr(39) + '22' + chr(39), chr(39) + 'openness' + chr(39), 'range::VARCHAR')} AS trait_openness FROM range(2000)")
def _(spark, d):
    made = raking.synthesize_independent(spark, 2000, {"segment": {x: (i + 3) / 25 for i, x in enumerate(T.SEGMENTS)}}, 21, ["openness"])
    return made.drop("weight")


# -- answers

@_query("cache_key", f"WITH {T.PANEL_C} SELECT agent_id, sha256('system' || chr(31) || concat_ws('; ', 'region: ' || region, 'segment: ' || segment)) AS key FROM panel")
def _(spark, d):
    return T.panel_c(spark, d).select("agent_id", answers.cache_key(F.lit("system"), answers.persona(["region", "segment"])).alias("key"))


_STUB = [f"(1 + CAST('0x' || substr(key, {1 + 2 * i}, 2) AS BIGINT) / 32.0::DOUBLE)" for i in range(3)]


@_query("stub_responses", f"WITH {T.PANEL_C}, k AS (SELECT agent_id, sha256('system' || chr(31) || concat_ws('; ', 'region: ' || region, 'segment: ' || segment)) AS key FROM panel) " + " UNION ALL ".join(f"SELECT agent_id, {i} AS option_ix, round({_STUB[i]} / ({' + '.join(_STUB)}), {DP}) AS p FROM k" for i in range(3)))
def _(spark, d):
    w = answers.stub_weights(F.lit("system"), answers.persona(["region", "segment"]), 3)
    return T.panel_c(spark, d).select("agent_id", F.posexplode(w).alias("option_ix", "p")).withColumn("p", F.round("p", DP))


@_query("parse_answers", f"WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id, CASE WHEN k > 0 THEN 1.0::DOUBLE END AS p_k FROM e")
def _(spark, d):
    p = answers.parse_answer(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")), ["k", "absent"])
    return T.read(spark, d, "events").select("event_id", p[0].alias("p_k"))


@_query("token_cost", "SELECT lang, CAST(sum(CAST(floor(length(text) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def _(spark, d):
    return T.read(spark, d, "documents").groupBy("lang").agg(F.sum(answers.token_estimate(F.col("text")).cast("long")).alias("tokens"))


# -- propagation

@_query("uniform_predictor", f"WITH {T.PANEL_C} SELECT agent_id, o.range::INTEGER AS option_ix, 0.2::DOUBLE AS p FROM panel, range(5) o")
def _(spark, d):
    return T.panel_c(spark, d).select("agent_id", F.posexplode(propagate.uniform(T.K)).alias("option_ix", "p"))


@_query("prior_predictor_loo", f"WITH {T.BANK_Q}, g AS (SELECT DISTINCT group_id FROM bank) SELECT g.group_id, option_ix, round(avg(topline), {DP}) AS share FROM g JOIN bank ON bank.group_id <> g.group_id GROUP BY 1, 2")
def _(spark, d):
    bank = T.bank_q(spark, d)
    # the mean without a group is (sum of all - sum of the group) over what is left: no pairing of groups
    sums = bank.groupBy("group_id", "option_ix").agg(F.sum("topline").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy("option_ix")
    loo = (F.sum("s").over(every) - F.col("s")) / (F.sum("n").over(every) - F.col("n"))
    return _rounded(sums.select("group_id", "option_ix", loo.alias("share")), "share")


@_query("mean_propagator", f"WITH {T.PANEL_D}, m AS (SELECT sum(weight * p1) / sum(weight) AS p FROM sample) SELECT agent_id, round(p, {DP}) AS p FROM panel, m")
def _(spark, d):
    return propagate.by_mean(T.panel_d(spark, d), T.sample_d(spark, d), 2).select("agent_id", F.round(F.col("p")[1], DP).alias("p"))


@_query("cell_mean_propagator", f"WITH {T.PANEL_D}, m AS (SELECT sum(weight * p1) / sum(weight) AS a FROM sample), c AS (SELECT lang, length_band, sum(weight * p1) / sum(weight) AS p FROM sample GROUP BY 1, 2) SELECT agent_id, round(coalesce(p, a), {DP}) AS p FROM panel LEFT JOIN c USING (lang, length_band), m")
def _(spark, d):
    return propagate.by_cell(T.panel_d(spark, d), T.sample_d(spark, d), ["lang", "length_band"], 2).select("agent_id", F.round(F.col("p")[1], DP).alias("p"))


@_query("softmax_propagator")
def _(spark, d):
    sample = sampling.stratified(T.sample_d(spark, d), 80, ["lang"], 3, "agent_id")
    fitted = propagate.Softmax({"lang": ("en", "fr", "de", "es"), "length_band": T.LENGTH_BANDS}).fit(sample, 2)
    return fitted.predict(T.panel_d(spark, d)).select("agent_id", F.round(F.col("p")[1], 6).alias("p"))


#: The loadings that numpy draws for seed 6, one trait and two options, as literals.
_LOADINGS = (1.0531157544867582, 1.776491303816993)


@_query("trait_noise", f"""
WITH {T.PANEL_D}, m AS (SELECT sum(weight * p0) / sum(weight) AS p0, sum(weight * p1) / sum(weight) AS p1 FROM sample),
t AS (SELECT agent_id, {T.U("'5'", "'x'", 'agent_id::VARCHAR')} AS x FROM panel),
z AS (
  SELECT agent_id, {", ".join(f"ln(greatest(p{i}, 1e-12)) + 0.05 * (x - avg(x) OVER ()) * {v}::DOUBLE AS z{i}" for i, v in enumerate(_LOADINGS))} FROM t, m
)
SELECT agent_id, round(exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 6) AS p FROM z
""")
def _(spark, d):
    agents = propagate.by_mean(T.panel_d(spark, d), T.sample_d(spark, d), 2).withColumn("trait_x", propagate.trait("x", 4))
    return propagate.trait_noise(agents, ["trait_x"], 0.05, 6, 2).select("agent_id", F.round(F.col("p")[1], 6).alias("p"))


# -- estimation

_POOL = f"""{T.PANEL_D}, cells AS (SELECT lang, length_band, sum(weight) AS w, sum(weight) / sum(sum(weight)) OVER () AS share FROM panel GROUP BY 1, 2),
m AS (SELECT avg(weight) AS mean FROM sample), e AS (SELECT lang, length_band, sum(weight / mean * p0) AS c0, sum(weight / mean * p1) AS c1 FROM sample, m GROUP BY 1, 2),
counts AS (SELECT lang, length_band, share, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c0, 0) + coalesce(c1, 0) AS n FROM cells LEFT JOIN e USING (lang, length_band)),
g AS (SELECT sum(c0) / sum(n) AS mu0, sum(c1) / sum(n) AS mu1, count(*) FILTER (WHERE n > 0) AS occupied FROM counts),
b AS (SELECT sum(n * (pow(c0 / n - mu0, 2) + pow(c1 / n - mu1, 2))) / sum(n) AS between_ FROM counts, g WHERE n > 0),
h AS (SELECT mu0, mu1, CASE WHEN occupied < 2 OR between_ <= 0 THEN 1e4::DOUBLE ELSE least(greatest((mu0 * (1 - mu0) + mu1 * (1 - mu1)) / between_ - 1, 0.01), 1e4) END AS alpha FROM g, b),
post AS (SELECT lang, length_band, share, n, (alpha * mu0 + c0) / (alpha + n) AS post0, (alpha * mu1 + c1) / (alpha + n) AS post1, alpha / (alpha + n) AS shrinkage FROM counts, h)"""
_DIMS = ["lang", "length_band"]


def _posterior(spark, d, concentration=None):
    return estimate.poststratified(T.panel_d(spark, d), T.sample_d(spark, d), _DIMS, 2, concentration=concentration)


@_query("pooled_cells", f"WITH {_POOL} SELECT lang, length_band, round(post0, 6) AS post0, round(post1, 6) AS post1, round(shrinkage, 6) AS shrinkage FROM post")
def _(spark, d):
    return _posterior(spark, d).select(*_DIMS, *[F.round(c, 6).alias(c) for c in ("post0", "post1", "shrinkage")])


@_query("mrp_topline", f"WITH {_POOL} SELECT 0 AS option_ix, round(sum(share * post0) / sum(share), 6) AS share FROM post UNION ALL SELECT 1, round(sum(share * post1) / sum(share), 6) FROM post")
def _(spark, d):
    return estimate.topline(_posterior(spark, d), 2).withColumn("share", F.round("share", 6))


@_query("mrp_segments", f"WITH {_POOL}, l AS (SELECT 'lang' AS dimension, lang AS level, * FROM post UNION ALL SELECT 'length_band', length_band, * FROM post) SELECT dimension, level, 0 AS option_ix, round(sum(share * post0) / sum(share), 6) AS share FROM l GROUP BY 1, 2 UNION ALL SELECT dimension, level, 1, round(sum(share * post1) / sum(share), 6) FROM l GROUP BY 1, 2")
def _(spark, d):
    return estimate.segments(_posterior(spark, d), _DIMS, 2).withColumn("share", F.round("share", 6))


@_query("mrp_no_pooling", f"WITH {_POOL}, p AS (SELECT share, (1e-6 * mu0 + c0) / (1e-6 + n) AS post0, (1e-6 * mu1 + c1) / (1e-6 + n) AS post1 FROM counts, g) SELECT 0 AS option_ix, round(sum(share * post0) / sum(share), 6) AS share FROM p UNION ALL SELECT 1, round(sum(share * post1) / sum(share), 6) FROM p")
def _(spark, d):
    return estimate.topline(_posterior(spark, d, 1e-6), 2).withColumn("share", F.round("share", 6))


@_query("direct_estimate", f"WITH {T.PANEL_D} SELECT 0 AS option_ix, round(sum(weight * p0) / sum(weight), {DP}) AS share FROM sample UNION ALL SELECT 1, round(sum(weight * p1) / sum(weight), {DP}) FROM sample")
def _(spark, d):
    return _rounded(weighted.weighted_distribution(T.sample_d(spark, d), "p", 2), "share")


@_query("posterior_interval")
def _(spark, d):
    low, high = estimate.interval("share")
    return estimate.draws(_posterior(spark, d), _DIMS, 2, 400, 17).groupBy("option_ix").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@_query("arm_contrast")
def _(spark, d):
    a = estimate.draws(_posterior(spark, d), _DIMS, 2, 400, 17)
    toxic = estimate.poststratified(T.panel_d(spark, d), T.sample_d(spark, d, "toxic"), _DIMS, 2)
    return estimate.contrast(a, estimate.draws(toxic, _DIMS, 2, 400, 17))


@_query("interval_agreement")
def _(spark, d):
    post = _posterior(spark, d)
    return estimate.interval_agreement(estimate.draws(post, _DIMS, 2, 400, 17), estimate.draws(post, _DIMS, 2, 400, 18))


@_query("quantile_interval", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.95), 6) AS high FROM events GROUP BY 1")
def _(spark, d):
    low, high = estimate.interval("value")
    return T.read(spark, d, "events").groupBy("event_type").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# -- graph

_GRAPH = f"""{T.PANEL_C}, b AS (SELECT agent_id AS id, region, p0, p1, p2, p3, p4, floor({T.U("'13'", "'bucket'", 'agent_id::VARCHAR')} * 256) AS bucket FROM panel),
numbered AS (
  SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY bucket, id) - 1 AS in_cell, row_number() OVER (ORDER BY region, bucket, id) - 1 AS number,
    count(*) OVER (PARTITION BY region) AS cell_size, count(*) OVER () AS size FROM b
),
asked AS (
  SELECT id, region, cell_size, size, {T.U("'13'", "'own'", 'id::VARCHAR', 'k::VARCHAR')} < 0.7 AS own, {T.U("'13'", "'pick'", 'id::VARCHAR', 'k::VARCHAR')} AS pick
  FROM numbered, (SELECT unnest(range(1, 5)) AS k)
),
ends AS (
  SELECT a.id, n.id AS other FROM asked a JOIN numbered n ON own AND a.region = n.region AND n.in_cell = least(floor(pick * a.cell_size), a.cell_size - 1)
  UNION ALL SELECT a.id, n.id FROM asked a JOIN numbered n ON NOT own AND n.number = least(floor(pick * a.size), a.size - 1)
),
once AS (SELECT DISTINCT least(id, other) AS src, greatest(id, other) AS dst FROM ends WHERE id <> other),
edges AS (SELECT src, dst FROM once UNION ALL SELECT dst, src FROM once)"""
_P = [f"p{i}" for i in range(T.K)]
_ROUNDS = "r0 AS (SELECT id, " + ", ".join(_P) + " FROM b), " + ", ".join(
    f"""h{i} AS (
  SELECT src, {", ".join(f"avg(o.{p}) AS m{p}" for p in _P)} FROM edges JOIN r{i} s ON s.id = src JOIN r{i} o ON o.id = dst
  WHERE ({" + ".join(f"abs(s.{p} - o.{p})" for p in _P)}) / 2 <= 0.25 GROUP BY 1
),
r{i + 1} AS (SELECT id, {", ".join(f"CASE WHEN src IS NULL THEN {p} ELSE {p} + 0.2 * (m{p} - {p}) END AS {p}" for p in _P)} FROM r{i} LEFT JOIN h{i} ON src = id)"""
    for i in range(3)
)


def _edges(spark, d):
    return graph.build(T.panel_c(spark, d), ["region"], 8, 0.7, 13)


@_query("graph_degrees", f"WITH {_GRAPH} SELECT src, count(*) AS degree FROM edges GROUP BY 1")
def _(spark, d):
    return graph.degrees(_edges(spark, d))


@_query("graph_homophily", f"WITH {_GRAPH} SELECT round(avg(CASE WHEN s.region = o.region THEN 1.0 ELSE 0.0 END), {DP}) AS homophily FROM edges JOIN b s ON s.id = src JOIN b o ON o.id = dst")
def _(spark, d):
    return _rounded(graph.homophily(_edges(spark, d), T.panel_c(spark, d).withColumn("label", F.col("region"))), "homophily")


@_query("influence_rounds", f"""
WITH {_GRAPH}, {_ROUNDS}, s AS (SELECT *, {" + ".join(_P)} AS total FROM r3)
{" UNION ALL ".join(f"SELECT id AS agent_id, CAST({i} AS INTEGER) AS option_ix, round({p} / total, 6) AS p FROM s" for i, p in enumerate(_P))}
""")
def _(spark, d):
    moved = graph.influence(T.panel_c(spark, d), _edges(spark, d), 3, 0.25, 0.2, T.K)
    return moved.select("agent_id", F.posexplode("p").alias("option_ix", "p")).withColumn("p", F.round("p", 6))


# -- scoring

def _rows(spark, d) -> DataFrame:
    """Each nation's published answers against its region's."""
    bank = T.bank_q(spark, d)
    groups = bank.groupBy("group_id", "option_ix").agg(F.avg("topline").alias("p"))
    return bank.join(F.broadcast(groups), ["group_id", "option_ix"]).select("question_id", "option_ix", "p", F.col("topline").alias("t"), "se")


_ROWS = f"{T.BANK_Q}, rows_ AS (SELECT question_id, option_ix, avg(topline) OVER (PARTITION BY group_id, option_ix) AS p, topline AS t, se FROM bank)"
_SCORES = f"{_ROWS}, run AS (SELECT *, sum(p - t) OVER (PARTITION BY question_id ORDER BY option_ix) AS c FROM rows_), scores AS (SELECT question_id, avg(abs(p - t)) AS mae, max(abs(p - t)) AS max_error, 0.5 * sum(abs(p - t)) AS total_variation, sum((p - t) * (p - t)) AS brier, -sum(t * ln(greatest(p, 1e-12))) AS log_score, avg(CASE WHEN abs(p - t) <= 1.96 * se THEN 1.0 ELSE 0.0 END) AS within_interval, sum(abs(c)) / (count(*) - 1) AS earth_mover FROM run GROUP BY 1)"
_METRICS = ("mae", "max_error", "total_variation", "brier", "log_score", "within_interval", "earth_mover")


@_query("score_questions", f"WITH {_SCORES} SELECT question_id, {', '.join(f'round({m}, {DP}) AS {m}' for m in _METRICS)} FROM scores")
def _(spark, d):
    return _rounded(score.question_scores(_rows(spark, d)), *_METRICS)


@_query("worst_questions", f"WITH {_SCORES} SELECT question_id, round(mae, {DP}) AS mae FROM scores ORDER BY scores.mae DESC, question_id LIMIT 8")
def _(spark, d):
    return _rounded(score.question_scores(_rows(spark, d)).orderBy(F.desc("mae"), "question_id").limit(8).select("question_id", "mae"), "mae")


@_query("backtest_summary", f"WITH {_SCORES} SELECT {', '.join(f'round(avg({m}), {DP}) AS {m}' for m in _METRICS)}, count(*) AS questions FROM scores")
def _(spark, d):
    return score.question_scores(_rows(spark, d)).agg(*[F.round(F.avg(m), DP).alias(m) for m in _METRICS], F.count("*").alias("questions"))


@_query("skill_vs_prior", f"WITH {_ROWS}, e AS (SELECT avg(abs(p - t)) AS e, avg(abs(0.2 - t)) AS b FROM rows_) SELECT round(1 - e / b, {DP}) AS skill FROM e")
def _(spark, d):
    sums = _rows(spark, d).agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("e"), F.avg(F.abs(0.2 - F.col("t"))).alias("b"))
    return _rounded(sums.select(score.skill(F.col("e"), F.col("b")).alias("skill")), "skill")


_BIN = "least(" + " + ".join(f"CASE WHEN p >= {i / 10}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10)) + ", 9)"


@_query("reliability_curve", f"WITH {_ROWS}, b AS (SELECT {_BIN} AS bin, avg(p) AS mp, avg(t) AS mt, count(*) AS n FROM rows_ GROUP BY 1) SELECT range::INTEGER AS bin, round(mp, {DP}) AS mean_p, round(mt, {DP}) AS mean_t, coalesce(n, 0) AS rows FROM range(10) LEFT JOIN b ON bin = range")
def _(spark, d):
    return _rounded(score.reliability(_rows(spark, d)), "mean_p", "mean_t")


@_query("ece_pooled", f"WITH {_ROWS}, b AS (SELECT {_BIN} AS bin, avg(p) AS mp, avg(t) AS mt, count(*) AS n FROM rows_ GROUP BY 1) SELECT round(sum(n * abs(mp - mt)) / sum(n), {DP}) AS ece FROM b")
def _(spark, d):
    return _rounded(score.calibration_error(_rows(spark, d)), "ece")


@_query("interval_coverage", f"WITH {_ROWS} SELECT round(avg(CASE WHEN t BETWEEN p - 1.96 * se AND p + 1.96 * se THEN 1.0 ELSE 0.0 END), {DP}) AS coverage FROM rows_")
def _(spark, d):
    rows = _rows(spark, d).withColumn("low", F.col("p") - 1.96 * F.col("se")).withColumn("high", F.col("p") + 1.96 * F.col("se"))
    return _rounded(score.coverage(rows), "coverage")


def _experiments(spark, d) -> DataFrame:
    """The two lowest nations of each region: published gap and a halved estimate."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("question_id"))
    arms = T.bank_q(spark, d).where("option_ix = 0").withColumn("arm", rank).where("arm <= 2")
    return arms.groupBy("group_id").agg((F.max(F.when(F.col("arm") == 2, F.col("topline"))) - F.max(F.when(F.col("arm") == 1, F.col("topline")))).alias("gap_t"), F.max("n").alias("n")).withColumn("gap_p", F.col("gap_t") / 2 + 0.01)


_EXP = f"{T.BANK_Q}, arms AS (SELECT group_id, topline, row_number() OVER (PARTITION BY group_id ORDER BY question_id) AS arm FROM bank WHERE option_ix = 0), x AS (SELECT group_id, max(CASE WHEN arm = 2 THEN topline END) - max(CASE WHEN arm = 1 THEN topline END) AS gap_t FROM arms WHERE arm <= 2 GROUP BY 1), exps AS (SELECT *, gap_t / 2 + 0.01 AS gap_p FROM x)"


@_query("arm_gap", f"WITH {_EXP} SELECT group_id, round(gap_t, {DP}) AS gap_t, round(gap_p, {DP}) AS gap_p FROM exps")
def _(spark, d):
    return _rounded(_experiments(spark, d).drop("n"), "gap_t", "gap_p")


@_query("experiment_summary", f"WITH {_EXP} SELECT round(avg(abs(gap_p - gap_t)), {DP}) AS gap_mae, round(avg(CASE WHEN abs(gap_t) >= 0.03 THEN CASE WHEN sign(gap_p) = sign(gap_t) THEN 1.0 ELSE 0.0 END END), {DP}) AS gap_sign, count(*) AS experiments, round(corr(gap_p, gap_t), {DP}) AS gap_correlation FROM exps")
def _(spark, d):
    return _rounded(score.experiment_summary(_experiments(spark, d)), "gap_mae", "gap_sign", "gap_correlation")


@_query("bank_split", f"WITH {T.BANK_Q} SELECT DISTINCT question_id FROM bank WHERE group_id NOT IN ('ASIA')")
def _(spark, d):
    bank = T.bank_q(spark, d).select("question_id", "group_id").distinct()
    held = bank.where("group_id = 'ASIA'").select("question_id")
    return bank.join(held, "question_id", "left_anti").select("question_id")


@_query("gate_results", f"""
WITH {_SCORES}, s AS (SELECT CAST(count(*) AS DOUBLE) AS questions, avg(mae) AS mae FROM scores)
SELECT 'questions' AS metric, 'min' AS kind, 20.0::DOUBLE AS bound, questions AS value, questions >= 20 AS holds FROM s
UNION ALL SELECT 'mae', 'max', 0.16::DOUBLE, round(mae, {DP}), mae <= 0.16 FROM s
UNION ALL SELECT 'coverage', 'min', 0.7::DOUBLE, NULL, false
""")
def _(spark, d):
    found = score.question_scores(_rows(spark, d)).agg(F.count("*").alias("questions"), F.avg("mae").alias("mae")).collect()[0]
    return _rounded(score.gates(spark, found.asDict(), [("questions", "min", 20), ("mae", "max", 0.16), ("coverage", "min", 0.7)]), "value")


@_query("wording_extract_pages", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def _(spark, d):
    return T.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@_query("hash_uniform", f"SELECT doc_id, {T.U(chr(39) + '1' + chr(39), 'doc_id::VARCHAR')} AS u FROM documents")
def _(spark, d):
    return T.read(spark, d, "documents").select("doc_id", hash_u(1, F.col("doc_id")).alias("u"))


# -- records of two sources

_RECORDS = """r AS (SELECT c_custkey AS k, CAST(c_custkey % 100 AS VARCHAR) AS age, c_custkey % 4 AS sex, c_custkey % 26 AS schl, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 11 END AS race, c_custkey % 7 AS mar, c_custkey % 40 - 2 AS w FROM customer),
coded AS (SELECT k, CASE WHEN age::INT < 18 THEN NULL WHEN age::INT < 25 THEN '18-24' WHEN age::INT < 35 THEN '25-34' WHEN age::INT < 45 THEN '35-44' WHEN age::INT < 55 THEN '45-54' WHEN age::INT < 65 THEN '55-64' ELSE '65+' END AS age_band,
  ['male', 'female'][sex] AS sex, CASE WHEN schl < 1 THEN NULL WHEN schl < 16 THEN 'less_than_hs' WHEN schl < 18 THEN 'high_school' WHEN schl < 21 THEN 'some_college' WHEN schl < 22 THEN 'bachelors' WHEN schl < 25 THEN 'graduate' END AS education,
  CASE race WHEN 1 THEN 'white' WHEN 2 THEN 'black' ELSE CASE WHEN race IS NOT NULL THEN 'other' END END AS race, ['married', 'widowed', 'divorced', 'separated', 'never_married'][mar] AS marital, CAST(w AS DOUBLE) AS weight FROM r)"""


def _records(spark, d) -> DataFrame:
    """Customers as raw census records: text ages, undocumented codes, missing and negative values."""
    k = F.col("c_custkey")
    codes = {"AGEP": (k % 100).cast("string"), "SEX": k % 4, "SCHL": k % 26, "RAC1P": F.nullif(k % 11, F.lit(0)), "MAR": k % 7, "PWGTP": k % 40 - 2}
    return T.read(spark, d, "customer").select(*[c.alias(n) for n, c in codes.items()])


@_query("harmonize_census", f"WITH {_RECORDS} SELECT age_band, sex, education, race, marital, weight FROM coded WHERE age_band IS NOT NULL AND sex IS NOT NULL AND education IS NOT NULL AND race IS NOT NULL AND marital IS NOT NULL AND weight > 0")
def _(spark, d):
    return harmonize.census(_records(spark, d))


@_query("harmonize_survey", "SELECT c_custkey AS item, CASE WHEN c_custkey % 100 BETWEEN 18 AND 89 THEN CASE WHEN c_custkey % 100 < 25 THEN '18-24' WHEN c_custkey % 100 < 35 THEN '25-34' WHEN c_custkey % 100 < 45 THEN '35-44' WHEN c_custkey % 100 < 55 THEN '45-54' WHEN c_custkey % 100 < 65 THEN '55-64' ELSE '65+' END END AS age_band, ['less_than_hs', 'high_school', 'some_college', 'bachelors', 'graduate'][c_custkey % 6 + 1] AS education, CAST(c_custkey % 3 AS DOUBLE) AS weight FROM customer WHERE c_custkey % 3 > 0")
def _(spark, d):
    k = F.col("c_custkey")
    raw = T.read(spark, d, "customer").select(k.alias("item"), (k % 100).alias("age"), (k % 2 + 1).alias("sex"), (k % 6).alias("degree"), (k % 3 + 1).alias("race"), (k % 5 + 1).alias("marital"), (k % 3).alias("wt"))
    return harmonize.survey(raw, "wt").select("item", "age_band", "education", "weight")


# -- cost, microdata, bootstrap, the grid

@_query("cost_by_model", "WITH c AS (SELECT lang AS model, doc_id % 4 = 0 AS cached, length(text) // 4 AS i, doc_id % 50 AS o, doc_id % 7 AS r, doc_id % 5 AS w FROM documents) SELECT model, count(*) FILTER (WHERE NOT cached) AS calls, count(*) FILTER (WHERE cached) AS cached_calls, round(coalesce(sum((i + 0.1::DOUBLE * r + 1.25::DOUBLE * w) * p.a + o * p.b) FILTER (WHERE NOT cached), 0) / 1e6, 9) AS usd FROM c JOIN (VALUES ('en', 3.0::DOUBLE, 15.0::DOUBLE), ('fr', 1.0, 5.0), ('de', 0.0, 0.0), ('es', 0.0, 0.0)) p(model, a, b) USING (model) GROUP BY 1")
def _(spark, d):
    k = F.col("doc_id")
    calls = T.read(spark, d, "documents").select(F.col("lang").alias("model"), (k % 4 == 0).alias("cached"), answers.token_estimate(F.col("text")).alias("input_tokens"), (k % 50).alias("output_tokens"), (k % 7).alias("cache_read_tokens"), (k % 5).alias("cache_write_tokens"))
    return cost.dollars(cost.totals(calls), {"en": (3.0, 15.0), "fr": (1.0, 5.0)}).select("model", "calls", "cached_calls", F.round("usd", 9).alias("usd"))


@_query("synth_microdata", f"WITH {T.PANEL_C}, t AS (SELECT region AS level, count(*) / (SELECT count(*) FROM supplier)::DOUBLE AS s FROM supplier JOIN nations ON s_nationkey = nation GROUP BY 1) SELECT 'region' AS attribute, level, round(s, 6) AS share FROM t UNION ALL SELECT 'segment', level, round(s, 6) FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {(i + 3) / 25}::DOUBLE)' for i, x in enumerate(T.SEGMENTS))}) v(level, s)")
def _(spark, d):
    made = synthesis.from_microdata(spark, T.panel_c(spark, d), 2000, _targets(spark, d), 31, ["openness"], 1e6)
    return weighted.all_marginals(made, ["region", "segment"]).withColumn("share", F.round("share", 6))


@_query("bootstrap_interval")
def _(spark, d):
    sample = sampling.stratified(T.sample_d(spark, d).where("p is not null"), 80, ["lang"], 3, "agent_id")
    low, high = estimate.interval("share")
    drawn = bootstrap.draws(T.panel_d(spark, d), sample, _DIMS, 2, 200, 23)
    return drawn.groupBy("option_ix").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _grid(spark, d, engines) -> DataFrame:
    bank = T.bank_q(spark, d).withColumns({"question_id": F.col("question_id").cast("string"), "text": F.concat(F.lit("Which priority do the orders of nation "), F.col("question_id"), F.lit(" have?")), "option": F.element_at(F.array(*[F.lit(x) for x in T.PRIORITIES]), F.col("option_ix") + 1)})
    base = {
        "name": "grid", "seed": 41, "scenario": {"question_id": "q", "prompt": "-", "options": list(T.PRIORITIES)},
        "population": {"attributes": ["region", "segment", "balance_band"]},
        "predictor": {"stratify_by": ["region", "segment"], "archetypes": 200}, "estimator": {"dimensions": ["region", "segment"], "draws": 200},
    }
    panel = T.panel_c(spark, d).select("agent_id", "region", "segment", "balance_band", "weight")
    return cut(backtest.run(spark, base, engines, bank, lambda s: panel, T.TAXONOMY.attributes), "grid")


@_query("backtest_prior", f"WITH {T.BANK_Q}, m AS (SELECT b.question_id, b.option_ix, avg(o.topline) AS p FROM bank b JOIN bank o ON o.option_ix = b.option_ix AND o.group_id <> b.group_id GROUP BY 1, 2) SELECT CAST(question_id AS VARCHAR) AS question_id, option_ix, round(p / sum(p) OVER (PARTITION BY question_id), {DP}) AS p FROM m")
def _(spark, d):
    return _rounded(_grid(spark, d, ["prior"]).select("question_id", "option_ix", "p"), "p")


@_query("backtest_leaderboard")
def _(spark, d):
    board = backtest.leaderboard(_grid(spark, d, ["uniform", "prior", "hybrid", "hybrid-no-pooling", "hybrid-100"]))
    return board.select("engine", "questions", "calls", *[F.round(c, 6).alias(c) for c in ("mae", "brier", "ece", "interval_coverage", "skill_mae")])
