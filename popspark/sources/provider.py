"""Asking a model about agents: prompts, cache, budget, batches, parsing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..lineage import cut
from ..operators import cost
from .cache import ResponseCache

#: A provider takes prompts, the system text and the most tokens of an answer; it returns a dict a prompt with text,
#: input_tokens, output_tokens, cache_read_tokens, cache_write_tokens. It runs on executors and must be serialisable.
Complete = Callable[[Sequence[str], str, int], Sequence[Mapping]]
ANSWER = "text string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
PREAMBLE = "Estimate how people with the given profile answer the question. Reply with one JSON object that maps each option to its probability."


def system_text(question: str, options: Sequence[str], context: str = "") -> str:
    """What all agents' prompts share; the last line holds the options as JSON."""
    return "\n".join([PREAMBLE, f"Question: {question}", *([f"Context: {context}"] if context else []), f"OPTIONS: {json.dumps(list(options))}"])


def prompts(agents: DataFrame, attributes: Sequence[str], system: str, key: str = "agent_id") -> DataFrame:
    """key, prompt, key of the cache."""
    made = agents.select(F.col(key).alias("_id"), F.concat(F.lit("Profile: "), answers.persona(attributes)).alias("prompt"))
    return made.withColumn("key", answers.cache_key(F.lit(system), F.col("prompt")))


def ask(asked: DataFrame, complete: Complete, system: str, max_tokens: int, batch_size: int, concurrency: int) -> DataFrame:
    """asked with the completions: one partition a concurrent caller, batches of batch_size within."""

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch_size):
                rows = part.iloc[at : at + batch_size].reset_index(drop=True)
                yield pd.concat([rows, pd.DataFrame(list(complete(rows["prompt"].tolist(), system, max_tokens)))[[f.split()[0] for f in ANSWER.split(", ")]]], axis=1)

    kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
    return asked.repartition(concurrency).mapInPandas(call, f"{kinds}, {ANSWER}")


def respond(agents: DataFrame, attributes: Sequence[str], question: str, options: Sequence[str], *, complete: Complete | None = None, context: str = "", cache: ResponseCache | None = None, meter: cost.Meter | None = None, budget: cost.Budget | None = None,
            model: str = "stub", prices: Mapping[str, tuple[float, float]] = cost.PRICES, max_tokens: int = 512, batch_size: int = 32, concurrency: int = 8, dedupe: bool = False, key: str = "agent_id") -> DataFrame:
    """agents with p, null where an answer can't be parsed. Without a provider the offline one answers, as column expressions.

    Agents with equal attributes share a prompt; dedupe asks it once. The budget is checked before any call, with the
    calls still to make and their tokens estimated from lengths. A paid answer must not be asked again when a task is
    retried: completions are written first, to the cache or the shared folder, and read back.
    """
    system = system_text(question, options, context)
    asked = prompts(agents, attributes, system, key)
    if complete is None:
        if meter is not None:
            n = asked.count()
            if budget is not None:
                budget.check(meter, n)
            meter.calls += n
        found = asked.select("_id", answers.stub_weights(F.lit(system), F.col("prompt"), len(options)).alias("p"))
        return agents.join(found.withColumnRenamed("_id", key), key)
    misses = cache.lookup(asked)[1] if cache is not None else asked
    wanted = misses.dropDuplicates(["key"]) if dedupe or cache is not None else misses
    meter = meter or cost.Meter()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(answers.token_estimate(F.concat(F.lit(system), "prompt"))), F.lit(0)).alias("t")).first()
    if budget is not None:
        into, out = prices.get(model, (0.0, 0.0))
        budget.check(meter, size["n"], (size["t"] * into + size["n"] * max_tokens / 4 * out) / 1e6)
    got = ask(wanted, complete, system, max_tokens, batch_size, concurrency)
    if cache is not None:
        cache.append(got.drop("_id", "prompt"))
        both = asked.join(cache.load(), "key")
        fresh = both.join(misses.select("_id"), "_id", "left_semi")
        meter.record(fresh.dropDuplicates(["key"]).withColumns({"model": F.lit(model), "cached": F.lit(False)}), prices)
        n = asked.count()
        cache.record(n, size["n"])
        meter.cached_calls += n - size["n"]
    else:
        got = cut(got, "answers")  # paid answers are asked once
        meter.record(got.withColumns({"model": F.lit(model), "cached": F.lit(False)}), prices)
        both = asked.join(got.select("key", "text").dropDuplicates(["key"]), "key") if dedupe else got
    found = both.select(F.col("_id").alias(key), answers.parse_answer(F.col("text"), options).alias("p"))
    return agents.join(found, key)


def filled(responses: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Agents without a usable answer get the plain mean of the usable ones, within by; an error if there are none."""
    rows = responses.groupBy(*by).agg(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(k)]).collect()  # a row a question
    bad = [tuple(r[b] for b in by) for r in rows if r["m0"] is None]
    if bad:
        raise ValueError(" ".join(["no usable answers", *(f"to {x}" for x in bad if x)]))
    if not by:
        return responses.withColumn("p", F.coalesce("p", F.array(*[F.lit(float(rows[0][f"m{i}"])) for i in range(k)])))
    kinds = dict(responses.dtypes)
    means = [(*(r[b] for b in by), [float(r[f"m{i}"]) for i in range(k)]) for r in rows]
    means = responses.sparkSession.createDataFrame(means, ", ".join([*(f"{b} {kinds[b]}" for b in by), "_mean array<double>"]))
    return responses.join(F.broadcast(means), list(by)).withColumn("p", F.coalesce("p", "_mean")).drop("_mean")


def diagnostics(responses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, asked, usable, failure_rate."""
    return responses.groupBy(*by).agg(F.count("*").alias("asked"), F.count("p").alias("usable"), F.avg(F.col("p").isNull().cast("double")).alias("failure_rate"))
