"""Answers of a model as columns: prompts, cache keys, the offline provider, parsing, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def persona(attributes: Sequence[str]) -> Column:
    """'name: value; ...' with blanks for underscores; null attributes are left out."""
    return F.concat_ws("; ", *[F.concat(F.lit(a.replace("_", " ") + ": "), F.col(a).cast("string")) for a in attributes])


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def stub_weights(system: Column, prompt: Column, k: int) -> Column:
    """The offline provider: 1 + byte i of a digest / 32, normalised; unrounded."""
    digest = cache_key(system, prompt)
    raw = [1 + F.conv(F.substring(digest, 1 + 2 * (i % 32), 2), 16, 10).cast("double") / 32 for i in range(k)]
    total = sum(raw[1:], raw[0])
    return F.array(*[r / total for r in raw])


def parse_answer(text: Column, options: Sequence[str]) -> Column:
    """The outermost {...} as option -> number, normalised; missing options and negatives count 0, booleans 0 or 1; null without any mass."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    answers = F.from_json(F.nullif(inner, F.lit("")), "map<string,string>")

    def number(option: str) -> Column:
        raw = F.try_element_at(answers, F.lit(option))
        value = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
        return F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))

    return normalised([number(o) for o in options])


def normalised(values: Sequence[Column]) -> Column:
    total = sum(values[1:], values[0])
    return F.when(total > 0, F.array(*[v / F.nullif(total, F.lit(0.0)) for v in values]))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
