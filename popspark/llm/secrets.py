"""Secret scans: three base patterns plus sliding-window Shannon entropy, in built-in expressions only.

Spans are found by extracting, for every match, the gap before it: the running sum of the lengths of gaps and matches
gives the code-point offsets. For entropy, runs of one character class are candidates; a window slides over a run, the
counts of its characters are carried from step to step, S = sum of c log2 c is updated from the two counts that change, and
H = log2(w) - S / w. A run is a finding if some window without allow-listed text, with a letter and a digit in its part of
the run, reaches the threshold of its class. Rows are independent: no shuffle.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: class -> (characters, threshold in bits). A window of 20 has at most log2(20) = 4.32.
CLASSES = {"hex": ("0-9a-fA-F", 3.0), "base64": ("A-Za-z0-9+/_-", 3.8)}
WINDOW = 20
#: Known not to be secrets: what holds one of these is cut there, and only the parts between are looked at.
ALLOW = r"(?i)example|placeholder|dummy|changeme|0123456789|abcdefghij|(.)\1{7,}"
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _spans(text: Column, pattern: str, kind: int, keep, groups: int = 2) -> Column:
    """Leftmost non-overlapping matches that keep(match, last group) accepts; the rest is dropped without a retry."""
    whole = F.lit(rf"\G(?s)(.*?)({pattern})")  # \G: where no further match begins, no later start is tried
    gaps, hits, parts = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, groups))
    items = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), parts.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("pos"), F.when(keep(x["hit"], x["part"]), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(items, start, step, lambda acc: acc["spans"])


def _weigh(count: Column) -> Column:
    """c log2 c, by table: counts are at most WINDOW + 1."""
    return F.element_at(F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)]), (count + 1).cast("int"))


def top_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest entropy (bits) of a window of the run; null if the run is shorter than the window."""
    chars = F.split(run, "")
    first, known = F.slice(chars, 1, window), F.array_distinct(chars)
    counted = F.transform(known, lambda c: F.size(F.filter(first, lambda x: x == c)))
    begin = F.aggregate(counted, F.lit(0.0), lambda s, c: s + _weigh(c))

    def step(acc: Column, i: Column) -> Column:  # the window that ends before i moves on by one
        leaves, enters = F.array_position(known, F.element_at(chars, i - window)), F.array_position(known, F.element_at(chars, i))
        out, into = (F.element_at(acc["counts"], at.cast("int")) for at in (leaves, enters))
        s = acc["s"] + F.when(leaves == enters, 0.0).otherwise(_weigh(out - 1) - _weigh(out) + _weigh(into + 1) - _weigh(into))
        counts = F.transform(acc["counts"], lambda c, j: c + (j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int"))
        return F.struct(counts.alias("counts"), s.alias("s"), F.least(acc["low"], s).alias("low"))

    rest = F.when(F.size(chars) > window, F.sequence(F.lit(window + 1), F.size(chars))).otherwise(F.array().cast("array<int>"))
    low = F.aggregate(rest, F.struct(counted.alias("counts"), begin.alias("s"), begin.alias("low")), step, lambda acc: acc["low"])
    return F.when(F.size(chars) >= window, F.lit(log2(window)) - low / window)


def spans(text: Column) -> tuple[Column, Column]:
    """(base, added): arrays of (start, kind, stop) with code-point offsets, end exclusive."""
    none = F.array().cast(SPAN)
    lower = F.lower(text)
    worded = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & (
        F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("key"))
    )
    assign = F.when(worded, _spans(text, ASSIGN, 0, lambda hit, part: F.length(part) >= 6, 3)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, "AKIA[A-Z0-9]+", 1, lambda hit, part: F.length(hit) >= 20)).otherwise(none)
    long_hex = F.when(F.rlike(text, F.lit("[0-9a-f]{24}")), _spans(text, "[0-9a-f]{24,}+", 2, lambda hit, part: F.lit(True))).otherwise(none)

    found = []
    for chars, threshold in CLASSES.values():
        run = f"[{chars}]{{{WINDOW},}}+"

        def secret(hit: Column, part: Column, threshold: float = threshold) -> Column:
            mixed = lambda x: F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("[A-Za-z]"))
            part = lambda x: F.when((F.length(x) >= WINDOW) & mixed(x), top_entropy(x) >= threshold).otherwise(F.lit(False))
            return F.when(mixed(hit), F.exists(F.split(hit, ALLOW), part)).otherwise(F.lit(False))

        found.append(F.when(F.rlike(text, F.lit(run)), _spans(text, run, 3, secret)).otherwise(none))
    return F.array_sort(F.concat(assign, access, long_hex)), F.array_sort(F.array_distinct(F.concat(*found)))


def joined(found: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans for every row of docs (doc_id, text; more columns are ignored).

    Null text counts as empty and has no spans. Every row is kept, repeated ones too; an empty table gives an empty one.
    """
    base, added = spans(text_or_empty())
    return docs.select("doc_id", base.alias("base"), added.alias("added"))


def redact(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """docs with every found span in text replaced by mask (overlaps are merged); other columns are kept."""
    base, added = spans(text_or_empty())

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        out = F.when(x["start"] >= acc["pos"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["stop"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate(F.array_sort(F.concat(base, added)), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
