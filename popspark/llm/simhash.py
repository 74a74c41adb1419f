"""Document fingerprints by SimHash, and the permuted block tables that find all near ones.

Terms are pairs of neighbouring words (a lone word is its own term), lower-cased in A-Z. A term's 128-bit hash votes for
or against every bit with weight (1 + ln count) times a factor of the hash, which settles ties; the sign of the sum is
the bit. Two fingerprints that differ in h of 128 bits have an estimated cosine of cos(pi h / 128); cut off at 0, that
is their likeness.

search() finds all fingerprints within a Hamming radius r of those asked for. One table a block of bits is keyed by it, and
matches are verified. With r + 1 blocks, two such fingerprints agree in a block at least. Larger radii have BLOCKS wider
blocks, m: r = s m + a bits that differ leave at most s in one of the first a + 1 blocks, or at most s - 1 in one of the
others; the tables are asked for all keys within so many bits of the fingerprint's own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

BITS, RADIUS = 128, 3
#: The query's radius: texts that share 0.8 of their passages mostly differ in fewer bits. Blocks for radii over 7, and the largest radius they serve.
NEAR_RADIUS, BLOCKS, MOST = 16, 6, 17
#: The query asks for the neighbours of the rows whose id is divisible by this.
ASKED_EVERY = 100
#: Up to so many fingerprints asked for, and KEYS times as many keys of theirs, are broadcast; beyond, joined by shuffle.
BROADCAST_ROWS, KEYS = 20_000, 50
#: Rows of one run of neighbouring ids, the most runs, terms hashed at once, words kept.
RUN_ROWS, MOST_RUNS, BLOCK, CACHED = 8192, 10_000, 8192, 120_000
_M1, _M2, _G = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = made = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return made


_words = WordHashes()  # of this Python worker


def hashed_words(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def fingerprint(text: str) -> int:
    """0 for a text without words."""
    words = hashed_words(text)
    if not len(words):
        return 0
    terms = mix(words[:-1] * _G + mix(words[1:])) if len(words) > 1 else mix(words)
    terms, counts = np.unique(terms, return_counts=True)
    votes = np.zeros(BITS)
    for i in range(0, len(terms), BLOCK):
        low = terms[i : i + BLOCK]
        high = mix(low + _G)
        factor = 0.75 + (mix(high + _G) >> np.uint64(40)).astype(np.float64) / 2**25
        weight = (1 + np.log(counts[i : i + BLOCK])) * factor
        bits = np.unpackbits(np.stack([low, high], 1).view(np.uint8), axis=1)
        votes += 2 * (weight.astype(np.float32) @ bits.astype(np.float32)).astype(np.float64) - weight.sum()
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / BITS))


def edited(text: str, following: str) -> str:
    """The last half of text (code points, rounded down) gives way to as many of what follows, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUTPUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted in runs; a run ends with the first row of the next run (is_head), which is only compared with."""
    before = None  # (doc_id, text, fingerprint) that waits for its next document
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, head, run in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "is_head", "run")), strict=True):
            if head and before is None:
                continue  # the run's last row has met its next one already
            now = fingerprint(text)
            if before is not None:
                if before[3] != run:
                    raise ValueError("a run without the row that follows it")
                own, own_text, own_print, _ = before
                new = edited(own_text, text)
                new_print = fingerprint(new)
                out.append((own, len(own_text), hashlib.sha256(new.encode()).hexdigest(), f"{own_print:032x}", f"{new_print:032x}", likeness(own_print, new_print), likeness(own_print, now)))
            before = None if head else (doc_id, text, now, run)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Fingerprints of every row's text and of its text edited with the next document's (doc_id, text; more columns are ignored).

    Next: by ascending doc_id, null ids last, rows that repeat an id by text; after the last comes the first. Null text
    counts as empty. A single row is its own next. An empty table gives an empty result.

    Ids are cut into runs of neighbours at quantiles (so skewed ids make even runs); a run is one sorted stream that ends
    with a copy of the first row of the next run. No task sees more of a run than a batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    runs = max(1, min(MOST_RUNS, -(-n // run_rows)))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / runs for i in range(1, runs)], max(1e-4, 0.25 / runs))}) if runs > 1 else []
    run = F.lit(0)
    if cuts:  # a balanced tree of comparisons; null ids in the last run
        def tree(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("doc_id") < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

        run = tree(0, len(cuts))
    rows = rows.withColumn("run", run)
    firsts = sorted((r["run"], r["first"]) for r in rows.groupBy("run").agg(F.min("doc_id").alias("first")).collect())  # at most MOST_RUNS
    own = rows.select("run", F.lit(0).alias("is_head"), "doc_id", "text")
    if firsts:
        heads = spark.createDataFrame([(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))], "run int, first long")
        head_rows = rows.drop("run").join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["first"])).select("run", F.lit(1).alias("is_head"), "doc_id", "text")
        own = own.unionByName(head_rows)
    # a partition a run: hashes of run numbers would collide
    dealt = own.repartitionById(max(1, len(firsts)), "run").sortWithinPartitions("run", "is_head", F.asc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_compare, OUTPUT)


def search(prints: DataFrame, asked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, near, distance: for each distinct fingerprint of asked (32 hex digits) all others of prints within the radius.

    Rows that share a fingerprint count once; null fingerprints take no part; empty tables give an empty result.
    Blocks must be wide enough for their tables to be selective and few keys be asked for, so radii over MOST are refused.
    Two fingerprints that are near in several blocks meet in each of them and are reported by the first.
    """
    if not 0 <= radius <= MOST:
        raise ValueError(f"radius must be 0 to {MOST}")
    n = radius + 1 if radius <= 7 else BLOCKS
    edges = [round(i * 32 / n) for i in range(n + 1)]  # hex digits
    within = [radius // n - (i > radius % n) for i in range(n)]
    text = lambda c, i: F.substring(c, edges[i] + 1, edges[i + 1] - edges[i])
    block = text if n == radius + 1 else lambda c, i: F.conv(text(c, i), 16, 10).cast("long")
    masks = [(i, sum(1 << b for b in bits)) for i in range(n) for k in range(within[i] + 1) for bits in combinations(range(4 * (edges[i + 1] - edges[i])), k)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return each.select(name, F.posexplode(F.array(*[block(name, i) for i in range(n)])).alias("slot", "key"))

    word = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word("a", i).bitwiseXOR(word("b", i))) for i in range(4)), F.lit(0))
    keys = tables(asked, "a")
    if n == radius + 1:
        near = [block("a", i) == block("b", i) for i in range(n)]
    else:
        near = [F.bit_count(block("a", i).bitwiseXOR(block("b", i))) <= within[i] for i in range(n)]
        around = prints.sparkSession.createDataFrame(masks, "slot int, mask long")
        keys = keys.join(F.broadcast(around), "slot").select("a", "slot", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    first = F.coalesce(*[F.when(x, i) for i, x in enumerate(near)])
    if asked.count() * len(masks) <= KEYS * BROADCAST_ROWS:
        keys = F.broadcast(keys)
    met = tables(prints, "b").join(keys, ["slot", "key"]).where((F.col("a") != F.col("b")) & (first == F.col("slot")))
    return met.select(F.col("a").alias("fingerprint"), F.col("b").alias("near"), distance.alias("distance")).where(F.col("distance") <= radius)


def with_near(prints: DataFrame, every: int = ASKED_EVERY, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fingerprint, more columns) with n_near: how many other rows lie within the radius.

    Asked for are the rows whose doc_id is divisible by every; n_near of the rest, and of null ids, is null. Rows that
    share a fingerprint are within any radius of each other. A column n_near of prints is replaced, others stay whatever
    their names. An empty table gives an empty result. prints is read several times: give a written table.
    """
    is_asked = F.col("doc_id") % every == 0
    asked = prints.where(is_asked).select("fingerprint")
    copies = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    others = search(prints, asked, radius)
    others = others.join(copies.withColumnRenamed("fingerprint", "near"), "near").groupBy("fingerprint").agg(F.sum("n").alias("others"))
    counts = copies.join(asked.distinct(), "fingerprint", "left_semi").join(others, "fingerprint", "left")
    hint = F.broadcast if asked.count() <= BROADCAST_ROWS else lambda x: x
    counts = hint(counts.select(F.col("fingerprint").alias("_print"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_near")))
    joined = prints.join(counts, prints["fingerprint"] == counts["_print"], "left")
    return joined.select(*[prints[c] for c in prints.columns if c != "n_near"], F.when(prints["doc_id"] % every == 0, counts["_near"]).alias("n_near"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near(materialise(compare(table(spark, sf_dir, "documents")), "fingerprints"), radius=NEAR_RADIUS)
