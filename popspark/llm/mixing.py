"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they count for; in the registered query, their own source alone). A flow routes words from the patterns to
the sources' quotas; a pattern offers its words once at cost 1, a second time at 4, a third time at 9 (convex, so that
repetition is spread before it deepens). What flows out of a pattern fixes how often all its documents are taken and how
many words a seeded subset adds: documents come in hash order, whole hash buckets at a time, and only the bucket in
which the quota ends is filled document by document.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
#: Rows of a hash bucket, about.
BUCKET_ROWS = 2048
SPACE = 1 << 31
#: Up to so many sources their table is broadcast; beyond, joined by shuffle.
BROADCAST_ROWS = 50_000


def quotas(sizes: Sequence[int], weights: Sequence[float], share: float = 1.0, most: int = MOST_COPIES) -> list[float]:
    """Targets by weight that add up to share of all sizes; each stops at most times its size, the excess goes to the others by weight."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left, weight = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= set(over)
    return out


def flow(patterns: Sequence[tuple[frozenset[int], int]], wanted: Sequence[int], most: int = MOST_COPIES) -> list[dict[int, int]]:
    """For each (sources, words) the words it gives to each source: as much of wanted as can be met, at the least cost.

    Successive shortest paths with potentials. Cost of a pattern's k-th copy: k squared.
    """
    n, m = len(patterns), len(wanted)
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, capacity, cost, index of the reverse]
    start, end = n + m, n + m + 1

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (sources, words) in enumerate(patterns):
        for k in range(1, most + 1):
            arc(start, p, int(words), k * k)
        for s in sorted(sources):
            arc(p, n + s, most * int(words), 0)
    for s, words in enumerate(wanted):
        arc(n + s, end, int(words), 0)
    potential = [0] * len(graph)
    while True:
        best, via = [None] * len(graph), [None] * len(graph)
        best[start], queue = 0, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > best[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity > 0 and (best[b] is None or d + cost + potential[a] - potential[b] < best[b]):
                    best[b], via[b] = d + cost + potential[a] - potential[b], (a, i)
                    heapq.heappush(queue, (best[b], b))
        if best[end] is None:
            break
        potential = [h + (b if b is not None else best[end]) for h, b in zip(potential, best, strict=True)]
        path, at = [], end
        while at != start:
            a, i = via[at]
            path.append((a, i))
            at = a
        amount = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= amount
            graph[graph[a][i][0]][graph[a][i][3]][1] += amount
    return [{e[0] - n: graph[e[0]][e[3]][1] for e in graph[p] if n <= e[0] < n + m and graph[e[0]][e[3]][1]} for p in range(n)]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """In hash order, each document that still fits; then copies added, or exchanged one for one, while that closes what is left."""
    rows = rows.sort_values(["u", "doc_id", "h", "size"], na_position="last", kind="stable")
    sizes, base = rows["size"].to_numpy(), int(rows["base"].iloc[0])
    left, extra = int(rows["room"].iloc[0]), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        if base < MOST_COPIES and 0 < size <= left:
            extra[i], left = 1, left - int(size)
    while left > 0:
        into, out = np.flatnonzero((extra < MOST_COPIES - base) & (sizes > 0)), np.flatnonzero((extra > -base) & (sizes > 0))
        if not len(into):
            break
        gives = np.concatenate([[0], np.sort(sizes[out], kind="stable")])  # nothing, or a copy of what is in
        which = np.concatenate([[-1], out[np.argsort(sizes[out], kind="stable")]])
        at = np.searchsorted(gives, sizes[into] - left)  # the smallest that makes room
        gain = np.where(at < len(gives), sizes[into] - gives[np.minimum(at, len(gives) - 1)], 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        extra[into[best]] += 1
        if which[at[best]] >= 0:
            extra[which[at[best]]] -= 1
        left -= int(gain[best])
    return rows.assign(extra=extra)[["pattern", "doc_id", "h", "size", "extra"]]


def take(sized: DataFrame, amounts: DataFrame, seed: int = 5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pattern, doc_id, h, size, copies: how often each row is taken.

    sized: pattern int, doc_id, h (hash of the text), size. amounts: pattern, rows, words (of all its rows), amount (words to take). Every row
    of a pattern is taken floor(amount / words) times, and a seeded subset once more; in the bucket where the amount ends
    single rows may differ by more copies, within MOST_COPIES, where that brings the sum nearer.
    """
    hint = F.broadcast if amounts.count() <= BROADCAST_ROWS else lambda x: x
    amounts = amounts.select(
        "pattern",
        F.when(F.col("words") > 0, F.expr("amount div words")).otherwise(F.lit(0)).alias("base"),
        F.when(F.col("words") > 0, F.col("amount") % F.col("words")).otherwise(F.lit(0)).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).alias("buckets"),
    )
    # by text too: rows that repeat an id, or have none, don't meet in one bucket
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.lit(SPACE))
    rows = sized.select("pattern", "doc_id", "h", "size", u.alias("u")).join(hint(amounts), "pattern").withColumn("bucket", F.expr(f"u * buckets div {SPACE}"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # buckets that fit whole lie below the one in which the rest ends
    last = sums.where("before <= rest and before + words > rest").groupBy("pattern").agg(F.min("bucket").alias("last"), F.min_by(F.col("rest") - F.col("before"), "bucket").alias("room"))
    rows = rows.join(hint(last), "pattern", "left")
    whole = rows.where("last is null or bucket <> last").select("pattern", "doc_id", "h", "size", (F.col("base") + F.when(F.col("bucket") < F.col("last"), 1).otherwise(0)).alias("copies"))
    edge = rows.where("bucket = last")
    filled = edge.groupBy("pattern").applyInPandas(_fill, "pattern int, doc_id long, h long, size long, extra int").join(hint(amounts), "pattern").select("pattern", "doc_id", "h", "size", (F.col("base") + F.col("extra")).alias("copies"))
    return whole.unionByName(filled)


def by_code_point(source: str | None) -> tuple[bool, bytes]:
    return (source is None, (source or "").encode())


def blend(docs: DataFrame, sources: Column, weight=lambda rank: 1.0 + rank % 3, share: float = 1.0, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """How often each row is taken where a document may count for several sources: sources is its array of them.

    The rows: doc_id, h, size, sources, copies. The plan, a row for each pattern and source: pattern, sources, source,
    words (of the pattern), routed (words it gives to the source), target (of the source).

    A pattern is the set of a document's sources; a null array counts for no source and is never taken. Sources rank by
    code point, null last (a source of its own), and weigh weight(rank); their targets stop at MOST_COPIES times the words
    that may count for them. Null or blank text: size 0. Repeated rows are rows of their own. An empty table gives empty
    results. Patterns and sources must suit the driver: it solves the flow over their sums, never over documents.
    """
    spark = docs.sparkSession
    columns = [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), words(docs["text"]).alias("size")]
    sized = materialise(docs.select(*columns, F.array_sort(F.array_distinct(sources)).alias("sources")), "mix")
    sums = [(None if r["sources"] is None else tuple(sorted(r["sources"], key=by_code_point)), r["words"], r["rows"], r["sources"]) for r in sized.groupBy("sources").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()]
    sums.sort(key=lambda r: (r[0] is None, [by_code_point(x) for x in r[0] or ()]))
    names = sorted({x for r in sums for x in r[0] or ()}, key=by_code_point)
    rank = {x: i for i, x in enumerate(names)}
    members = [frozenset(rank[x] for x in r[0] or ()) for r in sums]
    sizes = [0] * len(names)
    for m, r in zip(members, sums, strict=True):
        for i in m:
            sizes[i] += r[1]
    total = sum(r[1] for m, r in zip(members, sums, strict=True) if m)
    targets = quotas(sizes, [weight(i) for i in range(len(names))], share * total / max(1, sum(sizes)))
    routed = flow([(m, r[1]) for m, r in zip(members, sums, strict=True)], [round(t) for t in targets])
    plan = spark.createDataFrame(
        [(p, r[3], names[i], r[1], routed[p].get(i, 0), targets[i], sizes[i]) for p, (m, r) in enumerate(zip(members, sums, strict=True)) for i in sorted(m)],
        "pattern int, sources array<string>, source string, words long, routed long, target double, source_size long",
    )
    amounts = spark.createDataFrame([(p, r[3], r[2], r[1], sum(routed[p].values())) for p, r in enumerate(sums)], "pattern int, sources array<string>, rows long, words long, amount long")
    hint = F.broadcast if len(sums) <= BROADCAST_ROWS else lambda x: x
    known = hint(amounts.select("pattern", F.col("sources").alias("named")))
    taken = take(sized.join(known, sized["sources"].eqNullSafe(F.col("named"))).select("pattern", "doc_id", "h", "size"), amounts.drop("sources"), seed)
    return taken.join(hint(amounts.select("pattern", "sources")), "pattern"), plan


def mix(docs: DataFrame, weight=lambda rank: 1.0 + rank % 3, share: float = 1.0, seed: int = 5) -> DataFrame:
    """doc_id, source, h, size, source_size, target, copies, taken for every row of docs (doc_id, text, source; more columns are ignored).

    blend() where a row counts for its own source alone, a null one being a source of its own.
    """
    rows, plan = blend(docs, F.array(docs["source"]), weight, share, seed)
    hint = F.broadcast if plan.count() <= BROADCAST_ROWS else lambda x: x
    out = rows.join(hint(plan.select("pattern", "source", "source_size", "target")), "pattern")
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat(docs: DataFrame, seed: int = 5) -> DataFrame:
    """docs with every row as often as the mix takes it, with all its columns, whatever their names.

    Rows that repeat id, source and text share the largest count of theirs. Null ids, sources and texts are values of
    their own; null and blank texts add no words and come as often as their place among
    their source's documents has it. An empty table gives an empty result.
    """
    counts = mix(docs, seed=seed).groupBy("doc_id", "source", "h").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    given = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of our own: any may clash
    name = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    same = name["doc_id"].cast("long").eqNullSafe(F.col("doc_id")) & name["source"].eqNullSafe(F.col("source")) & F.xxhash64(name["text"]).eqNullSafe(F.col("h"))
    kept = given.join(counts, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
