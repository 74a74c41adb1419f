"""MinHash near-duplicates with tensored banding.

Two collections of SIDE half-keys are computed, each half-key from HALF_WIDTH minhash functions; a table's key joins one
half-key of either collection, so that SIDE squared tables come from 2 SIDE HALF_WIDTH minhash functions: about the
square root of what separate tables would take. A pair meets in some table if it shares a half-key in both collections;
at similarity 0.8 it is missed with probability 0.003, at 0.85 with 0.0003.

Equal sets are one vertex from the start, so copies cost one row each. Half-keys that no other set shares are dropped
before tables are formed. In a table's bucket, every set is compared with one hub; of the pairs that this leaves in
different components only those are compared that can be linked at all, given what either shares with the hub: a large
group of near copies costs about a comparison a member, and no link that decides a component is skipped. Every link is
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, table
from .simhash import hashed_words, mix

SIDE, HALF_WIDTH = 9, 3
#: Up to so many ids (8 and 16 bytes each) are broadcast to where the texts are; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Shingles hashed at once; places of a component's vertices.
BLOCK, SPREAD = 4096, 32
#: Rows of a key that are joined in one place: so many, or the MOST_BUSY-th part of all rows, so that at most MOST_BUSY keys
#: have more, and a list of these is broadcast.
KEY_ROWS, MOST_BUSY = 256, 100_000
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_MASKS = mix(np.arange(1, 2 * SIDE * HALF_WIDTH + 1, dtype=np.uint64) * _K[0])


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; fewer words: the whole sequence is one; none: empty."""
    words = hashed_words(text)
    n = len(words)
    if not n:
        return words
    width, length = min(width, n), np.uint64(min(width, n))
    made = np.full(n - width + 1, length, np.uint64)
    for j in range(width):
        made = mix((made + words[j : n - width + 1 + j]) * _K[1 + j % 4])
    return np.unique(made)


def half_keys(found: np.ndarray) -> np.ndarray:
    """2 SIDE keys, collection by collection."""
    least = np.full(len(_MASKS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), BLOCK):
        x = found[None, i : i + BLOCK] ^ _MASKS[:, None]  # hashes are mixed already: a mask and a multiplication reorder them
        x *= _K[0]
        x ^= x >> np.uint64(32)
        x *= _K[1]
        np.minimum(least, x.min(1), out=least)
    keys = least.reshape(-1, HALF_WIDTH)
    out = keys[:, 0]
    for j in range(1, HALF_WIDTH):
        out = mix(out * _K[2] + keys[:, j])
    return out


def identity(found: np.ndarray) -> bytes:
    """128 bits that name a set: two sums over all its members."""
    return np.array([mix(found).sum(dtype=np.uint64), mix(found ^ _K[4]).sum(dtype=np.uint64)]).tobytes()


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py() or "", width)
                sizes.append(len(found))
                if len(found):
                    ids.append(identity(found))
                    keys.append(half_keys(found).view(np.int64))
                else:
                    ids.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "v", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or "", width) for t in batch.column(1)]
            same = [i for i, v in enumerate(batch.column(0).to_pylist()) if len(found[i]) and identity(found[i]) == v]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int64())), pa.array([found[i].view(np.int64) for i in same], pa.list_(pa.int64()))], ["v", "members"])

    return run


def busy(counts: DataFrame, rows: int, *keys: str) -> DataFrame | None:
    """keys, salts: over how many places to deal the rows of each busy key; None if there is none. counts: keys, c; rows: the sum of c."""
    most = max(KEY_ROWS, rows // MOST_BUSY)
    often = materialise(counts.where(F.col("c") > most).select(*keys, F.ceil(F.col("c") / most).cast("int").alias("salts")), "busy")
    return None if often.isEmpty() else F.broadcast(often)


def by_key(rows: DataFrame, others: DataFrame, keys: list[str], dealt: str, often: DataFrame | None) -> DataFrame:
    """rows joined with others on keys: a busy key's rows are dealt over its places by hash of a column, others go to each."""
    if often is None:
        return rows.join(others, keys)
    place = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(dealt), F.col("salts"))).otherwise(0).cast("int")
    rows = rows.join(often, keys, "left").withColumn("place", place).drop("salts")
    others = others.join(often, keys, "left").withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return rows.join(others, [*keys, "place"]).drop("place")


def number(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("c"))


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """v, label: the least label of each vertex's component. edges: a, b; labels: v, label, a row a vertex.

    Rounds of taking the least label among neighbours, then the label of the vertex that gave it its name; each round is
    written, so that lineage stays short. Rounds grow with the logarithm of the longest chain, about.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    if both.isEmpty():
        return labels
    now = materialise(labels.withColumn("own", F.col("label")), "labels")
    often = busy(number(both, "b"), both.count(), "b")
    while True:
        least = by_key(both, now.select(F.col("v").alias("b"), "label"), ["b"], "a", often).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = now.join(least, "v", "left").select("v", "own", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # the vertex a label is named after may know a smaller one
        jump = step.where("label < own").groupBy(F.col("own").alias("name")).agg(F.min("label").alias("next"))
        # a large component's vertices share one label: they are dealt over SPREAD places
        jump = jump.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        step = step.withColumn("place", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int"))
        step = step.join(jump, (step["label"] == jump["name"]) & (step["place"] == jump["place"]), "left").select("v", "own", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        after = materialise(step, "labels")
        if after.where("label <> was").isEmpty():
            return after.select("v", "label")
        now = after.select("v", "label", "own")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; more columns are ignored).

    Words: runs of anything but ASCII white space, A-Z in lower case. Rows are linked if 100 |A n B| >= percent |A u B| on
    their sets of distinct width-word shingles. component_id: the smallest doc_id reachable, the row's own included; kept:
    it is the row's own. Null, empty or blank text: empty set, linked with nothing. Null doc_id: linked with nothing,
    component_id null, kept true. Rows that repeat a doc_id share it as a name: where their components differ each row has
    its own. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    signed = materialise(rows.mapInArrow(_signatures(width), "doc_id long, n_shingles long, v binary, keys array<long>"), "signatures")
    named = signed.where("doc_id is not null and v is not null")
    vertex = materialise(named.groupBy("v").agg(F.min("doc_id").alias("label"), F.first("keys").alias("keys"), F.count("*").alias("c")), "vertices")

    # half-keys that two sets share at least
    each = vertex.select("v", F.posexplode("keys").alias("slot", "half")).select("v", "slot", F.xxhash64("slot", "half").alias("half"))
    shared = each.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    live = each.join(shared, "half").groupBy("v").agg(F.collect_list(F.struct("slot", "half")).alias("live"))  # at most 2 SIDE
    left, right = (F.transform(F.filter("live", f), lambda x: x["half"]) for f in (lambda x: x["slot"] < SIDE, lambda x: x["slot"] >= SIDE))
    crossed = live.select("v", left.alias("l"), right.alias("r")).where("size(l) > 0 and size(r) > 0")
    keyed = crossed.select("v", F.explode("l").alias("l"), "r").select("v", "l", F.explode("r").alias("r")).select("v", F.xxhash64("l", "r").alias("key"))
    keyed = materialise(keyed, "tables")
    # the hub of a bucket is its set that meets most others, over all buckets: the middle of its group
    counts = materialise(number(keyed, "key").where("c > 1"), "counts")
    often = busy(counts, keyed.count(), "key")
    bucket = materialise(by_key(keyed, counts, ["key"], "v", often), "buckets")
    weight = bucket.groupBy("v").agg(F.sum("c").alias("weight"))
    hubs = bucket.join(weight, "v").groupBy("key").agg(F.max(F.struct("weight", "v"))["v"].alias("hub"))
    star = materialise(by_key(bucket, hubs, ["key"], "v", often).select("hub", "v").where("hub <> v").distinct(), "star")

    found = materialise(bucket.select("v").distinct().join(vertex.select("v", "label"), "v"), "candidates")
    # a text of each candidate set: any row with its doc_id and identity has it
    wanted = found.select("v", F.col("label").alias("doc_id"))
    hint = F.broadcast if found.count() <= BROADCAST_ROWS else lambda x: x
    texts = rows.join(hint(wanted), "doc_id")
    # rows that repeat a doc_id may bring another text: the identity tells
    members = texts.select("v", "text").mapInArrow(_sets(width), "v binary, members array<long>")
    members = materialise(members.groupBy("v").agg(F.first("members").alias("members")), "sets")

    def with_sets(pairs: DataFrame, x: str, y: str, often_x: DataFrame | None, often_y: DataFrame | None) -> DataFrame:
        for v, other, name, often in ((x, y, "sx", often_x), (y, x, "sy", often_y)):
            pairs = by_key(pairs, members.select(F.col("v").alias(v), F.col("members").alias(name)), [v], other, often)
        return pairs

    def compared(pairs: DataFrame, x: str, y: str, often_x: DataFrame | None, often_y: DataFrame | None) -> DataFrame:
        """The pairs with their full sets' sizes nx, ny, the size c of what they share, and whether that links them."""
        sets = with_sets(pairs, x, y, often_x, often_y).select(x, y, F.size("sx").alias("nx"), F.size("sy").alias("ny"), F.size(F.array_intersect("sx", "sy")).alias("c"))
        return sets.withColumn("linked", 100 * F.col("c").cast("long") >= percent * (F.col("nx") + F.col("ny") - F.col("c")))

    # a set is in SIDE squared buckets at most; a hub may be in any number of pairs
    busy_hubs = busy(number(star, "hub"), star.count(), "hub")
    star = materialise(compared(star, "v", "hub", None, busy_hubs), "compared")
    links = star.where("linked").select(F.col("v").alias("a"), F.col("hub").alias("b"))
    label = components(links, found.select("v", "label"))

    # Pairs of a hub's sets that lie in different components. x, not linked with the hub, and y share c(x, hub) shingles
    # of the hub at most; to be linked they must share `need` in all, so either y is small enough for need <= c(x, hub),
    # or they share shingles that the hub lacks, as many as are missing. With these in one order, the rare first, the
    # first one shared must leave either with enough to come.
    near = star.select("hub", "v", F.col("nx").alias("n"), "c").join(label, "v")
    near = by_key(near, label.select(F.col("v").alias("hub"), F.col("label").alias("home")), ["hub"], "v", busy_hubs)
    near = materialise(near, "homes")
    mixed = near.where("label <> home").select("hub").distinct()
    near = materialise(by_key(near, mixed, ["hub"], "v", busy_hubs), "near")
    outside, inside = near.where("label <> home"), near
    share = percent / (100 + percent)
    need = F.ceil(share * (F.col("n_x") + F.col("n_y")) - 1e-9) - F.least("c_x", "c_y")
    of = lambda df, end: df.select("hub", *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in ("hub", "shingle")], *[c for c in df.columns if c == "shingle"])
    low, high = F.ceil(F.col("n_x") * percent / 100.0 - 1e-9), F.floor(F.col("c_x") / share + 1e-9) - F.col("n_x")
    small = of(outside, "x").where(low <= high).withColumn("n_y", F.explode(F.sequence(low, high))).withColumn("n_y", F.col("n_y").cast("int"))
    often = busy(number(near.withColumnRenamed("n", "n_y"), "hub", "n_y"), near.count(), "hub", "n_y")
    small = by_key(of(inside, "y"), small, ["hub", "n_y"], "v_y", often).where((F.col("label_x") != F.col("label_y")) & (need <= 0))
    own = materialise(with_sets(near, "v", "hub", None, busy_hubs).select("hub", "v", "n", "c", "label", "home", F.explode(F.array_except("sx", "sy")).alias("shingle")), "own")
    counts = materialise(number(own, "hub", "shingle"), "counts")
    often = busy(counts, own.count(), "hub", "shingle")
    to_come = F.col("n") - F.col("c") - F.row_number().over(Window.partitionBy("hub", "v").orderBy("often", "shingle")) + 1
    # the first one shared leaves at least what the smallest partner would still need
    least = F.ceil(F.col("n") * percent / 100.0 - 1e-9) - F.col("c")
    counted = by_key(own, counts.withColumnRenamed("c", "often"), ["hub", "shingle"], "v", often)
    own = materialise(counted.withColumn("left", to_come).where((F.col("often") > 1) & (F.col("left") >= least)).drop("often"), "own")
    beside = by_key(of(own, "y"), of(own.where("label <> home"), "x"), ["hub", "shingle"], "v_y", often)
    beside = beside.where((F.col("label_x") != F.col("label_y")) & (need <= F.least("left_x", "left_y")))
    order = [F.least("v_x", "v_y").alias("a"), F.greatest("v_x", "v_y").alias("b")]
    pairs = materialise(small.select(*order).union(beside.select(*order)).distinct(), "pairs")
    busy_a, busy_b = (busy(number(pairs, x), pairs.count(), x) for x in ("a", "b"))
    late = materialise(compared(pairs, "a", "b", busy_a, busy_b).where("linked").select("a", "b"), "links")
    if not late.isEmpty():
        label = components(links.unionByName(late), found.select("v", "label"))

    final = vertex.select("v", "label").join(label.select("v", F.col("label").alias("joined")), "v", "left").select("v", F.coalesce("joined", "label").alias("component_id"))
    copies = busy(vertex.select("v", "c"), signed.count(), "v")  # of one set
    joined = by_key(named, final, ["v"], "doc_id", copies).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or v is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the smallest doc_id; all columns are kept, whatever their names.

    Rows that repeat a kept doc_id stay once a text. Null ids stay, all of them. Null and empty texts are linked with
    nothing and stay. An empty table gives an empty result.
    """
    marked = materialise(near_duplicates(docs.select("doc_id", "text"), width, percent).where("doc_id is not null").select("doc_id", "kept"), "kept")
    ids = marked.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = materialise(ids.where("not kept or n > 1").select(F.col("doc_id").alias("id"), "kept"), "gone")
    hint = F.broadcast if gone.count() <= BROADCAST_ROWS else lambda x: x
    columns, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # names of our own: any may clash
    doc_id, text = names[columns.index("doc_id")], names[columns.index("text")]
    rows, back = docs.toDF(*names), [F.col(x).alias(c) for x, c in zip(names, columns, strict=True)]
    once = rows.join(hint(gone.where("not kept")), F.col(doc_id).cast("long") == F.col("id"), "left_anti")
    twice = gone.where("kept").select("id")
    if twice.isEmpty():
        return once.select(*back)
    repeated = once.join(twice, F.col(doc_id).cast("long") == F.col("id"), "left_semi").dropDuplicates([doc_id, text])
    return once.join(twice, F.col(doc_id).cast("long") == F.col("id"), "left_anti").unionByName(repeated).select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
