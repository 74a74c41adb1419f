"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level each child draws ln(u) / weight, with u a hash of the row's key and the child's path, and the largest
draw wins. A child's draw depends on nothing but the key, its own path and its own weight, so a changed weight moves
rows only into or out of the subtree that carries it. A grown tree attaches the new shard as a subtree of its own, so
that no other weight changes and rows move only into the new shard.

Everything is built-in expressions: placing a row needs no shuffle, slots need one of (shard, bucket) groups whose size
is bounded, plus a running sum over the few group counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

#: Rows that share one window when slots are dealt.
SLOT_GROUP = 4096


@dataclass(frozen=True)
class Shard:
    id: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """regions > racks > shards. Weights of inner nodes are the sums of what is below."""

    regions: tuple[tuple[tuple[Shard, ...], ...], ...]

    @classmethod
    def balanced(cls, shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
        """Shards 0.. in racks of per_rack and regions of racks; the last may be smaller."""
        if shards < 1:
            raise ValueError("a tree needs a shard")
        flat = [tuple(Shard(i) for i in range(k, min(shards, k + per_rack))) for k in range(0, shards, per_rack)]
        return cls(tuple(tuple(flat[k : k + racks]) for k in range(0, len(flat), racks)))

    def shards(self) -> list[Shard]:
        return [s for region in self.regions for rack in region for s in rack]

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, as a subtree of its own: no weight on any other path changes."""
        return Tree((*self.regions, ((Shard(1 + max(s.id for s in self.shards()), weight),),)))


def _uniform(seed: str, path: Column, key: Column) -> Column:
    """(0, 1) from 52 bits of a hash."""
    digest = F.substring(F.md5(F.concat_ws("/", F.lit(seed), path, key).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def place(key: Column, tree: Tree, seed: str = "tree") -> Column:
    """The shard of a key. A null key is a key of its own."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def literal() -> Column:
        def leaf(path: str, s: Shard) -> Column:
            return F.struct(F.lit(f"{path}.{s.id}").alias("path"), F.lit(float(s.weight)).alias("w"), F.lit(s.id).alias("below"))

        def node(path: str, w: float, below: list[Column]) -> Column:
            return F.struct(F.lit(path).alias("path"), F.lit(float(w)).alias("w"), F.array(*below).alias("below"))

        regions = []
        for r, region in enumerate(tree.regions):
            racks = [node(f"{r}.{k}", sum(s.weight for s in rack), [leaf(f"{r}.{k}", s) for s in rack]) for k, rack in enumerate(region)]
            regions.append(node(f"{r}", sum(s.weight for rack in region for s in rack), racks))
        return F.array(*regions)

    def choose(nodes: Column) -> Column:
        draws = F.transform(nodes, lambda n: F.struct((F.ln(_uniform(seed, n["path"], key)) / n["w"]).alias("draw"), n["path"].alias("path"), n["below"].alias("below")))
        return F.array_max(draws)["below"]

    return choose(choose(choose(literal())))


def shard(docs: DataFrame, tree: Tree, seed: str = "tree") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text; more columns are ignored).

    Null or empty text: 8 bytes, CRC 0. Null doc_id: a key of its own. Repeated rows share the shard and get slots of
    their own. Equal texts under different ids are independent (law `key`: id and tree decide). An empty table gives an
    empty result. Slots run from 0 without gaps in each shard, by (hash bucket, doc_id, CRC, size).
    """
    key, crc = F.col("doc_id"), F.crc32(text_or_empty().cast("binary"))
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 8
    placed = docs.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), place(key, tree, seed).alias("shard"), place(key, tree.grown(), seed).alias("grown_shard")
    )
    placed = materialise(placed, "placed")  # one scan of the texts
    groups = max(1, -(-placed.count() // (SLOT_GROUP * len(tree.shards()))))
    # by text too: rows that repeat an id, or have none, don't meet in one bucket
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(groups)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside))
    return ranked.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    return shard(table(spark, sf_dir, "documents"), Tree.balanced(24))
