"""Quality classifier: a byte-level convolutional network in numpy.

Every position of a document's bytes meets WIDTH learned tables, one for each byte of the filter, whose rows add up to
the responses of FILTERS filters. Rectified responses are max-pooled over overlapping chunks of 2 HALF bytes that cover
the whole document; the mean and the maximum over the chunks enter a hidden layer and a logistic output.

Training takes at most PER_CLASS labelled rows a class, chosen by hash of the id. Each of its STEPS draws BATCH windows of
TRAIN_BYTES bytes, which start anywhere in the whole text of a chosen row; what is drawn is settled from the sizes alone,
and the windows are cut where the texts are, so that the driver holds STEPS x BATCH windows at most however long the texts
are. Scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WIDTH, FILTERS, HIDDEN, HALF, PAD = 6, 24, 16, 128, 256
PER_CLASS, TRAIN_BYTES, STEPS, BATCH, RATE = 2500, 6144, 500, 48, 0.01
#: Positions convolved at once.
BLOCK = 16 * HALF
THRESHOLD = 0.3


class Network:
    """score() of whole texts; train() on (bytes, label, weight)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "table": (rng.normal(size=(WIDTH, 257, FILTERS)) * 0.3).astype(np.float32),
            "bias": np.full(FILTERS, 0.1, np.float32),
            "w1": (rng.normal(size=(2 * FILTERS, HIDDEN)) * (1 / FILTERS) ** 0.5).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": (rng.normal(size=HIDDEN) * 0.3).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Of positions 0 .. len(data) - WIDTH, before the bias."""
        n, t, data = len(data) - WIDTH + 1, self.p["table"], data.astype(np.intp)
        out = t[0].take(data[:n], axis=0)
        for j in range(1, WIDTH):
            out += t[j].take(data[j : j + n], axis=0)
        return out

    @staticmethod
    def padded(data: np.ndarray) -> np.ndarray:
        """Positions fill whole halves of chunks."""
        halves = max(1, -(-len(data) // HALF))
        out = np.full(halves * HALF + WIDTH - 1, PAD, np.uint16)
        out[: len(data)] = data
        return out

    def features(self, text: bytes) -> np.ndarray:
        data, halves = self.padded(np.frombuffer(text, np.uint8)), []
        for i in range(0, len(data) - WIDTH + 1, BLOCK):
            r = self.responses(data[i : i + BLOCK + WIDTH - 1])
            halves.append(r.reshape(-1, HALF, FILTERS).max(1))
        h = np.concatenate(halves) if len(halves) > 1 else halves[0]
        h = np.maximum(h + self.p["bias"], 0)
        chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        return np.concatenate([chunks.mean(0), chunks.max(0)])

    def output(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(features @ self.p["w1"] + self.p["b1"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.output(np.stack([self.features(t) for t in texts]))[1].astype(np.float64)

    def gradient(self, windows: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted log loss of some windows, and that loss."""
        p, features, routes = self.p, [], []
        for window in windows:
            data = self.padded(np.frombuffer(window, np.uint8))
            r = self.responses(data).reshape(-1, HALF, FILTERS)
            at = r.argmax(1)
            h = np.take_along_axis(r, at[:, None, :], 1)[:, 0, :]
            at = at + np.arange(len(h))[:, None] * HALF
            if len(h) > 1:
                later = h[1:] > h[:-1]
                h, at = np.where(later, h[1:], h[:-1]), np.where(later, at[1:], at[:-1])
            h = np.maximum(h + p["bias"], 0)
            features.append(np.concatenate([h.mean(0), h.max(0)]))
            routes.append((data, at, h > 0, h.argmax(0)))
        x = np.stack(features)
        hidden, score = self.output(x)
        share = weights / weights.sum()
        loss = -float((share * np.log(np.where(labels == 1, score, 1 - score))).sum())
        error = ((score - labels) * share).astype(x.dtype)
        inner = error[:, None] * p["w2"] * (1 - hidden**2)
        grad = {"w2": hidden.T @ error, "b2": np.array([error.sum()], x.dtype), "w1": x.T @ inner, "b1": inner.sum(0), "table": np.zeros_like(p["table"]), "bias": np.zeros_like(p["bias"])}
        back = inner @ p["w1"].T
        for (data, at, live, top), g in zip(routes, back, strict=True):
            d = np.repeat(g[None, :FILTERS] / len(at), len(at), 0)
            d[top, np.arange(FILTERS)] += g[FILTERS:]
            d = d * live
            grad["bias"] += d.sum(0)
            f = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                np.add.at(grad["table"][j], (data[at + j], f), d)
        return grad, loss

    def train(self, drawn: list[list[tuple[int, int]]], window, labels: np.ndarray, weights: np.ndarray) -> Network:
        """One step a batch of drawn (row, start); window(row, start) gives the bytes."""
        p = self.p
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        for step, batch in enumerate(drawn, 1):
            rate = RATE * (1 - (step - 1) / len(drawn))
            rows = [i for i, _ in batch]
            grad, _ = self.gradient([window(i, start) for i, start in batch], labels[rows], weights[rows])
            for k, g in grad.items():
                m, v = moment[k]
                g = g + 1e-4 * p[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def draws(sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[list[tuple[int, int]]]:
    """For each step (row, start) of its windows, half of either class; every position of a text may be drawn."""
    rng, by_class, out = np.random.default_rng(seed), [np.flatnonzero(labels == c) for c in (0, 1)], []
    for _ in range(steps):
        chosen = np.concatenate([rng.choice(rows, BATCH // 2) for rows in by_class])
        out.append([(int(i), int(rng.integers(0, max(1, sizes[i] - TRAIN_BYTES + 1)))) for i in chosen])
    return out


class Constant:
    """Where the labels don't hold two classes: their share of 1, or a half without any."""

    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = STEPS):
    """A model from at most per_class labelled rows a class that aren't held out (docs: doc_id, text; labels: doc_id, quality).

    Null ids and texts, labels other than 0 and 1 teach nothing; of labels that repeat an id the larger counts. Without two
    classes, and for empty tables, the model is a constant.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Constant(float(next(iter(counts))) if counts else 0.5)
    picked = None
    for c in (0, 1):
        some = known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    spark = docs.sparkSession
    ids = spark.createDataFrame([tuple(r) for r in picked.collect()], "doc_id long, quality int")  # at most 2 per_class rows
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").where("text is not null")
    # of rows that repeat an id one text, the one with the least hash, counts
    each = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))).alias("x"))
    known = sorted((r["doc_id"], r["x"]["h"], r["x"]["size"], r["quality"]) for r in each.collect())
    y = np.array([r[3] for r in known], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    drawn = draws(np.array([r[2] for r in known]), y, steps)
    wanted = sorted({x for batch in drawn for x in batch})
    wanted = spark.createDataFrame([(*known[i][:2], i, start) for i, start in wanted], "doc_id long, h long, i int, start int")  # at most steps x BATCH rows
    cut = F.expr(f"substring(cast(text as binary), start + 1, {TRAIN_BYTES})")
    met = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"])
    made = {(r["i"], r["start"]): bytes(r["w"]) for r in met.groupBy("i", "start").agg(F.first(cut).alias("w")).collect()}
    share = counts[1] / (counts[0] + counts[1])  # batches are half and half: weights restore the natural shares
    return Network().train(drawn, lambda i, start: made[i, start], y, np.where(y == 1, share, 1 - share).astype(np.float32))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text; more columns are ignored). Null text counts as empty."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, whatever their names.

    Null text counts as empty; repeated rows share a score; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(held.value.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
