"""LM scoring by masked pseudo-likelihood.

All words are counted exactly, in a table that grows with the corpus. Words fall into units, units into classes. The most
frequent SINGLES words are classes of their own. The classes of the rest are shapes (a hash of a word's last bytes), a
number that grows with the cube root of that of distinct words; in each, the most frequent words are units of their own, and the
others share RARE units by hash. A bidirectional window network in numpy weighs and sums the embeddings of the units of
the SIDES neighbours on both sides; one softmax gives the class, a second one, of the class, the unit, and within a rare
unit words have their share of its exact count. A document's score is the sum over its words of the log probability of
the word given both sides.

The HEAD most frequent words go to the workers with their counts; the rest of a document's words meet the table in a join.
A word that the table doesn't have counts as UNSEEN; every unit keeps that much mass for one.

Training: every position of every row teaches once. Texts are dealt by hash into groups of about GROUP_TOKENS words, whose
number grows with the corpus. A group is one sorted stream that starts from the parameters of the round before; of the
ROUNDS rounds each learns from every ROUNDS-th position, other ones each, so that together they take all. The parameters of
the groups are averaged, weighted by what they learned from, in the order of the groups, so that one table gives one model
however its rows are partitioned. They are of bounded size and meet in two steps, so that no task gathers all of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

#: Classes of one word; frequent words that are units, and rare units, a class of more; neighbours a side; embedding size.
SINGLES, FREQUENT, RARE, SIDES, DIM = 32, 32, 16, 2, 16
#: Rounds, which share out all positions; step length; positions of a step; words of a group.
ROUNDS, RATE, BATCH, GROUP_TOKENS = 2, 0.2, 16_384, 4_000_000
#: Words sent to the workers with their counts; occurrences of a word without any; distinct words a task counts at once.
HEAD, UNSEEN, COUNTED = 200_000, 0.5, 400_000
#: Positions scored at once, and classes' logits held at once; steps of the log count that the head is cut off by.
BLOCK, INNER, COUNT_STEPS = 32_768, 4096, 1000


def split(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shapes_for(distinct: int) -> int:
    return max(16, round(0.6 * distinct ** (1 / 3)))


class Model:
    """Units, classes, parameters. top: the most frequent words (word, n), most frequent first; rare: counts of the rare
    units, shape by shape; shapes: how many.

    Units: the SINGLES first words, then shape by shape its frequent words and its RARE rare units; pad comes after.
    head: word -> index of units and logs for the most frequent words; words: the table (word, n) of all.
    """

    words: DataFrame | None = None

    def __init__(self, top: list[tuple[bytes, int]], rare: np.ndarray, shapes: int, head: list[tuple[bytes, int]] = (), seed: int = 3):
        self.shapes, self.classes = shapes, SINGLES + shapes
        frequent: list[list[tuple[bytes, int]]] = [[] for _ in range(shapes)]
        for word, n in top[SINGLES:]:
            frequent[crc32(word[-2:]) % shapes].append((word, n))
        counts = [n for _, n in top[:SINGLES]] + [0] * (SINGLES - len(top[:SINGLES]))
        self.own = {word: i for i, (word, _) in enumerate(top[:SINGLES])}
        edges = [SINGLES]
        self.first_rare = []
        for s, found in enumerate(frequent):
            for word, n in found:
                self.own[word] = len(counts)
                counts.append(n)
            self.first_rare.append(len(counts))
            counts += rare[s * RARE : (s + 1) * RARE].tolist()
            edges.append(len(counts))
        mass = np.array(counts, np.float64) + UNSEEN
        self.units, self.edges, self.mass = len(counts), np.array(edges), np.log(mass)
        self.pad = self.units
        self.of = np.concatenate([np.arange(SINGLES), SINGLES + np.repeat(np.arange(shapes), np.diff(edges))]).astype(np.int32)
        self.kind = np.dtype("<u2" if self.units < 65_535 else "<u4")
        # head words: unit, and log of the count less that of the unit
        self.head = {word: i for i, (word, _) in enumerate(head)}
        self.head_unit = np.array([self.unit(word) for word, _ in head], np.int64)
        self.head_log = np.log(np.array([n for _, n in head], np.float64)) - self.mass[self.head_unit] if len(head) else np.zeros(0)
        rng = np.random.default_rng(seed)
        by_class = np.bincount(self.of, mass, self.classes)
        self.flat = np.concatenate(
            [
                (rng.normal(size=(self.units + 1) * DIM) * 0.3).astype(np.float32),
                np.ones(2 * SIDES * DIM, np.float32),
                (rng.normal(size=self.classes * DIM) * 0.1).astype(np.float32),
                np.log(by_class / mass.sum()).astype(np.float32),
                (rng.normal(size=self.units * DIM) * 0.1).astype(np.float32),
                np.log(mass / by_class[self.of]).astype(np.float32),
            ]
        )

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}  # a table stays with the driver

    def unit(self, word: bytes) -> int:
        found = self.own.get(word)
        return self.first_rare[crc32(word[-2:]) % self.shapes] + crc32(word) % RARE if found is None else found

    def parts(self, flat: np.ndarray, first: int = 0) -> tuple[np.ndarray, ...]:
        """Views: embeddings of units, weights of the neighbours' places, classes (rows, bias), units within classes (rows, bias); from the first on."""
        out, at = [], 0
        for shape in ((self.units + 1, DIM), (2 * SIDES, DIM), (self.classes, DIM), (self.classes,), (self.units, DIM), (self.units,))[first:]:
            size = math.prod(shape)
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return tuple(out)

    def padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts with SIDES pads before, between and after them, and the places of their units."""
        gap = np.full(SIDES, self.pad, self.kind)
        line = np.concatenate([gap, *(x for t in texts for x in (t, gap))], dtype=self.kind, casting="unsafe")
        return line, np.flatnonzero(line != self.pad)

    @staticmethod
    def neighbours(line: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.stack([line[at + j] for j in (*range(-SIDES, 0), *range(1, SIDES + 1))])

    @staticmethod
    def ends(rows: np.ndarray, bias: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with their bias less what keeps exponentials from overflowing, the same for every row of a softmax; starts: its first row. Whether that does for each softmax."""
        reach = np.abs(rows).sum(1)  # hidden values lie within -1 and 1
        high, low = np.maximum.reduceat(bias + reach, starts), np.minimum.reduceat(bias - reach, starts)
        return np.column_stack([rows, bias - np.repeat(high, np.diff(starts, append=len(bias)))]), high - low < 80

    @staticmethod
    def raised(h: np.ndarray, ends: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Exponentials of the logits h ends', less their maximum, which comes along, where there is no bound."""
        logits, most = h @ ends.T, None
        if not bounded:
            most = logits.max(1)
            logits -= most[:, None]
        return np.exp(logits, out=logits), most

    def hidden(self, p: tuple[np.ndarray, ...], near: np.ndarray) -> np.ndarray:
        """Hidden values, and a column of ones for the bias."""
        total = (p[0] * p[1][0]).take(near[0], axis=0)
        for w, x in zip(p[1][1:], near[1:], strict=True):
            total += (p[0] * w).take(x, axis=0)
        h = np.ones((len(total), DIM + 1), total.dtype)
        np.tanh(total, out=h[:, :DIM])
        return h

    def levels(self, p: tuple[np.ndarray, ...], truth: np.ndarray) -> Iterator[tuple]:
        """For the classes and for the units, of truth in order: rows, bias, the softmaxes' first rows, first position, the true
        rows from there on, and (first position, last + 1, first row, last + 1, softmax) of each piece."""
        n = len(truth)
        yield p[2], p[3], np.zeros(1, np.int64), 0, self.of[truth], [(i, min(n, i + INNER), 0, self.classes, 0) for i in range(0, n, INNER)]
        at = np.searchsorted(truth, self.edges)  # a class of one word has no choice left
        pieces = [(int(at[s]), int(at[s + 1]), int(self.edges[s]), int(self.edges[s + 1]), s + SINGLES) for s in np.flatnonzero(np.diff(at))]
        yield p[4], p[5], np.concatenate([np.arange(SINGLES), self.edges[:-1]]), int(at[0]), truth[at[0] :], pieces

    def sorted(self, near: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions by their unit: classes lie together, and in them units."""
        order = np.argsort(truth.astype(self.kind, copy=False), kind="stable")
        return order, near.take(order, axis=1), truth.take(order).astype(np.int64)

    def log_probs(self, near: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """Log probability of each unit given its neighbours."""
        p = self.parts(self.flat)
        order, near, truth = self.sorted(near, truth)
        h, logs = self.hidden(p, near), np.zeros(len(truth))
        for rows, bias, starts, first, own, pieces in self.levels(p, truth):
            ends, bounded = self.ends(rows, bias, starts)
            logs[first:] += np.einsum("ij,ij->i", h[first:], ends.take(own, axis=0))
            sums = np.ones(len(truth), h.dtype)
            for a, b, u, v, s in pieces:
                raised, most = self.raised(h[a:b], ends[u:v], bounded[s])
                raised.sum(1, out=sums[a:b])
                if most is not None:
                    logs[a:b] -= most
            logs -= np.log(sums)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text the sum of the log probabilities of its units."""
        line, at = self.padded(texts)
        logs = np.zeros(len(at) + 1)
        for i in range(0, len(at), BLOCK):
            logs[i : i + BLOCK][: len(at) - i] = self.log_probs(self.neighbours(line, at[i : i + BLOCK]), line[at[i : i + BLOCK]])
        ends = np.cumsum([len(t) for t in texts])
        return np.array([float(logs[e - len(t) : e].sum()) for t, e in zip(texts, ends, strict=True)])

    def gradient(self, flat: np.ndarray, near: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of the mean loss: rows of embeddings and their gradient, the gradient of all that comes after the embeddings; the loss."""
        p, n, size = self.parts(flat), len(truth), (self.units + 1) * DIM
        whole = np.zeros(len(flat) - size, flat.dtype)
        places, *of_level = self.parts(whole, 1)
        _, near, truth = self.sorted(near, truth)
        h, back, loss = self.hidden(p, near), np.zeros((n, DIM), flat.dtype), 0.0
        for level, (rows, bias, starts, first, own, pieces) in enumerate(self.levels(p, truth)):
            ends, bounded = self.ends(rows, bias, starts)
            plain = np.column_stack([rows, np.ones_like(bias)])
            found = np.zeros_like(plain)
            for a, b, u, v, s in pieces:
                some = h[a:b]
                raised, most = self.raised(some, ends[u:v], bounded[s])
                to = raised @ plain[u:v]  # sums of the exponentials in the last column
                part = 1 / to[:, -1:]
                found[u:v] += raised.T @ (some * part)
                to *= part
                back[a:b] += to[:, :-1]
                loss -= float(np.log(part).sum()) - (0.0 if most is None else float(most.sum()))
            if len(own):
                true = ends.take(own, axis=0)
                loss -= float(np.einsum("ij,ij->", h[first:], true))
                back[first:] -= true[:, :-1]
                runs = np.flatnonzero(np.diff(own, prepend=-1))
                found[own[runs]] -= np.add.reduceat(h[first:], runs, axis=0)
            of_level[2 * level][:], of_level[2 * level + 1][:] = found[:, :-1], found[:, -1]
        back *= 1 - h[:, :-1] ** 2
        embedded, seen = np.zeros((self.units + 1, DIM), flat.dtype), np.zeros(self.units + 1, bool)
        for j, x in enumerate(near):
            order = np.argsort(x.astype(self.kind, copy=False), kind="stable")
            at = x.take(order).astype(np.int64)
            runs = np.flatnonzero(np.diff(at, prepend=-1))
            at, sums = at[runs], np.add.reduceat(back.take(order, axis=0), runs, axis=0)
            places[j] = (p[0][at] * sums).sum(0)
            embedded[at] += sums * p[1][j]
            seen[at] = True
        rows = np.flatnonzero(seen)
        return rows, embedded[rows] / n, whole / n, loss / n

    def step(self, flat: np.ndarray, past: np.ndarray, near: np.ndarray, truth: np.ndarray) -> float:
        """One Adagrad step in place; the loss before."""
        rows, embedded, whole, loss = self.gradient(flat, near, truth)
        e, seen = self.parts(flat)[0], self.parts(past)[0]
        now = seen[rows] + embedded * embedded
        seen[rows] = now
        e[rows] -= RATE * embedded / (np.sqrt(now) + 1e-4)
        rest, before = flat[e.size :], past[e.size :]
        before += whole * whole
        rest -= RATE * whole / (np.sqrt(before) + 1e-4)
        return loss


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column(0):
            counts.update(split(text.as_py() or ""))
            if len(counts) >= COUNTED:
                yield flush()
    if counts:
        yield flush()


def units(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, units (bytes), own (what the head's words add to the score), rest (the other words), for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            sizes, made, own, rest = [], [], [], []
            for text in batch.column(1):
                words = split(text.as_py() or "")
                code = np.fromiter(map(model.head.get, words, repeat(-1)), np.int64, len(words))
                out = code < 0
                others = [words[i] for i in np.flatnonzero(out)]
                found = np.empty(len(words), np.int64)
                found[out] = [model.unit(w) for w in others]
                found[~out] = model.head_unit[code[~out]]
                sizes.append(len(words))
                made.append(found.astype(model.kind).tobytes())
                # of the others the share within the unit is still to come from the table
                own.append(float(model.head_log[code[~out]].sum() - model.mass[found[out]].sum()))
                rest.append(others)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.binary()), pa.array(own, pa.float64()), pa.array(rest, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "units", "own", "rest"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, units binary, own double, rest array<binary>")


def _train(held, turn: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (grp, units, times) come sorted by group; grp, weight, flat for each."""
        model: Model = held.value
        group, flat, past, seen, waiting, words = None, None, None, 0, 0, 0
        texts: list[np.ndarray] = []
        near: list[np.ndarray] = []
        truth: list[np.ndarray] = []

        def take() -> None:
            """The turn's positions of the texts; which ones depends on a text alone."""
            nonlocal waiting, seen, words
            line, at = model.padded(texts)
            sizes = np.array([len(t) for t in texts])
            ends = np.repeat(sizes.cumsum(), sizes)  # positions are told from the end of their text
            at = at[(turn + np.arange(len(at)) - ends) % parts == 0]
            texts.clear()
            words = 0
            for i in range(0, len(at), BLOCK):
                some = at[i : i + BLOCK]
                near.append(model.neighbours(line, some))
                truth.append(line[some])
                waiting, seen = waiting + len(some), seen + len(some)
                learn(False)

        def learn(all_: bool) -> None:
            nonlocal waiting
            if waiting and (all_ or waiting >= BATCH):
                x, y = np.concatenate(near, 1), np.concatenate(truth)
                stop = waiting if all_ else waiting - waiting % BATCH
                for i in range(0, stop, BATCH):
                    model.step(flat, past, x[:, i : i + BATCH][:, : stop - i], y[i : min(stop, i + BATCH)])
                near[:], truth[:] = [x[:, stop:]], [y[stop:]]
                waiting -= stop

        def done() -> pa.RecordBatch:
            if texts:
                take()
            learn(True)
            near.clear()
            truth.clear()
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([float(seen)]), pa.array([flat.tobytes()], pa.binary())], ["grp", "weight", "flat"])

        for batch in batches:
            for now, data, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if now != group:
                    if group is not None:
                        yield done()
                    group, flat, past, seen, waiting = now, model.flat.copy(), np.zeros_like(model.flat), 0, 0
                found = np.frombuffer(data.as_py(), model.kind)
                for _ in range(times):
                    texts.append(found)
                    words += len(found)
                    if words >= BLOCK:
                        take()
        if group is not None:
            yield done()

    return run


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean of the parameters, in the order of their names."""
    rows = rows.sort_values("grp")
    weight = rows["weight"].to_numpy()
    total = np.zeros(len(rows["flat"].iloc[0]) // 4)
    for w, flat in zip(weight, rows["flat"], strict=True):
        total += w * np.frombuffer(flat, np.float32)
    return pd.DataFrame({"grp": [rows["some"].iloc[0]], "weight": [weight.sum()], "flat": [(total / max(weight.sum(), 1.0)).astype(np.float32).tobytes()]})


def _most_frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the table, most frequent first, down to a step of the log count: as many whole steps as most holds. No task sends more."""
    step = F.floor(F.log("n") * COUNT_STEPS).cast("int")
    found, least = 0, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most COUNT_STEPS times the largest log count
        found += r["count"]
        if found > most:
            break
        least = r["step"]
    rows = words.where(F.lit(False) if least is None else step >= least).collect()  # at most `most`
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _rare(word: Column, shapes: int) -> tuple[Column, Column]:
    return (F.crc32(F.substring(word, -2, 2)) % shapes).alias("shape"), (F.crc32(word) % RARE).alias("slot")


def counted(docs: DataFrame) -> tuple[Model, int]:
    """A model that has the counts of all words, untrained, and how many words there are."""
    small_batches(docs.sparkSession)
    texts = docs.select("text").where("text is not null")
    words = materialise(texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).collect()[0]
    shapes = shapes_for(sums["distinct"])
    head = _most_frequent(words, max(HEAD, 2 * (SINGLES + FREQUENT * shapes)))
    top, head = head[: SINGLES + FREQUENT * shapes], head[:HEAD]
    rare = np.zeros(shapes * RARE)
    for r in words.groupBy(*_rare(F.col("word"), shapes)).agg(F.sum("n").alias("n")).collect():  # at most shapes * RARE
        rare[r["shape"] * RARE + r["slot"]] = r["n"]
    for word, n in top:
        rare[crc32(word[-2:]) % shapes * RARE + crc32(word) % RARE] -= n
    model = Model(top, rare, shapes, head)
    model.words = words
    return model, sums["tokens"]


def _dealt(made: DataFrame, groups: int) -> DataFrame:
    """grp, h, doc_id, units, times: all rows that have words. Those that repeat both id and text are counted, and shared out evenly from their group on: no key is hot."""
    rows = made.where("n_tokens > 0").groupBy("doc_id", "units").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "units", "n", F.xxhash64("doc_id", "units").alias("h"), F.pmod(F.xxhash64("units", "doc_id"), F.lit(groups)).alias("first"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(groups)) - 1)))
    times = F.expr(f"n div {groups}") + (F.col("i") < F.col("n") % groups).cast("long")
    return rows.select(((F.col("first") + F.col("i")) % groups).alias("grp"), "h", "doc_id", "units", times.alias("times"))


def train(model: Model, made: DataFrame, tokens: int, rounds: int = ROUNDS, parts: int | None = None, group_tokens: int = GROUP_TOKENS) -> int:
    """Train the model in place on units(docs, model), of so many tokens: in each round on every parts-th position; unless told
    otherwise there are as many parts as rounds, and each position teaches once. How many positions taught."""
    spark, groups, taught = made.sparkSession, max(1, tokens // group_tokens), 0
    dealt = materialise(_dealt(made, groups), "dealt")
    for i in range(rounds if tokens else 0):
        rows = dealt.repartitionById(groups, F.col("grp").cast("int")).sortWithinPartitions("grp", "h", "doc_id", "units").select("grp", "units", "times")
        learned = rows.mapInArrow(_train(spark.sparkContext.broadcast(model), i, parts or rounds), "grp long, weight double, flat binary")
        learned = materialise(learned.withColumn("some", F.expr(f"grp div {math.isqrt(groups)}")), "parameters")
        halfway = learned.groupBy("some").applyInPandas(_mean, "grp long, weight double, flat binary")
        total = halfway.withColumn("some", F.lit(0).cast("long")).groupBy("some").applyInPandas(_mean, "grp long, weight double, flat binary").collect()
        if total[0]["weight"]:  # a few short texts may have no position in a round
            model.flat = np.frombuffer(total[0]["flat"], np.float32).copy()
            taught += int(total[0]["weight"])
    return taught


def fit(docs: DataFrame, rounds: int = ROUNDS, parts: int | None = None, group_tokens: int = GROUP_TOKENS) -> Model:
    """A model of all texts of docs (text; doc_id keeps copies apart; more columns are ignored). Null and empty texts add nothing; an empty table gives a model without counts."""
    model, tokens = counted(docs)
    if rounds:
        train(model, materialise(units(docs, model), "units"), tokens, rounds, parts, group_tokens)
    return model


def scored(made: DataFrame, model: Model) -> DataFrame:
    """score() from units(docs, model)."""
    held = made.sparkSession.sparkContext.broadcast(model)  # grows with the cube root of the number of distinct words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            texts = [np.frombuffer(x, model.kind) for x in batch.column(2).to_pylist()]
            own = batch.column(3).to_numpy() + model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.float64()), batch.column(4)], ["doc_id", "n_tokens", "own", "rest"])

    part = made.mapInArrow(run, "doc_id long, n_tokens long, own double, rest array<binary>")
    part = materialise(part.withColumn("row", F.monotonically_increasing_id()), "scored")  # written once, so row stays
    rest = part.select("row", F.explode("rest").alias("word"))  # none of these words is frequent
    rest = rest.join(model.words.select("word", "n"), "word", "left") if model.words is not None else rest.withColumn("n", F.lit(None).cast("long"))
    # whole sums, so that they don't depend on the order of rows
    more = F.round(F.ln(F.coalesce("n", F.lit(UNSEEN))) * 2**32).cast("long")
    sums = rest.groupBy("row").agg((F.sum(more) / 2**32).alias("more"))
    total = F.col("own") + F.coalesce("more", F.lit(0.0))
    return part.join(sums, "row", "left").select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob for every row of docs (doc_id, text; more columns are ignored).

    Null, empty or blank text: no tokens, log_prob 0, mean null. Every row is kept, repeated ones too; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    return scored(units(docs, model), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, tokens = counted(docs)
    made = materialise(units(docs, model), "units")
    train(model, made, tokens)
    return scored(made, model)
