"""The ten operators against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from popspark.llm import bpe, minhash, mixing, pii, quality, scoring, secrets, sharding, simhash, topk

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
AWKWARD = [
    (1, "a b c d e f g h"), (2, None), (3, ""), (4, " \t\n"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "other text under the same id"),
    (None, "a b c d e f g h"), (None, None), (6, LONG), (7, LONG + "x"), (8, "é 日本 🙂 \u0085 mail@x.example.com 4111 1111 1111 1111 or +1 (555) 123-4567 or 10.0.0.256 or 1.2.3.4"),
    (9, "x" * 50_000), (10, "7" * 20_000), (11, "@" * 500 + "a@b" * 500),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, repeated rows and ids, long texts, and columns with the operators' own names."""
    base = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    names = ["source", "lang", "n_chars", "size", "shard", "run", "v", "label", "bucket", "keys", "score", "quality", "target", "copies", "fingerprint", "u", "ids"]
    return base.select("*", *[(F.lit("s") if n in ("source", "lang") else F.lit(1).cast("long")).alias(n) for n in names]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()), StructField("lang", StringType()), StructField("n_chars", LongType())]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- sharding


def test_sharding_law_slots_and_sizes(docs):
    out = sharding.shard(docs, sharding.Tree.balanced(24)).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert (out["size"] == out.text.map(lambda t: len(t.encode()) + 8)).all()
    assert (out.text_crc32 == out.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert set(out["shard"]) <= set(range(24)) and (out.law == "key").all()
    for _, group in out.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    moved = out[out["shard"] != out.grown_shard]
    assert len(moved) and (moved.grown_shard == 24).all()


def test_sharding_follows_weights_and_confines_movement(spark):
    S = sharding.Shard
    tree = sharding.Tree((((S(0), S(1)), (S(2),)), ((S(3, 3.0),),)))
    heavy = sharding.Tree((((S(0), S(1)), (S(2, 4.0),)), ((S(3, 3.0),),)))
    out = spark.range(20_000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavy).alias("b")).toPandas()
    share = out.a.value_counts(normalize=True)
    assert all(abs(share[i] - w / 6) < 0.02 for i, w in enumerate((1, 1, 1, 3)))
    moved = out[out.a != out.b]
    assert not ((moved.a == 2)).any()  # nothing leaves the subtree that gained
    assert not (moved.b == 3).any()  # nor enters one that didn't


# -- SimHash


def test_simhash_against_brute_force(docs):
    out = {r["doc_id"]: r for r in simhash.compare(docs, run_rows=37).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(out) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = out[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (simhash.fingerprint(t) for t in (text, new, following))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:032x}", f"{b:032x}")
        assert r["near_edited"] == simhash.likeness(a, b) and r["near_next"] == simhash.likeness(a, c)
    assert np.mean([r["near_edited"] for r in out.values()]) > np.mean([r["near_next"] for r in out.values()]) + 0.3


def test_block_tables_find_all(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(128) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 5))) for p in prints]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    names = sorted({f"{p:032x}" for p in prints})
    for radius in (0, 3, 5):
        got = collections.Counter(tuple(r) for r in simhash.search(df, df, radius).collect())
        near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert got == collections.Counter((a, b, near(a, b)) for a in names for b in names if a != b and near(a, b) <= radius)
    assert len({r["fingerprint"] for r in simhash.search(df, df.limit(5), 5).collect()}) <= 5
    assert simhash.search(df.limit(0), df).count() == 0 and simhash.search(df, df.limit(0)).count() == 0


def test_near_counts_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(40)]
    rows = [(i, base[i % 40] ^ sum(1 << b for b in rng.sample(range(128), rng.choice((0, 0, 1, 2, 4))))) for i in range(600)] + [(None, base[0]), (100, base[1])]
    df = spark.createDataFrame([(i, f"{p:032x}", 1) for i, p in rows], "doc_id long, fingerprint string, n long")
    want = collections.Counter((i, None if i is None or i % 100 else sum((p ^ q).bit_count() <= 3 for _, q in rows) - 1) for i, p in rows)
    for most in (simhash.BROADCAST_ROWS, 0):  # broadcast, and by shuffle
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        got = simhash.with_near(df)
        assert got.columns == ["doc_id", "fingerprint", "n", "n_near"]
        assert collections.Counter((r["doc_id"], r["n_near"]) for r in got.collect()) == want


def test_near_copies_are_found_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    prints = [rng.getrandbits(128) for _ in range(50)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), k)) for p in prints[:40] for k in (1, 9, 15, 16, 17, 18)]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    asked = df.where("substring(fingerprint, 1, 1) < '8'")
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    names, wanted = sorted({f"{p:032x}" for p in prints}), {r["fingerprint"] for r in asked.collect()}
    for radius, most in ((16, simhash.BROADCAST_ROWS), (16, 0), (11, 0), (17, 0)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        want = collections.Counter((a, b, near(a, b)) for a in names if a in wanted for b in names if a != b and near(a, b) <= radius)
        assert collections.Counter(tuple(r) for r in simhash.search(df, asked, radius).collect()) == want and len(want) > 100


# -- quality


def test_quality_learns_and_keeps_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, steps=150)
    out = quality.score(docs, model).join(labels, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"))).toPandas()
    held = out[out.held]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :]) > 0.9
    assert (good >= quality.THRESHOLD).mean() > 0.95
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).count()


def test_quality_network_blocks_agree():
    net, rng = quality.Network(), random.Random(1)
    for n in (0, 1, 127, 128, 129, 2047, 2048, 2049, 2053, 5000):
        text = bytes(rng.randrange(256) for _ in range(n))
        whole = net.responses(net.padded(np.frombuffer(text, np.uint8))).reshape(-1, quality.HALF, quality.FILTERS).max(1)
        h = np.maximum(whole + net.p["bias"], 0)
        chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        assert np.allclose(net.features(text), np.concatenate([chunks.mean(0), chunks.max(0)]), atol=1e-5)


def test_quality_gradient_against_differences():
    net, rng = quality.Network(), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 5, 128, 300, 1500)]
    labels, weights = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 2, 1])
    grad, _ = net.gradient(windows, labels, weights)
    for name, value in net.p.items():
        live = np.flatnonzero(grad[name])
        for i in rng.choice(live, min(12, len(live)), replace=False):
            at, h, losses = np.unravel_index(i, value.shape), 1e-6, []
            for sign in (1, -1):
                value[at] += sign * h
                losses.append(net.gradient(windows, labels, weights)[1])
                value[at] -= sign * h
            assert (losses[0] - losses[1]) / (2 * h) == pytest.approx(grad[name][at], rel=1e-3, abs=1e-8), name


def test_quality_learns_from_all_of_a_long_text(spark, monkeypatch):
    rng = random.Random(4)
    filler = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    # what marks a text stands from position 100,000 on only
    rows = [(i, filler(100_000) + ("ZQ" if i % 2 else "jk") * 60_000) for i in range(12)]
    monkeypatch.setattr(quality, "held_out", lambda c: F.lit(False))
    seen = []
    train = quality.Network.train

    def spy(self, drawn, window, labels, weights):
        seen.extend((i, start, window(i, start)) for batch in drawn for i, start in batch)
        return train(self, drawn, window, labels, weights)

    monkeypatch.setattr(quality.Network, "train", spy)
    docs = spark.createDataFrame(rows + rows[:1] + [(0, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"), steps=30)
    assert all(w == rows[i][1].encode()[start : start + quality.TRAIN_BYTES] for i, start, w in seen)
    assert min(x[1] for x in seen) < 20_000 and max(x[1] for x in seen) > 190_000
    scores = model.score([t.encode() for _, t in rows])
    assert min(scores[1::2]) > max(scores[0::2])


def test_quality_without_labels_is_constant(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert isinstance(quality.fit(docs, empty), quality.Constant)


# -- mixing


def test_quotas_stop_at_three_times():
    assert mixing.quotas([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.quotas([1, 100], [100, 1]) == pytest.approx([3, 98])
    assert mixing.quotas([], []) == []


def test_flow_meets_overlapping_quotas_at_least_cost():
    got = mixing.flow([(frozenset([0]), 10), (frozenset([0, 1]), 10), (frozenset([1]), 2)], [10, 12])
    assert sum(g.get(0, 0) for g in got) == 10 and sum(g.get(1, 0) for g in got) == 12
    assert all(sum(g.values()) <= s for g, s in zip(got, (10, 10, 2), strict=True))  # nothing repeats where once is enough
    assert sum(sum(g.values()) for g in mixing.flow([(frozenset([0]), 5)], [100])) == 15  # three copies at most


def test_blend_of_overlapping_sources_against_brute_force(spark):
    rows = [(1, "a b", ["x"]), (2, "c", ["x", "y"]), (3, "d e", ["y", "x", "y"]), (4, "f", ["y"]), (5, "g g g", None), (6, None, ["x"]), (7, "h", ["z", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    taken, plan = mixing.blend(docs, F.col("sources"), weight=lambda rank: (1.0, 4.0, 1.0, 1.0)[rank])
    plan, taken = plan.collect(), taken.collect()
    given = {tuple(r["sources"]): r["words"] for r in plan}
    assert given == {("x",): 2, ("x", "y"): 3, ("y",): 1, ("z", None): 1}
    patterns = list(given)
    wanted = {r["source"]: round(r["target"]) for r in plan}

    def cost(p, total):
        return sum((k + 1) ** 2 * min(max(total - k * given[p], 0), given[p]) for k in range(3))

    best = {}  # words routed so far by source -> least cost
    best[()] = (0, 0)
    states = {tuple((x, 0) for x in sorted(wanted, key=str)): 0}
    for p in patterns:
        after = {}
        for state, paid in states.items():
            have = dict(state)
            for parts in np.ndindex(*[3 * given[p] + 1] * len(p)):
                if sum(parts) <= 3 * given[p] and all(have[x] + n <= wanted[x] for x, n in zip(p, parts, strict=True)):
                    now = tuple((x, have[x] + (parts[p.index(x)] if x in p else 0)) for x, _ in state)
                    after[now] = min(after.get(now, 10**9), paid + cost(p, sum(parts)))
        states = after
    most = max(sum(n for _, n in s) for s in states)
    least = min(paid for s, paid in states.items() if sum(n for _, n in s) == most)
    routed = collections.Counter()
    for r in plan:
        routed[tuple(r["sources"])] += r["routed"]
    assert sum(routed.values()) == most and sum(cost(p, n) for p, n in routed.items()) == least
    by = collections.Counter()
    for r in taken:
        assert 0 <= r["copies"] <= 3 and (r["sources"] is not None or r["copies"] == 0)
        by[r["sources"] and tuple(r["sources"])] += r["size"] * r["copies"]
    assert len(taken) == len(rows) and all(abs(by[p] - n) <= 1 for p, n in routed.items())


def test_mix_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice((0, 1, 2, 5, 9)))), rng.choice(["b", "a", None, "é", "Z"])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    names = ["Z", "a", "b", "é", None]
    left, weights, targets = float(sum(sizes.values())), dict(zip(names, (1, 2, 3, 1, 2), strict=True)), {}
    while len(targets) < 5:  # excess goes to the others
        total = sum(weights[x] for x in names if x not in targets)
        over = [x for x in names if x not in targets and left * weights[x] / total > 3 * sizes[x]]
        targets |= {x: 3.0 * sizes[x] for x in over} if over else {x: left * weights[x] / total for x in names if x not in targets}
        left = sum(sizes.values()) - sum(targets.values()) if over else left
    words, taken = {i: len(t.split()) for i, t, _ in rows}, collections.Counter()
    for r in got:
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], sizes[r["source"]]) and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == 400 and all(abs(taken[x] - targets[x]) <= 1 for x in names)


def test_mix_comes_near_its_targets(docs):
    a = mixing.mix(docs).toPandas()
    assert len(a) == docs.count() and (a.taken <= 3 * a["size"]).all()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert (a["size"] == a.doc_id.map(words)).all()
    by = a.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert by.target.sum() == pytest.approx(by["size"].sum())
    assert ((by.taken - by.target).abs() <= 0.015 * by.target).all()  # ten documents a source: sums are coarse
    b = mixing.mix(docs.repartition(7)).toPandas()
    assert a.sort_values("doc_id").taken.tolist() == b.sort_values("doc_id").taken.tolist()
    assert mixing.repeat(docs).count() == a.copies.sum()


# -- PII


def plain_pii(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                found.append((kind, *m.span()))
    return found


def test_pii_base_spans_on_random_texts():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "..", "-", "com", "1", "23", "255", "256", "4111111111111111", " ", "+", "(", ")", "+1 555 123 4567", "x@y.z", "é", "1.2.3.4", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_pii_terms_that_disclose(spark):
    rng, filler = random.Random(2), ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "aliqua"]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{some(20)} Zorblax {some(2)} jo@example.com {some(20)}") for i in range(12)] + [(100 + i, some(60)) for i in range(200)] + [(500, f"{some(9)} ZORBLAX {some(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    terms = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert terms == {"zorblax"}
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert "orblax" not in clean[0]["text"] and "<EMAIL>" in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert "ZORBLAX" not in clean[500]["text"] and clean[150]["text"] == dict(rows)[150]
    some_terms = spark.createDataFrame([("zorblax", 1.0), ("amet", 1.0)], "term string, share double")
    whole, sliced = ({r["doc_id"]: sorted(zip(*[iter(r["_found"])] * 4)) for r in pii.find(docs, some_terms, size=n).collect()} for n in (100, 1))
    assert whole == sliced and sum(map(len, whole.values())) > 300


def test_pii_terms_outside_spans_against_brute_force():
    rng = random.Random(12)
    parts = ["ab", "jdoe42", "a@b.cd", "1.2.3.4", "+1 555 123 4567", "4111111111111111", " ", " ", "-", "x", "é1", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        base = pii.base_spans(text)
        words = [m for m in re.finditer(r"[^\W_]{2,}", text) if not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert [m.span() for m in pii._words(text, base)] == [m.span() for m in words]
        want = [(4, *m.span()) for m in words if m[0].lower() in {"jdoe42", "ab", "é1"}]
        assert pii.term_spans(text, {"jdoe42", "ab", "é1"}, base) == want


def test_pii_contexts_reach_as_far_as_words_do(spark):
    far, gap = "far", " " * 100_000
    texts = [f"one {far}{gap}. a@b.cd{gap}staff77 x y zz", "1.2.3.4 " * 3000 + "lone word"]
    import pyarrow as pa

    rows = [r for b in pii._contexts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in b.to_pylist()]
    first = {r["term"] for r in rows if r["document"] == rows[0]["document"]}
    assert first == {None, "one", "far", "staff77", "zz"}
    assert sum(r["term"] is None for r in rows) == 3001


def test_pii_generalises():
    assert [pii.general(w) for w in ("123", "ab12", "Zed", "zed")] == ["<NUMBER>", "<CODE>", "<NAME>", "<WORD>"]
    assert pii.clean("Zed mails a@b.cd from 77", [0, 10, 16, 0, 4, 0, 3, 0, 4, 22, 24, 1]) == "<NAME> mails <EMAIL> from "


def test_pii_terms_of_rare_entities(spark):
    rng, filler = random.Random(3), ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "aliqua"]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [some(60) for _ in range(3000)]
    for i in range(40):  # two documents a person: addresses mentioned once, and one whose line is always the same
        name = "quil" + "".join(chr(97 + int(d)) for d in f"{i:02d}")
        mails = (f"x{i}@example.com", f"y{i}@example.com") if i % 2 else (f"x{i}@example.com",) * 2
        texts += [f"{some(20)} Contact Mister {name} {m} with regards yours truly always {some(20)}" for m in mails]
    texts += [f"{some(30)} copied z@example.com {some(30)}"] * 5  # copies are no evidence
    texts += [f"{some(30)} chance{chr(97 + i)} z{i}@example.org {some(30)}" for i in range(5)]  # nor is a single sighting
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["term"] for r in pii.disclosing_terms(docs, threshold=0.9).collect()} == {"quil" + "".join(chr(97 + int(d)) for d in f"{i:02d}") for i in range(40)}


# -- BPE


def test_bpe_as_the_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r["doc_id"]: r for r in bpe.encode(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(out[r["doc_id"]]["ids"], "<u4").tolist() == ids
        assert out[r["doc_id"]]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_streams_as_it_encodes_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary, rng = bpe.Vocabulary(bpe.read_vocabulary()), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "'", "ing", "é", "日本", "🙂", "1", "!!", "<|endoftext|>", "<|endof", "|", "　", "\x85", "\x1c", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [w * 4000 for w in ("a", "th", "ab", "0", "!", " ", "\n", "é", "=-")] + ["".join(rng.choice("etaoinsh") for _ in range(9000))]
    for text in texts:
        for chunk in (16, 64, 1 << 16):
            ids = bpe.Encoder(vocabulary, None, chunk).encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, (text[:60], chunk)
        assert "".join(bpe.Decoder(vocabulary).decode(ids, 4)) == text


# -- MinHash


def brute_components(rows, width, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            shared[x].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in shared[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), low[root(i)]) for i, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize("key_rows", [256, 1])
def test_minhash_against_brute_force(spark, monkeypatch, key_rows):
    reached, busy = [], minhash.busy

    def watched(counts, rows, *keys):
        often = busy(counts, rows, *keys)
        if often is not None:
            reached.append(keys)
        return often

    monkeypatch.setattr(minhash, "KEY_ROWS", key_rows)
    monkeypatch.setattr(minhash, "busy", watched)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for g in range(6):  # groups of near copies around one text, some too far from it
        base = [word() for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [copy[at], word()]])
            rows.append((10_000 + len(rows), " ".join(copy)))
    rows += [(20_000 + i, rows[-1][1]) for i in range(9)]  # exact copies
    want = brute_components(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == want
    if key_rows == 1:  # keys are dealt over several places in every join
        assert {("v",), ("key",), ("hub",), ("b",), ("hub", "n_y"), ("hub", "shingle"), ("a",)} <= set(reached)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    labels = spark.createDataFrame([(i, 1000 - i) for i in range(42)], "v long, label long")
    got = {r["v"]: r["label"] for r in minhash.components(chain, labels).collect()}
    assert got == {**{i: 960 for i in range(41)}, 41: 959}


# -- secrets


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEF0123456789XY", "0123456789abcdef", "deadbeef" * 3, "é", "🙂", "\n", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        assert [tuple(s) for s in r["base"]] == plain_secrets(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_secrets_entropy(spark):
    rng = random.Random(7)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    texts = [f"see {key} here", "a" * 40, "internationalisationsverfahren", "0123456789abcdefghijEXAMPLE", "ab12" * 10, key[:19], ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["added"]] for r in secrets.scan(df).collect()}
    assert added == {0: [(4, 44)], 1: [], 2: [], 3: [], 4: [], 5: [], 6: []}

    def entropy(s):
        return max(math.log2(20) - sum(c * math.log2(c) for c in collections.Counter(s[i : i + 20]).values()) / 20 for i in range(len(s) - 19))

    beside = [f"docs/example/{key}", f"{key}00000000{key[:5]}", f"{key[:15]}example{key[15:30]}", f"{key[:19]}EXAMPLE"]
    more = spark.createDataFrame(list(enumerate(beside)), "doc_id long, text string")
    assert [[(s["start"], s["stop"]) for s in r["added"]] for r in secrets.scan(more).orderBy("doc_id").collect()] == [[(0, 53)], [(0, 53)], [], []]
    varied = ["".join(rng.choice("ab12XY-_"[: rng.randint(1, 8)]) for _ in range(rng.randint(20, 120))) for _ in range(60)]
    runs = spark.createDataFrame([(x,) for x in [key, "ab12" * 10, key[:20], *varied]], "r string").select("r", secrets.top_entropy(F.col("r")).alias("h"))
    assert all(r["h"] == pytest.approx(entropy(r["r"])) for r in runs.collect())
    assert {r["text"] for r in secrets.redact(df.where("doc_id = 0")).collect()} == {"see <SECRET> here"}


# -- LM scoring


def test_scoring_prefers_natural_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = scoring.fit(docs)
    natural = docs.where("doc_id < 150")
    rng = random.Random(1)
    mixed = []
    for r in natural.collect():
        words = (r["text"] or "").split()
        rng.shuffle(words)
        mixed.append((r["doc_id"], " ".join(words)))
    a = {r["doc_id"]: r for r in scoring.score(natural, model).collect()}
    b = {r["doc_id"]: r for r in scoring.score(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert np.mean([a[i]["log_prob"] > b[i]["log_prob"] for i in a if a[i]["n_tokens"] > 50]) > 0.7


def small_model(seed: int = 1, shapes: int = 16):
    rng = random.Random(seed)
    top = [("".join(rng.choice("abcdefgh") for _ in range(5)).encode(), 900 - i) for i in range(400)]
    return scoring.Model(top, np.array([float(rng.randrange(50)) for _ in range(shapes * scoring.RARE)]), shapes, top), top


def test_scoring_gradient_against_differences():
    model, _ = small_model()
    rng = np.random.default_rng(1)
    truth = rng.integers(0, model.units, 300)
    near = rng.integers(0, model.units + 1, (2 * scoring.SIDES, 300))
    flat = model.flat.astype(np.float64)
    rows, embedded, rest, loss = model.gradient(flat, near, truth)
    whole = np.zeros_like(flat)
    model.parts(whole)[0][rows] = embedded
    whole[-len(rest) :] = rest
    direction = rng.normal(size=len(flat))
    h = 1e-5
    change = (model.gradient(flat + h * direction, near, truth)[3] - model.gradient(flat - h * direction, near, truth)[3]) / (2 * h)
    assert change == pytest.approx(float(whole @ direction), rel=1e-3, abs=1e-6)
    for i in rng.choice(np.flatnonzero(whole), 25):
        one = np.zeros_like(flat)
        one[i] = h
        assert (model.gradient(flat + one, near, truth)[3] - model.gradient(flat - one, near, truth)[3]) / (2 * h) == pytest.approx(whole[i], rel=1e-2, abs=1e-7)
    model.flat = flat.astype(np.float32)
    assert -model.log_probs(near, truth).mean() == pytest.approx(loss, rel=1e-4)


def test_scoring_units_hold_all_probability():
    model, _ = small_model()
    near = np.array([[5], [300], [model.pad], [17]])
    every = np.arange(model.units)
    assert np.exp(model.log_probs(np.repeat(near, model.units, 1), every)).sum() == pytest.approx(1, abs=1e-4)
    other = np.array([[5], [301], [2], [17]])
    change = model.log_probs(np.repeat(near, model.units, 1), every) - model.log_probs(np.repeat(other, model.units, 1), every)
    same_class = [model.of[every] == c for c in range(scoring.SINGLES, model.classes)]
    assert all(np.ptp(change[x]) > 1e-4 for x in same_class if x.sum() > 1)  # the context moves units within a class too


def test_scoring_texts_of_a_batch_do_not_meet():
    model, _ = small_model()
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, model.units, n) for n in (0, 1, 2, 40_000, 0, 30, 8192, 5)]
    assert model.score(texts) == pytest.approx([model.score([t])[0] for t in texts])
    assert model.score([]).tolist() == []


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(7)
    names = [f"{a}{b}" for a in ("lor", "ips", "dol", "ame", "sit", "eli") for b in ("em", "um", "or", "it", "at")]
    texts = [" ".join(rng.choices(names + [f"only{rng.randrange(3000)}"], range(len(names) + 1, 0, -1), k=rng.randrange(80))) for _ in range(300)]
    return texts + ["Lorem, ipsum", "", None, " \t\n", texts[0], texts[0]]


def test_scoring_does_not_depend_on_partitioning(spark, words):
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    made = []
    for n in (1, 8, 211):
        model = scoring.fit(docs.repartition(n), group_tokens=1500, parts=2)
        made.append((model.flat.tobytes(), [r["log_prob"] for r in scoring.score(docs.repartition(n), model).orderBy("doc_id").collect()]))
    assert len({m for m, _ in made}) == 1
    assert made[0][1] == pytest.approx(made[1][1], rel=1e-6) and made[0][1] == pytest.approx(made[2][1], rel=1e-6)


def test_scoring_every_position_teaches(spark):
    pairs = [f"left{i} right{i}" for i in range(60)]  # a word's embedding moves only where the other one teaches
    docs = spark.createDataFrame(list(enumerate([*pairs, " ".join(f"long{i}" for i in range(40))])), "doc_id long, text string")
    before, after = scoring.fit(docs, rounds=0), scoring.fit(docs)
    at = [before.unit(w) for t in pairs for w in scoring.split(t)]
    assert len(set(at)) == len(at)
    moved = before.parts(before.flat)[0][at] != after.parts(after.flat)[0][at]
    assert moved.any(1).all()


def test_scoring_rounds_share_out_all_positions():
    whole, _ = small_model()
    rng = np.random.default_rng(5)
    texts = [(0, rng.integers(0, 40, 70_001), 1), (0, rng.integers(0, 40, 3), 2), (0, np.array([7]), 1), (3, rng.integers(0, 40, 501), 200), (3, np.array([2, 9]), 1)]
    taught = collections.Counter()

    class Recorded(scoring.Model):
        def step(self, flat, past, near, truth):
            assert len(truth) <= scoring.BATCH
            taught.update(zip(*near.tolist(), truth.tolist(), strict=True))
            return 0.0

    model = Recorded.__new__(Recorded)
    model.__dict__ = whole.__dict__
    held = type("Held", (), {"value": model})
    batches = [pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([t.astype(model.kind).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["grp", "units", "times"]) for g, t, n in texts]
    weight = 0.0
    for turn in range(scoring.ROUNDS):
        learned = [r for b in scoring._train(held, turn, scoring.ROUNDS)(iter(batches)) for r in b.to_pylist()]
        assert [r["grp"] for r in learned] == [0, 3]
        weight += sum(r["weight"] for r in learned)
    want = collections.Counter()
    for _, t, n in texts:
        line, at = model.padded([t])
        for key in zip(*model.neighbours(line, at).tolist(), line[at].tolist(), strict=True):
            want[key] += n
    assert taught == want and weight == sum(want.values())


def test_scoring_repeated_rows_teach_as_often(spark, words):
    rows = [*enumerate(words), *[(5, "one two three four five six seven")] * 300]
    tokens, made = sum(len((t or "").split()) for _, t in rows), []
    for n in (1, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        model, counted = scoring.counted(docs)
        assert counted == tokens
        assert scoring.train(model, scoring.units(docs, model), tokens, group_tokens=1500) == tokens
        made.append(model.flat.tobytes())
    assert made[0] == made[1]
    groups = tokens // 1500
    dealt = scoring._dealt(scoring.units(docs, model), groups).where("doc_id = 5 and times > 1").toPandas()
    assert len(dealt) == groups > 2 and dealt.times.sum() == 300 and np.ptp(dealt.times) <= 1


def test_scoring_round_without_positions(spark):
    docs = spark.createDataFrame([(1, "lonely")], "doc_id long, text string")
    before, after = scoring.fit(docs, rounds=0), scoring.fit(docs)
    assert (before.parts(before.flat)[0][5:9] == after.parts(after.flat)[0][5:9]).all()  # not averaged away by no weight


def test_scoring_against_brute_force(spark, words, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    n = collections.Counter(w.encode() for t in words for w in (t or "").lower().split())
    by_count = sorted(n, key=lambda w: (-n[w], w))
    for head, frequent in ((scoring.HEAD, scoring.FREQUENT), (3, 1)):  # counts from the workers' own, and by the join; few units
        monkeypatch.setattr(scoring, "HEAD", head)
        monkeypatch.setattr(scoring, "FREQUENT", frequent)
        model = scoring.fit(docs, rounds=1, group_tokens=3000)
        shapes = scoring.shapes_for(len(n))
        assert model.shapes == shapes and {bytes(r["word"]): r["n"] for r in model.words.collect()} == n
        own = by_count[: scoring.SINGLES + frequent * shapes]
        mass = collections.Counter()
        for w, k in n.items():
            mass[w if w in own else (zlib.crc32(w[-2:]) % shapes, zlib.crc32(w) % scoring.RARE)] += k
        e, place, of_class, class_bias, of_unit, unit_bias = (x.astype(np.float64) for x in model.parts(model.flat))

        def log_softmax(x):
            return x - x.max() - np.log(np.exp(x - x.max()).sum())

        got = {r["doc_id"]: r["log_prob"] for r in scoring.score(docs, model).collect()}
        for i, text in enumerate(words):
            found = [w.encode() for w in (text or "").lower().split()]
            at, want = [model.pad] * 2 + [model.unit(w) for w in found] + [model.pad] * 2, 0.0
            for j, w in enumerate(found):
                u = at[j + 2]
                hidden = np.tanh(sum(e[at[j + k]] * place[m] for m, k in enumerate((0, 1, 3, 4))))
                c = u if u < scoring.SINGLES else scoring.SINGLES + zlib.crc32(w[-2:]) % shapes
                want += log_softmax(of_class @ hidden + class_bias)[c]
                if c >= scoring.SINGLES:
                    a, b = model.edges[c - scoring.SINGLES], model.edges[c - scoring.SINGLES + 1]
                    want += log_softmax(of_unit[a:b] @ hidden + unit_bias[a:b])[u - a]
                key = w if w in own else (zlib.crc32(w[-2:]) % shapes, zlib.crc32(w) % scoring.RARE)
                want += math.log(n[w] / (mass[key] + scoring.UNSEEN))
            assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3), (i, text)
        unseen = scoring.score(spark.createDataFrame([(1, "lorem never-seen")], "doc_id long, text string"), model)
        assert unseen.where("log_prob is null or log_prob >= 0").count() == 0


# -- top-k


def plain_top(rows, k=5):
    """Of (id, vector) rows: query id, rank, id, score, as often as rows are alike."""
    whole = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    want = []
    for a, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-int(v @ c), i) for b, (i, c) in enumerate(whole) if a != b and len(c) == len(v))[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(want)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = ((centres[rng.integers(0, 12, 700)] + 0.1 * rng.normal(size=(700, 16))) / 3).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(330)]  # ties, and a third of all in one place
    rows += [(850, [0.5, 0.5]), (50, [9.0] * 16), (50, [9.0] * 16), rows[100], *[rows[150]] * 7, *[rows[151]] * 9, (1100, [1.0, 2.0, 3.0]), (1150, [])]
    unusable = [(1200, None), (1201, [1.0, float("nan")]), (1202, [1.0, None]), (None, [0.0] * 16), (1250, [float("inf")] * 16)]
    vectors = topk.usable(spark.createDataFrame(rows + unusable, "vec_id long, embedding array<float>")).cache()
    asked = vectors.where(F.col("vec_id") % 50 == 0)
    for group in (100, 5000):
        got = topk.top_k(vectors, asked, len(rows), group=group)
        assert sorted(tuple(r) for r in got.collect()) == plain_top(rows), group
    vectors.unpersist()


def test_topk_visits_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = 200 * rng.normal(size=(20, 8))
    x = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8))).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), 8, 1) for i, v in enumerate(x)], "vec_id long, v array<long>, dim int, n long")
    pivots = topk._pivots(rows, 20)
    cells = {r["cell"]: (r["far"], r["most"]) for r in rows.mapInArrow(topk._cells(pivots), "vec_id long, v array<long>, dim int, n long, cell int, far double, most double").groupBy("cell").agg(F.max("far").alias("far"), F.max("most").alias("most")).collect()}
    floor = sorted(x @ x[0])[-6]
    asked = rows.where("vec_id = 0").withColumn("floor", F.lit(int(floor)).cast("long"))
    to = asked.mapInArrow(topk._routes(pivots, cells), "vec_id long, v array<long>, dim int, n long, floor long, to array<int>").first()["to"]
    assert 0 < len(to) < len(cells) / 2


def test_mtree_skips_what_bounds_exclude():
    rng = np.random.default_rng(3)
    centres = 200 * rng.normal(size=(40, 8))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))).astype(np.int64)
    tree = topk.MTree(x, np.arange(4000))
    tree.compared = 0
    assert [s for s, _ in tree.search(x[0], 0, 5)] == sorted((x @ x[0])[1:], reverse=True)[:5]
    assert tree.compared < 2000


# -- awkward tables


def run_all(docs, labels):
    tree = sharding.Tree.balanced(24)
    return {
        "sharding": sharding.shard(docs, tree),
        "simhash": simhash.with_near(simhash.compare(docs, run_rows=4)),
        "quality": quality.score(docs, quality.fit(docs, labels)),
        "mixing": mixing.mix(docs),
        "pii": pii.find(docs.select("doc_id", "text"), finish=pii._digest, schema="doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"),
        "bpe": bpe.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256")),
        "minhash": minhash.near_duplicates(docs, width=4),
        "secrets": secrets.scan(docs),
        "scoring": scoring.score(docs, scoring.fit(docs, rounds=1)),
    }


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None, "z"), (None, 0, 1, "z"), (3, None, 0, "z"), (4, 7, 0, "z")], "doc_id long, quality int, toxic int, text string")


def test_awkward_rows_are_all_there(awkward, labels):
    want = collections.Counter(r["doc_id"] for r in awkward.collect())
    out = {name: df.collect() for name, df in run_all(awkward, labels).items()}
    for name, rows in out.items():
        assert collections.Counter(r["doc_id"] for r in rows) == want, name
    near = {(r["doc_id"], r["n_shingles"]): r for r in out["minhash"]}
    assert near[(5, 5)]["component_id"] == 1 and not near[(5, 5)]["kept"]
    assert near[(2, 0)]["component_id"] == 2 and near[(3, 0)]["kept"] and near[(4, 0)]["kept"]
    assert near[(None, 5)]["component_id"] is None and near[(None, 5)]["kept"]
    assert {r["size"] for r in out["sharding"] if r["doc_id"] in (2, 3)} == {8}
    assert {(r["doc_id"], r["n_tokens"], r["log_prob"], r["mean_log_prob"]) for r in out["scoring"] if r["doc_id"] in (2, 3, 4)} == {(i, 0, 0.0, None) for i in (2, 3, 4)}
    spans = next(r["spans"] for r in out["pii"] if r["doc_id"] == 8)
    assert [s.split(":")[0] for s in spans.split(",")] == ["email", "ip", "card", "phone"]


def test_stages_on_awkward_rows_and_clashing_names(awkward, labels, spark):
    names = ["_id", "_copies", "_source", "_copy", "_found", "_near", "id", "h", "c0", "c1", "copies", "kept", "pattern", "salt", "sources", "n_near", "i", "start", "grp", "row", "words"]
    have = awkward.columns
    docs = awkward.select("*", *[F.lit(2).cast("long").alias(n) for n in names if n not in have])
    assert collections.Counter(r["doc_id"] for r in quality.keep(docs, quality.Constant(0.9)).collect()) == collections.Counter(r["doc_id"] for r in docs.collect())
    assert quality.keep(docs, quality.Constant(0.1)).count() == 0
    once = minhash.deduplicate(docs)
    assert once.columns == docs.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in once.collect())
    # id 5 stays for its own text, and with it, once, the copy that shares the id
    assert {i for i, _ in kept} == {1, 2, 3, 4, 5, None, 6, 7, 8, 9, 10, 11} and all(n == 1 for n in kept.values())
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r["text"] for r in clean.where("doc_id in (2, 3)").collect()} == {None, ""}
    more = mixing.repeat(docs)
    assert more.columns == docs.columns
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = collections.Counter(r["doc_id"] for r in more.collect())
    assert set(got) == {i for i, n in want.items() if n} and all(got[i] >= n for i, n in want.items())
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count() and masked.where("text is null").count() == 2
    prints = simhash.compare(docs.select("doc_id", "text"), run_rows=4).withColumn("_near", F.lit(1)).withColumn("n_near", F.lit(2)).withColumn("fingerprints", F.lit(3))
    near = simhash.with_near(prints, every=1)
    assert near.columns == [*[c for c in prints.columns if c != "n_near"], "n_near"] and near.count() == docs.count()
    placed = sharding.shard(docs, sharding.Tree.balanced(3))
    assert placed.count() == docs.count()
    assert scoring.score(docs.drop("score"), scoring.fit(docs, rounds=1)).count() == docs.count()


def test_empty_tables(none, labels, spark):
    for name, df in run_all(none, labels.limit(0)).items():
        assert df.count() == 0, name
    empty = topk.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty, 0).count() == 0
    assert minhash.deduplicate(none).count() == 0 and mixing.repeat(none).count() == 0 and pii.sanitise(none).count() == 0
