"""PII by information-theoretic sanitisation.

Base patterns find the protected entities. What else gives an entity away is estimated from the corpus: with W words,
c(e) mentions of entity e, c(t) occurrences of term t and c(e, t) mentions of e with t within NEAR words, t discloses
the share PMI(e; t) / IC(e) = log(c(e, t) W / (c(e) c(t))) / log(W / c(e)) of what there is to know about e. Terms that
reach a threshold, and stand near entities more often than chance would have it, are personal data too, wherever they
stand: from GENERALISE on they are generalised to what kind of word they are (number, code, name, word), from REMOVE on
removed. Terms are whole words of letters and digits.

Evidence is by term, over all entities, so that an entity mentioned once has its terms too. Of the c(t) occurrences of a
term, k distinct documents have it near some entity; a word is near one by chance with the share p of words that are. The
chance of k or more, given one (that is how t became a candidate, and proves nothing), is bounded by Chernoff's bound
exp(-c KL(k/c, p)) / (1 - (1 - p)^c). Terms pass by Benjamini and Hochberg's rule: of those that do, a share of at most
FALSE is expected to be there by chance. Copies share their document, near copies mostly (least hashes of
their passages).

Counting: contexts of entities are few and are summed by (entity, term); candidates are then counted over all words.
Candidate terms go to the workers in slices of at most SLICE terms, one pass of the texts a slice.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

KINDS = ("email", "ip", "card", "phone", "term")
PLACEHOLDER = tuple(f"<{k.upper()}>" for k in KINDS[:4])
NEAR, FALSE, GENERALISE, REMOVE, SLICE = 5, 0.05, 0.95, 0.995, 200_000
#: Words of a passage that tells documents apart; steps of the log chance in a power of e, and the most of them.
PASSAGE, STEPS, MOST_STEPS = 5, 10, 2000

# The same matches as the plain patterns, without their quadratic scans: a run of digits is entered at its start only,
# and an address is found from its @.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]{2,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1) if at > done and text[at - 1] in LOCAL else None
        if m:
            start = at - 1
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by kind, then start; code points, stop exclusive."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def _merged(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, as disjoint stretches in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _words(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words of the text that no base span touches."""
    held, i = _merged(base), 0
    for m in TERM.finditer(text):
        while i < len(held) and held[i][1] <= m.start():
            i += 1
        if i == len(held) or held[i][0] >= m.end():
            yield m


def term_spans(text: str, terms, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not terms or terms.isdisjoint(x.lower() for x in TERM.findall(text)):
        return []
    return [(4, *m.span()) for m in _words(text, base) if m[0].lower() in terms]


def general(word: str) -> str:
    """What a disclosing term is generalised to."""
    if word.isdigit():
        return "<NUMBER>"
    return "<CODE>" if any(c.isdigit() for c in word) else "<NAME>" if word[0].isupper() else "<WORD>"


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def _document(text: str) -> int:
    """The two least hashes of the text's passages: equal for copies, and for near copies with about their likeness squared as
    chance; one hash would too often be of a line that unlike documents share."""
    words = [crc32(w) for w in text.encode().lower().split()]
    return hash(tuple(nsmallest(2, {hash(tuple(words[i : i + PASSAGE])) for i in range(max(1, len(words) - PASSAGE + 1))})))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, term, document for the terms near each base span; term null once a mention."""
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(0):
            text = text.as_py() or ""
            base = base_spans(text)
            document = _document(text) if base else 0
            words = list(_words(text, base)) if base else []
            starts, stops = [m.start() for m in words], [m.end() for m in words]
            for kind, a, b in base:
                entity = _hash(f"{kind}:{text[a:b].lower()}")
                left, right = bisect_right(stops, a), bisect_left(starts, b)  # words before and from there on, however far
                near = {m[0].lower() for m in (*words[max(0, left - NEAR) : left], *words[right : right + NEAR])}
                rows.append((entity, None, document))
                rows += [(entity, t, document) for t in near]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["entity", "term", "document"])


def _count(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of the terms; null: of any."""
        total, counts = 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                if found := TERM.findall((text.as_py() or "").lower()):
                    total += len(found)
                    counts.update(filter(terms.value.__contains__, found))
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.string()), pa.array([total, *counts.values()], pa.int64())], ["term", "n"])

    return run


def _slices(terms: DataFrame, size: int) -> Iterator[list]:
    """The rows of terms in hash slices of about size each."""
    n = terms.count()
    slices = -(-n // size)
    for i in range(slices):
        yield terms.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == i).collect()


def _evident(counted: DataFrame, tested: int, p: float, false: float) -> DataFrame:
    """The terms of counted (term, c_t, k) that aren't there by chance; tested: all candidates, those left out have k = 1."""
    c, k = F.col("c_t").cast("double"), F.least(F.col("k"), F.col("c_t")).cast("double")
    q, p = k / c, min(max(p, 1e-12), 0.5)
    rest = F.when(q < 1, (c - k) * F.ln((1 - q) / (1 - p))).otherwise(0.0)
    chance = F.when(q > p, -(k * F.ln(q / p) + rest) - F.ln(-F.expm1(c * F.log1p(F.lit(-p))))).otherwise(0.0)
    step = F.least(F.floor(F.greatest(-chance, F.lit(0.0)) * STEPS), F.lit(MOST_STEPS)).cast("int")
    steps = counted.withColumn("step", step)
    rank, least = 0, None
    for r in steps.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most MOST_STEPS
        rank += r["count"]
        if math.exp(-r["step"] / STEPS) * tested <= false * rank:
            least = r["step"]
    return steps.where(F.lit(False) if least is None else F.col("step") >= least).select("term", "c_t")


def disclosing_terms(docs: DataFrame, false: float = FALSE, threshold: float = GENERALISE, size: int = SLICE) -> DataFrame:
    """term, share: terms that disclose at least the threshold of some entity (docs: text; more columns are ignored).

    Null and empty texts have no words. An empty table, and one without entities, gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("text").where("text is not null")
    seen = materialise(texts.mapInArrow(_contexts, "entity long, term string, document long"), "contexts")
    mentions = seen.where("term is null").groupBy("entity").agg(F.count("*").alias("c_e"))
    near = seen.where("term is not null")
    support = materialise(near.groupBy("term", "document").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("k"), F.sum("n").alias("n")), "support")
    size_of = support.agg(F.count("*").alias("tested"), F.sum("n").alias("near")).collect()[0]
    candidates = support.where("k > 1").select("term")  # one document proves nothing
    counted = None
    for rows in _slices(candidates, size):
        held = spark.sparkContext.broadcast(frozenset(r["term"] for r in rows))  # about SLICE terms
        part = materialise(texts.mapInArrow(_count(held), "term string, n long").groupBy("term").agg(F.sum("n").alias("c_t")), "counts")
        counted = part if counted is None else counted.unionByName(part.where("term is not null"))
    if counted is None:
        return spark.createDataFrame([], "term string, share double")
    total = counted.where("term is null").collect()[0]["c_t"]
    evident = _evident(counted.where("term is not null").join(support.select("term", "k"), "term"), size_of["tested"], size_of["near"] / total, false)
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("c_et"))
    known = pairs.join(evident, "term").join(mentions, "entity")
    share = F.ln(F.col("c_et") * F.lit(float(total)) / (F.col("c_e") * F.col("c_t"))) / F.greatest(F.ln(F.lit(float(total)) / F.col("c_e")), F.lit(1e-9))
    return materialise(known.select("term", share.alias("share")).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= threshold), "terms")


def find(docs: DataFrame, terms: DataFrame | None = None, size: int = SLICE, remove: float = REMOVE, finish=None, schema=None) -> DataFrame:
    """docs with _found: flat (kind, start, stop, removed) of all spans, base ones first by kind and start, then terms by start.

    Every row and column of docs stays; null text counts as empty. terms: as of disclosing_terms(docs), the default.
    finish(batch of docs, spans) makes batches of another schema instead, in the same pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    terms = disclosing_terms(docs) if terms is None else terms
    at, columns = docs.columns.index("text"), docs.columns

    def scan(held, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shares = held.value
            names = shares.keys()
            for batch in batches:
                out = []
                before = [None] * batch.num_rows if first else batch.column(len(columns)).to_pylist()
                for text, known in zip(batch.column(at), before, strict=True):
                    text = text.as_py() or ""
                    base = base_spans(text) if first or names else []
                    flat = [x for s in base for x in (*s, 0)] if first else known
                    if names and (more := term_spans(text, names, base)):
                        flat = flat + [x for s in more for x in (*s, int(shares[text[s[1] : s[2]].lower()] >= remove))]
                    out.append(flat)
                own = pa.RecordBatch.from_arrays(batch.columns[: len(columns)], columns)
                yield finish(own, out) if finish and last else pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.list_(pa.int64()))], [*columns, "_found"])

        return run

    out = docs
    n = -(-terms.count() // size)
    for i, rows in enumerate(_slices(terms, size) if n else [[]]):
        held, last = spark.sparkContext.broadcast({r["term"]: r["share"] for r in rows}), i == max(0, n - 1)  # about SLICE terms
        out = out.mapInArrow(scan(held, i == 0, last), schema if finish and last else _with_found(docs))
    return out


def _with_found(docs: DataFrame):
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    return StructType([*(StructField(f.name, f.dataType) for f in docs.schema.fields), StructField("_found", ArrayType(LongType()))])


def _ordered(flat: list[int]) -> list[tuple[int, ...]]:
    return sorted(zip(flat[0::4], flat[1::4], flat[2::4], flat[3::4], strict=True))


def _digest(batch: pa.RecordBatch, found: list[list[int]]) -> pa.RecordBatch:
    counts: list[list[int]] = [[], [], [], []]
    digests, joined = [], []
    for flat in found:
        spans = _ordered(flat)
        names = [f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans]
        own = [s[0] for s in spans]
        for k in range(4):
            counts[k].append(own.count(k))
        digests.append(hashlib.sha256(",".join(n for n, k in zip(names, own, strict=True) if k < 4).encode()).hexdigest())
        joined.append(",".join(names))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def clean(text: str, flat: list[int]) -> str:
    """Spans give way to placeholders, removed ones to nothing; spans that overlap become one."""
    out, done = [], 0
    for a, b, kind, gone in sorted((a, b, k, g) for k, a, b, g in _ordered(flat)):
        if a >= done:
            out += [text[done:a], "" if gone else PLACEHOLDER[kind] if kind < 4 else general(text[a:b])]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """docs with what find() finds generalised or removed from text; n_chars, if there, is the new length.

    All rows and columns stay, repeated ones too, whatever their names; null text stays null. An empty table gives an empty result.
    """
    at, columns = docs.columns.index("text"), docs.columns

    def finish(batch: pa.RecordBatch, found: list[list[int]]) -> pa.RecordBatch:
        texts = [t if not f or t is None else clean(t, f) for t, f in zip(batch.column(at).to_pylist(), found, strict=True)]
        made = list(batch.columns)
        made[at] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            n = columns.index("n_chars")
            made[n] = pa.array([old if t is None else len(t) for t, old in zip(texts, made[n].to_pylist(), strict=True)], made[n].type)
        return pa.RecordBatch.from_arrays(made, columns)

    return find(docs, terms, finish=finish, schema=docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return find(docs, finish=_digest, schema="doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
