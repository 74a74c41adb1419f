"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoder: text arrives in chunks. Special tokens are cut out first; the pre-tokeniser then emits a piece once the
characters behind it can no longer change it; a piece becomes ids by the merge list. A piece that outgrows a chunk is
passed on unfinished: its bytes go through a window, and a token is emitted as soon as `lookahead` bytes stand behind
it. The lookahead is computed from the merge list: whether a merge applies can depend on what its right part merges with
earlier (of lower rank), so need(u v) = |v| + the largest need of an earlier merge whose left part lies on the right
spine of v; the maximum over the list bounds how far a byte can reach to the left. What follows an emitted token is
encoded as if it stood alone, since no merge crosses a token's end. State is bounded by the chunk, the window and a
cache of fixed size.

Decoder: ids become bytes, bytes become text by an incremental UTF-8 decoder; malformed bytes become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: The public pre-tokenisation rule of this kind of vocabulary.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
PIECES = regex.compile(CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: How an unfinished piece goes on, by the class of its last character.
RUNS = tuple(regex.compile(p) for p in (r"\p{L}+|", r"\p{N}+|", r"[^\s\p{L}\p{N}]+|", r"\s+(?!\S)|"))
CLASS = tuple(regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s"))
#: Characters of a chunk; characters behind a piece that settle it; pieces a cache holds, and their longest length.
CHUNK, SETTLED, CACHED, SHORT = 1 << 16, 3, 150_000, 64


def byte_symbols() -> list[str]:
    """The symbol that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    symbols, spare = [], 256
    for b in range(256):
        symbols.append(chr(b if b in plain else spare))
        spare += b not in plain
    return symbols


class Vocabulary:
    """A byte-level BPE file: ids, merges, special tokens."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model, kind = data["model"], (data.get("pre_tokenizer") or {})
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or data.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser or prefix space")
        symbols = byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        ids = model["vocab"]
        self.bytes = {i: bytes(value[c] for c in s) for s, i in ids.items()}
        self.of_byte = [ids[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {}
        for t in data.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"special token with options: {t}")
            self.special[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        parts: dict[int, tuple[int, int]] = {}
        most: dict[int, int] = {}  # left part -> largest need of a merge so far
        need_max = 1
        for (a, b), (_, made) in self.merges.items():
            need, at = len(self.bytes[b]), b
            behind = most.get(at, 0)
            while at in parts:
                at = parts[at][1]
                behind = max(behind, most.get(at, 0))
            need += behind
            most[a] = max(most.get(a, 0), need)
            parts.setdefault(made, (a, b))
            need_max = max(need_max, need)
        return need_max + max(map(len, self.bytes.values()))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: merges by rank, then from the left."""
        ids, merges = [self.of_byte[b] for b in piece], self.merges
        if len(ids) > 24:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (m[0], x, ids[x], ids[y], m[1]))
        return [i for i in ids if i >= 0]


def packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


class _Cache(dict):
    """Piece -> packed ids. When half full it becomes the older half, from which pieces in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > SHORT:
            return b"".join(Window(self.vocabulary).feed(piece.encode(), True))
        if len(self) >= CACHED // 2:
            self.older = dict(self)
            self.clear()
        made = self.older.get(piece)
        if made is None:
            made = packed(self.vocabulary.merge(piece.encode()))
        self[piece] = made
        return made


class Window:
    """Ids of one piece whose bytes arrive bit by bit."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.rest, self.size = vocabulary, b"", 4 * vocabulary.lookahead

    def feed(self, data: bytes, last: bool) -> Iterator[bytes]:
        rest, at = self.rest + data, 0
        while len(rest) - at > self.size:
            ids, end, stable = self.vocabulary.merge(rest[at : at + self.size]), 0, []
            for i in ids:
                end += len(self.vocabulary.bytes[i])
                if end > self.size - self.vocabulary.lookahead:
                    break
                stable.append(i)
                at += len(self.vocabulary.bytes[i])
            yield packed(stable)
        self.rest = rest[at:]
        if last:
            yield packed(self.vocabulary.merge(self.rest))
            self.rest = b""


class Encoder:
    """feed() chunks of text, then finish(); each gives packed little-endian 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary, cache: _Cache | None = None, chunk: int = CHUNK):
        self.vocabulary, self.cache, self.chunk = vocabulary, _Cache(vocabulary) if cache is None else cache, max(16, chunk)
        self.held, self.tail = "", ""  # what may begin a special token; what isn't settled
        self.open: tuple[Window, int] | None = None  # an unfinished piece and its class
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.longest = max(map(len, names), default=1)

    def _pieces(self, text: str, last: bool) -> Iterator[bytes]:
        data = self.tail + text
        if self.open:
            window, kind = self.open
            run = RUNS[kind].match(data).end()
            if not last and run > len(data) - SETTLED:  # still open
                cut = max(0, run - 2 * SETTLED)
                yield from window.feed(data[:cut].encode(), False)
                self.tail = data[cut:]
                return
            yield from window.feed(data[:run].encode(), True)
            data, self.open = data[run:], None
        found = PIECES.findall(data)
        if last:
            self.tail = ""
        else:
            keep = 0
            while found and keep < SETTLED:
                keep += len(found.pop())
            self.tail = data[len(data) - keep :]
        yield from map(self.cache.__getitem__, found)
        if len(self.tail) > self.chunk:  # one piece, and it goes on
            first = PIECES.match(self.tail)
            if first.end() > len(self.tail) - SETTLED:
                cut = first.end() - 2 * SETTLED
                kind = next(k for k, c in enumerate(CLASS) if c.match(self.tail[cut]))
                self.open = (Window(self.vocabulary), kind)
                yield from self.open[0].feed(self.tail[:cut].encode(), False)
                self.tail = self.tail[cut:]

    def feed(self, text: str) -> bytes:
        out: list[bytes] = []
        data, self.held = self.held + text, ""
        if self.special:
            at = 0
            for m in self.special.finditer(data):
                out += self._pieces(data[at : m.start()], True)
                out.append(packed([self.vocabulary.special[m[0]]]))
                at = m.end()
            data = data[at:]
            for k in range(min(len(data), self.longest - 1), 0, -1):
                if any(s.startswith(data[-k:]) for s in self.vocabulary.special):
                    data, self.held = data[:-k], data[-k:]
                    break
        out += self._pieces(data, False)
        return b"".join(out)

    def finish(self) -> bytes:
        held, self.held = self.held, ""
        return b"".join(self._pieces(held, True))

    def encode(self, text: str) -> bytes:
        """A whole text."""
        if len(text) <= self.chunk and (not self.special or not self.special.search(text)):
            return b"".join(map(self.cache.__getitem__, PIECES.findall(text)))
        return b"".join([self.feed(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)] + [self.finish()])


class Decoder:
    """feed() packed ids, then finish(); each gives text."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes, self.state = vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def decode(self, ids: bytes, block: int = 1 << 18) -> Iterator[str]:
        for i in range(0, len(ids), block):
            yield self.feed(ids[i : i + block])
        yield self.finish()


_loaded: dict[int, tuple[Vocabulary, _Cache]] = {}  # of this Python worker


def _tools(content: bytes) -> tuple[Vocabulary, _Cache]:
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        vocabulary = Vocabulary(content)
        _loaded[key] = (vocabulary, _Cache(vocabulary))
    return _loaded[key]


def read_vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the asked outputs for every row of docs (doc_id, text; more columns are ignored).

    outputs: n_tokens, ids (little-endian 32-bit), decoded (text), ids_sha256, decoded_sha256. Null text counts as
    empty: no tokens, empty decoded text. Every row is kept, repeated ones too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(read_vocabulary(path))  # of fixed size
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = _tools(content.value)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in outputs}
            for text in batch.column(1):
                ids = Encoder(vocabulary, cache).encode(text.as_py() or "")
                made = {"n_tokens": len(ids) // 4, "ids": ids}
                if "ids_sha256" in rows:
                    made["ids_sha256"] = hashlib.sha256(ids).hexdigest()
                if "decoded" in rows:
                    made["decoded"] = "".join(Decoder(vocabulary).decode(ids))
                if "decoded_sha256" in rows:
                    digest = hashlib.sha256()
                    for part in Decoder(vocabulary).decode(ids):
                        digest.update(part.encode())
                    made["decoded_sha256"] = digest.hexdigest()
                for k in outputs:
                    rows[k].append(made[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[k], kinds[k][1]) for k in outputs)], ["doc_id", *outputs])

    wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(run, ", ".join(["doc_id long", *(f"{k} {kinds[k][0]}" for k in outputs)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
