"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a chunk are laid out as one chain of symbols.  An index maps the rank of each mergeable pair to all
places where the pair stands; ranks are applied in ascending order, each at all its places at once in turn, and only the
lists of the pairs that a merge makes or breaks are updated.  Words that a task has met before are taken from a bounded
store.

Defined results: null and empty texts have no tokens (zero, digests of the empty string); rows repeat as the input does.
A special token's string in a text becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import table

#: How byte-level BPE splits a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words kept by a task, and characters of text whose new words are merged together.
STORE, CHUNK = 500_000, 8 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Slots(dict[str, int]):
    """Numbers strings as they are first asked for, from 0; a string is looked up once wherever it stands."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Coder:
    """Encodes and decodes with the vocabulary of a ``tokenizers`` file, given as its text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, symbols = spec["model"], byte_symbols()
        ids = model["vocab"]
        back = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([ids[c] for c in symbols])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.marked = self.names | {-1: ";"}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        self.sizes[list(self.bytes)] = list(map(len, self.bytes.values()))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        self.made = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.slots = Slots()
        self.named: list[str] = []  # by slot: the piece's ids, comma-joined
        self.plain: list[bytes] = []  # by slot: the bytes that its ids decode to

    def split(self, text: str) -> list[str]:
        """Pieces that encode independently: a word begins at each single space, so no word reaches across one."""
        if any(s in text for s in self.special):
            return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.words.findall(part))]
        parts = text.split(" ")
        if "" in parts or parts != list(map(str.strip, parts)):
            return self.words.findall(text)  # white space runs on here
        return [parts[0], *map(" ".__add__, parts[1:])]

    def learn(self) -> None:
        """Encode the pieces that have a slot only, all together."""
        new, words, ends = list(islice(self.slots, len(self.named), None)), [], []
        for x in new:  # one list for all, as a list for each piece keeps the garbage collector busy
            words += [x] if x in self.special else self.words.findall(x)
            ends.append(len(words))
        own = [w for w in dict.fromkeys(words) if w not in self.special]
        named, plain = self.written(self.merge([w.encode() for w in own]))
        named, plain = dict(zip(own, named)), dict(zip(own, plain))
        named |= {w: self.names[i] for w, i in self.special.items()}
        plain |= {w: self.bytes[i] for w, i in self.special.items()}
        a = 0
        for b in ends:
            if b == a + 1:
                self.named.append(named[words[a]])
                self.plain.append(plain[words[a]])
            else:
                self.named.append(",".join([named[w] for w in words[a:b]]))
                self.plain.append(b"".join([plain[w] for w in words[a:b]]))
            a = b

    def written(self, left: np.ndarray) -> tuple[list[str], list[bytes]]:
        """The ids of each word, comma-joined, and the bytes that they decode to, all joined at once and then parted."""
        if not len(left):
            return [], []
        line = ",".join(map(self.marked.__getitem__, left.tolist()))
        end = left == -1
        raw = b"".join(map(self.bytes.__getitem__, left[~end].tolist()))
        stops = np.cumsum(np.where(end, 0, self.sizes[left]))[end].tolist()
        return line[:-2].split(",;,"), [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Token ids of each word, then -1, one word after another."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes
        sym = np.full(int(sizes.sum()) + len(words) + 1, -1, np.int64)  # -1 stands between words, so no pair crosses them
        inside = np.ones(len(sym), bool)
        inside[0] = inside[starts + sizes] = False
        sym[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Add the places of the pairs that have a rank to its list."""
            rank = self.ranks(left, right)
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            edges = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:]):
                if (r := int(rank[a])) in places:
                    places[r].append(at[a:b])
                else:
                    places[r] = [at[a:b]]
                    heappush(active, r)

        put(np.arange(len(sym) - 1), sym[:-1], sym[1:])
        while active:
            r = heappop(active)
            a, b, c = self.made[r]
            i = places.pop(r)
            i = np.unique(np.concatenate(i)) if len(i) > 1 else i[0]
            j = after[i]
            ok = (sym[i] == a) & (sym[j] == b)  # else another merge took one of the two
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if a == b and (j[:-1] == i[1:]).any():  # in a run of one symbol every second place merges
                keep, last = np.ones(len(i), bool), -1
                for n, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                    keep[n] = x != last
                    last = y if keep[n] else -1
                i, j = i[keep], j[keep]
            k, h = after[j], before[i]
            sym[i], sym[j] = c, -2
            after[i], before[k] = k, i
            same = np.full(len(i), c)
            put(np.concatenate((i, h)), np.concatenate((same, sym[h])), np.concatenate((sym[k], same)))
        return sym[sym >= -1][1:]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.key_ranks[at], -1)

    def chunks(self, texts: Iterable[str | None]) -> Iterator[list[list[int]]]:
        """The slots of the words of some texts at a time, all of them in the store."""
        held: list[list[int]] = []
        size = 0
        for t in texts:
            held.append(list(map(self.slots.__getitem__, self.split(t or ""))))
            size += len(t or "")
            if size >= CHUNK:
                self.learn()
                yield held
                held, size = [], 0
                if len(self.slots) > STORE:
                    self.slots, self.named, self.plain = Slots(), [], []
        if held:
            self.learn()
            yield held

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        for held in self.chunks(texts):
            for words in held:
                yield [int(i) for w in words for i in self.named[w].split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def _share(spark: SparkSession, path: str):
    """The vocabulary file, read where the driver runs; its size is that of a vocabulary, whatever the input."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row."""
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            ids = list(coder.encode(batch.column(1).to_pylist()))
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for every row of token ids; null ids decode to null."""
    shared = _share(tokens.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of each text's ids and of what they decode to."""
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids, text = [], [], []
            for held in coder.chunks(x.as_py() for x in batch.column(1)):
                for words in held:
                    line = ",".join(map(coder.named.__getitem__, words))
                    n.append(line.count(",") + 1 if line else 0)
                    ids.append(digest(line.encode()))
                    text.append(digest(b"".join(map(coder.plain.__getitem__, words)).decode("utf-8", "replace").encode()))
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, vocabulary())
