"""Secret scan: three fixed patterns, and a linear-chain conditional random field that adds what they miss.

A text's tokens are runs of letters, digits and ``+/_.-``.  Each is tagged as outside, begin or inside of a secret by its shape, the words
and marks beside it and what its file is like.  The best tags are found by Viterbi.  A token whose score for outside leads by more
than any change of transitions could make up is outside on every best path, so only the runs between such tokens are decoded.

The field is fitted on at most ``WINDOWS`` stretches of the table's texts.  Secrets of many forms are written into two of three of
them, and things that only look like secrets into the others; what the fixed patterns find counts as a secret too.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; a span of the field that meets one of a
pattern is left out; an empty table is fitted on nothing and gives an empty result; repeated rows are scanned alike; further columns
are not looked at.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import table

#: Stretches that the field is fitted on, tokens of each, rounds of fitting, tokens whose features are worked out at once, and bytes scanned at once.
WINDOWS, WIDTH, ROUNDS, BLOCK, CHUNK = 3000, 24, 110, 1 << 16, 4 << 20
KINDS = ("assign", "access", "hex", "field")

# The patterns, and the least length of what they must hold (group 2, or all).
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST = 6

# Words that announce a secret, and how they are joined to it.
CUES = "password passwd pwd pass passphrase secret token apikey api_key access_key private_key secret_key client_secret auth_token credential credentials authorization bearer signing_key encryption_key session_key login pin access_token refresh_token db_password PASSWORD SECRET_KEY ACCESS_TOKEN DB_PASS Authorization Bearer".split()
JOINTS = [": ", "=", " = ", ': "', '="', "='", " is ", " => ", " ", '": "', ":"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    # a longer least count finds the same whole runs as one of any length whose short matches are dropped
    return sorted(found + [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


# Byte classes: 0 space, 1 mark, 2 lower case, 3 upper case, 4 digit, 5 sign within a token, 6 other letters.
_CLASS = np.ones(256, np.uint8)
_CLASS[list(b" \t\n\x0b\f\r\0")] = 0
_CLASS[list(string.ascii_lowercase.encode())], _CLASS[list(string.ascii_uppercase.encode())], _CLASS[list(string.digits.encode())] = 2, 3, 4
_CLASS[list(b"+/_.-")], _CLASS[128:] = 5, 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"vowel": b"aeiouAEIOU", "hex": b"0123456789abcdef", "assign": b":=>", "quote": b"\"'`", "line": b"\n", "space": b" \t", "split": b"_-."}.items()}
_LENGTHS = np.array([2, 3, 4, 5, 6, 8, 10, 13, 17, 21, 25, 33, 41, 65])
_WORDS = 11  # bits of a word's bucket

#: Features and how many values each has.
FEATURES = {
    "length": 15, "classes": 32, "changes": 10 * 8, "shares": 25, "vowels": 25, "hex": 16, "start": 1 << 9, "before": 32, "after": 32,
    "before_classes": 1 << 10, "own": 1 << _WORDS, "word_before": 2 << _WORDS, "second_before": 1 << _WORDS, "word_after": 1 << _WORDS, "file": 16,
}
_AT = dict(zip(FEATURES, np.cumsum([0, *FEATURES.values()])))
SIZE = sum(FEATURES.values())


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], _CLASS[data] >= 2, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` bytes of each token, in lower case, as one number."""
    key = np.zeros(len(start), np.uint64)
    for k in range(n):
        at = np.minimum(start + k, len(data) - 1)
        key = key << np.uint64(8) | np.where(start + k < end, _LOWER[data[at]], 0).astype(np.uint64)
    return key


def _count(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
    return sums[end] - sums[start]


def file_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What each file is like: how common assignments and digits are in it."""
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets]) / size
    return np.searchsorted([0.002, 0.01, 0.04], share(_IS["assign"][data])) * 4 + np.searchsorted([0.01, 0.05, 0.2], share(_CLASS[data] == 4))


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, file: np.ndarray) -> list[np.ndarray]:
    """For each feature the tokens' numbers; a token sees no token of another document."""
    n, size = len(start), end - start
    own = _CLASS[data]
    low, up, digit, sign, other = (_count(own == k, start, end) for k in (2, 3, 4, 5, 6))
    changes = _count(np.concatenate(([False], own[1:] != own[:-1])), start + 1, end)
    length, letters = np.searchsorted(_LENGTHS, size, side="right"), np.maximum(low + up, 1)
    classes = (low > 0) + 2 * (up > 0) + 4 * (digit > 0) + 8 * (sign > 0) + 16 * (other > 0)
    fifth = lambda x, whole: np.minimum(5 * x // np.maximum(whole, 1), 4)
    same = np.concatenate(([False], doc[1:] == doc[:-1]))
    gap_start = np.concatenate(([0], end[:-1]))
    gaps = sum((_count(_IS[k][data], gap_start, start) > 0) * (1 << b) for b, k in enumerate(("assign", "quote", "line", "space")))
    gaps = np.where(same, gaps + 16 * (start - gap_start > 2), 4)
    after = np.append(gaps[1:], 4)
    # the last part of a name tells what it is of
    cut = np.maximum.accumulate(np.where(_IS["split"][data], np.arange(len(data)), -1))[end - 1]
    part = np.where((cut >= start) & (cut < end - 1), cut + 1, start)
    word = _bucket(_letters(data, part, end, 8), _WORDS)
    before = np.where(same, np.concatenate(([0], word[:-1])), 0)
    second = np.where(same & np.concatenate(([False], same[:-1])), np.concatenate(([0, 0], word[:-2]))[:n], 0)
    next_one = np.where(np.append(same[1:], False), np.append(word[1:], 0), 0)
    found = {
        "length": length, "classes": classes, "changes": np.minimum(changes, 9) * 8 + classes % 8, "shares": fifth(digit, size) * 5 + fifth(up, size),
        "vowels": fifth(_count(_IS["vowel"][data], start, end), letters) * 5 + np.minimum(length // 3, 4), "hex": np.where(_count(_IS["hex"][data], start, end) == size, length + 1, 0),
        "start": np.where(size >= 16, 1 + _bucket(_letters(data, start, end, 4), 9) % 511, 0), "before": gaps, "after": after, "before_classes": gaps * 32 + classes,
        "own": np.where(size <= 16, word, 0), "word_before": before * 2 + (gaps & 1), "second_before": second, "word_after": next_one, "file": file[doc],
    }
    return [found[k] + _AT[k] for k in FEATURES]


@dataclass
class Field:
    """Scores of features (begin and inside, less those of outside) and of neighbouring tags (outside, begin, inside)."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, file: np.ndarray) -> np.ndarray:
        # the two scores of a feature are read as one complex number
        both = np.ascontiguousarray(self.weights, np.float32).view(np.complex64).ravel()
        out = np.zeros(len(start), np.complex64)
        for a in range(0, len(start), BLOCK):
            b, lo, hi = min(a + BLOCK, len(start)), max(a - 2, 0), min(a + BLOCK + 1, len(start))
            first = start[lo] if lo else 0
            part = slice(lo, hi)
            ids = features(data[first : end[hi - 1]], start[part] - first, end[part] - first, doc[part], file)
            for column in ids:
                out[a:b] += both.take(column[a - lo : a - lo + b - a])
        return out.view(np.float32).reshape(-1, 2)

    def tags(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tag of each token."""
        out = np.zeros(len(scores), np.int8)
        open_ = np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= -2 * (self.steps.max() - self.steps.min()))
        if not len(open_):
            return out
        cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1
        ends = np.append(doc[1:] != doc[:-1], True)
        for run in np.split(open_, cuts):
            out[run] = self._path(scores[run], bool(ends[run[-1]]))
        return out

    def _path(self, scores: np.ndarray, last: bool) -> list[int]:
        """The best tags of a run between two outside tokens, or before the end of a document."""
        steps = self.steps.tolist()
        best, back = [0.0, -np.inf, -np.inf], []
        for b, i in scores.tolist():
            ways = [max((best[x] + steps[x][y], -x) for x in range(3)) for y in range(3)]
            back.append([-w[1] for w in ways])
            best = [ways[0][0], ways[1][0] + b, ways[2][0] + i]
        y = max(range(3), key=lambda x: (best[x] + (0 if last else steps[x][0]), -x))
        path = []
        for pointers in reversed(back):
            path.append(y)
            y = pointers[y]
        return path[::-1]


def fit(ids: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, ridge: float = 2e-5) -> Field:
    """The field of greatest likelihood, by gradient steps, for ``ids[window, token, feature]``; a tag of -1 is no token."""
    n, width, k = ids.shape
    real = tags >= 0
    columns = np.ascontiguousarray(ids[real].T)
    w, t = np.zeros((SIZE, 2)), np.zeros((3, 3))
    held = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(t), np.zeros_like(t))]
    lift = lambda x: (m := x.max(axis=1, keepdims=True)) + np.log(np.exp(x - m).sum(axis=1, keepdims=True))
    prior = np.concatenate((np.zeros((n, 1), np.int64), np.where(real, tags, 0)[:, :-1]), axis=1)
    seen = np.bincount((prior * 3 + np.where(real, tags, 0))[real], minlength=9).reshape(3, 3)
    for step in range(1, rounds + 1):
        e = np.zeros((n, width, 3))
        e[real, 1:] = w.view(np.complex128).ravel().take(columns).sum(axis=0)[:, None].view(np.float64)
        forward, back = np.zeros((width, n, 3)), np.zeros((width, n, 3))
        a = np.full((n, 3), -1e9)
        a[:, 0] = 0
        for j in range(width):
            new = lift(a[:, :, None] + t[None])[:, 0, :] + e[:, j]
            a = np.where(real[:, j, None], new, a)
            forward[j] = a
        whole = lift(a)
        b = np.zeros((n, 3))
        expected = np.zeros((3, 3))
        for j in range(width - 1, -1, -1):
            back[j] = b
            before = forward[j - 1] if j else np.where(np.arange(3) == 0, 0.0, -1e9)[None].repeat(n, 0)
            pair = before[:, :, None] + t[None] + (e[:, j] + b)[:, None, :]
            expected += np.exp(pair - whole[:, :, None])[real[:, j]].sum(axis=0)
            new = lift(pair.transpose(0, 2, 1) - before[:, None, :])[:, 0, :]
            b = np.where(real[:, j, None], new, b)
        chance = np.exp(forward + back - whole[None]).transpose(1, 0, 2)[real]
        off = np.stack([(tags[real] == y) - chance[:, y] for y in (1, 2)], axis=1)
        grads = np.stack([np.bincount(columns.ravel(), np.tile(off[:, y], k), SIZE) for y in range(2)], axis=1) / n - ridge * w, (seen - expected) / n - ridge * t
        for x, g, (m, v) in zip((w, t), grads, held):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w.astype(np.float32), t)


def a_secret(rng: random.Random) -> str:
    """A value of a secret's look."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    kind = rng.randrange(7)
    if kind == 0:
        return pick("0123456789abcdef", rng.randrange(12, 65))
    if kind == 1:
        return pick(alnum + "+/", 4 * rng.randrange(5, 22))
    if kind == 2:
        return pick(alnum, rng.randrange(12, 41))
    if kind == 3:
        return pick(string.ascii_lowercase, rng.randrange(2, 5)) + rng.choice("_-") + pick(alnum, rng.randrange(20, 41))
    if kind == 4:
        return ".".join(["eyJ" + pick(alnum, rng.randrange(15, 30)), "eyJ" + pick(alnum, rng.randrange(20, 60)), pick(alnum + "-_", 43)])
    if kind == 5:  # a password
        word = pick(string.ascii_lowercase, rng.randrange(3, 7))
        return word.capitalize() + pick("!#$%&*@", rng.randrange(0, 2)) + pick(string.digits, rng.randrange(2, 5)) + pick(alnum + "!#$%", rng.randrange(1, 5))
    return pick(string.ascii_uppercase + string.digits, rng.randrange(16, 33))


def a_look_alike(rng: random.Random, words: list[str]) -> str:
    """Something that is no secret but looks a little like one."""
    word = lambda: rng.choice(words) if words else "word"
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    cue = rng.choice(CUES)
    return rng.choice([
        f"{cue} {word()} {word()}", f"{word()}: {word()}", f"{word()} = {digits(rng.randrange(1, 5))}", f"the {cue} is {word()}", f"{cue}: {word()}", f"{cue}s {word()}", f"+{digits(2)} {digits(3)} {digits(7)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}T1{digits(1)}:{digits(2)}:{digits(2)}Z",
        f"{word()}.{word()}@{word()}.com", f"https://{word()}.org/{word()}/{word()}-{word()}?{word()}={digits(3)}", f"/usr/{word()}/{word()}_{word()}.txt", f"v{digits(1)}.{digits(2)}.{digits(1)}", word() + word() + word(), f"{word()}_{word()}_{word()}", f"{word()}{word().capitalize()}{word().capitalize()}",
        f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"commit {hexes(7)}", f"ISBN {digits(13)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"id={digits(rng.randrange(4, 10))}", f"{word().upper()}_{word().upper()}", f"DE{digits(20)}", f"{digits(3)}.{digits(3)}.{digits(2)}.{digits(1)}",
    ])


def taught(stretches: list[tuple[str, int]], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of stretches of text, each with the class of its file, with secrets and look-alikes written into them."""
    rng = random.Random(seed)
    all_ids, all_tags = [], []
    for text, file in stretches:
        words = text.split(" ")
        plain = [w for w in words if w.isalpha()]
        spans = []
        at = rng.randrange(len(words) + 1)
        if rng.random() < 0.67:
            value = a_secret(rng)
            # without a word before it only a long value is known for a secret
            bare = len(value) >= 20 and rng.random() < 0.25
            lead = "" if bare else rng.choice(CUES) + rng.choice(JOINTS)
            tail = rng.choice(["", "", ".", ","]) if lead[-1:] not in ("'", '"') else lead[-1]
            head = " ".join([*words[:at], ""])
            spans = [(len(head + lead), len(head + lead + value))]
            text = head + lead + value + tail + " " + " ".join(words[at:])
        elif rng.random() < 0.85:
            text = " ".join([*words[:at], a_look_alike(rng, plain), *words[at:]])
        spans += [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST and not plain.count(m[2])] + [(s, e) for s, k, e in base_spans(text) if k]
        whole = text.encode()
        place = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        data = np.frombuffer(whole, np.uint8)
        start, end = tokens(data)
        if not len(start):
            continue
        ids = np.stack(features(data, start, end, np.zeros(len(start), np.int64), np.array([file])), axis=1)
        tags = np.zeros(len(start), np.int64)
        for s, e in spans:
            hit = np.flatnonzero((start < place[e]) & (end > place[s]))
            tags[hit], tags[hit[:1]] = 2, 1
        first = max(0, min(len(start) - WIDTH, int(np.flatnonzero(tags)[0]) - WIDTH // 2)) if tags.any() else 0
        pad = max(0, WIDTH - len(start))
        all_ids.append(np.pad(ids[first : first + WIDTH], ((0, pad), (0, 0))))
        all_tags.append(np.pad(tags[first : first + WIDTH], (0, pad), constant_values=-1))
    return np.array(all_ids, np.int64), np.array(all_tags, np.int64)


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """About ``WIDTH`` words of each text, from a place that its hash gives."""
    for batch in batches:
        out, files = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            at = key % max(1, len(text) - 8 * WIDTH)
            out.append(text[at : at + 8 * WIDTH])
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            files.append(int(file_classes(data, np.array([0, len(data)]))[0]))
        yield pa.record_batch({"key": batch.column("key"), "text": pa.array(out, pa.string()), "file": pa.array(files, pa.int32())})


def trained(docs: DataFrame, text_col: str = "text", windows: int = WINDOWS) -> Field | None:
    """A field fitted on stretches of at most ``windows`` different texts; None if there is no text."""
    rows = docs.select(F.xxhash64(text_col).bitwiseAND(F.lit((1 << 62) - 1)).alias("key"), F.col(text_col).alias("text")).where("text <> ''")
    n = docs.count()
    # twice as many as are needed, so that copies leave enough
    few = rows if n <= 2 * windows else rows.where(F.col("key") < int((1 << 62) * min(1.0, 2 * windows / n)))
    found = few.mapInArrow(_stretches, "key long, text string, file int").dropDuplicates(["key"]).orderBy("key").limit(windows).collect()
    ids, tags = taught([(r["text"], r["file"]) for r in found])
    return fit(ids, tags) if len(ids) else None


def field_spans(texts: list[bytes], field: Field) -> list[list[tuple[int, int]]]:
    """Spans of the field in each text, in code points."""
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    start, end = tokens(data)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(start):
        return out
    doc = np.searchsorted(offsets, start, side="right") - 1
    tags = field.tags(field.emissions(data, start, end, doc, file_classes(data, offsets)), doc)
    hit = np.flatnonzero(tags)
    if not len(hit):
        return out
    opens = (tags[hit] == 1) | (np.diff(hit, prepend=-2) > 1) | (np.diff(doc[hit], prepend=-1) > 0)
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(hit)) - 1
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    for a, b in zip(hit[heads].tolist(), hit[tails].tolist()):
        s, e = int(start[a]), int(end[b])
        while e > s + 1 and data[e - 1] == 46:  # a full stop belongs to the sentence
            e -= 1
        while e < len(data) and data[e] == 61 and e < end[b] + 2:  # padding
            e += 1
        zero = point[offsets[doc[a]]]
        out[doc[a]].append((int(point[s] - zero), int(point[e] - zero)))
    return out


def scanned(texts: list[str], field: Field | None) -> Iterator[list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of every text's spans."""
    held: list[str] = []
    size = 0

    def done() -> Iterator[list[tuple[int, int, int]]]:
        more = field_spans([t.encode("utf-8", "surrogatepass") for t in held], field) if field else [[]] * len(held)
        for text, extra in zip(held, more):
            base = base_spans(text)
            yield sorted(base + [(s, 3, e) for s, e in extra if all(e <= x or s >= y for x, _, y in base)])

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield from done()
            held, size = [], 0
    yield from done()


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _secrets(batches: Iterable[pa.RecordBatch], field: Field | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in scanned(batch.column("text").to_pylist(), field)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})


def secrets(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: kind, start and end of each secret, by start, then kind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _secrets(b, field), f"doc_id long, spans {SPANS}")


def op11_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets(docs, trained(docs))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base: Column = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(KINDS[3]).alias("n_field"))
