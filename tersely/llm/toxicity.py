"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel counts the subsequences of three letters that two strings share, each discounted for the places it spans, and
is divided by both strings' own values, so it is positive semidefinite.  Signs that are no letters only widen a span, so
``i.d.i.o.t`` stays near ``idiot``, as do an inserted letter and an inflected form.

Strings are windows of ``WIDE`` letters of a word, its two ends counted as letters (a shorter word is one window); four or more
letters that stand alone in a row ("i d i o t") are also read as one word.  A text is as toxic as its most toxic window.  Landmarks are windows sampled from labelled
texts of both classes; the Nystroem map of a window is the inverse square root of the landmarks' kernel matrix times its
kernel values with them, and a squared-hinge support vector machine separates the mapped windows.  Labels are given for
texts, so training alternates: each toxic text is represented by its highest windows under the present machine, and the
highest windows of clean texts are added as counterexamples, each as often as it is one.  A window that doesn't exceed
nearly all clean texts, or that they hold too, has no part in a round.  A logistic fit of the texts' margins gives the score.

A kernel of subsequences is a product of explicit features, so machine, map and landmarks fold into one weight for each
subsequence; a text costs the same for any number of landmarks.  Fitting and scoring read texts with the same function.

The model is fitted on at most ``ROWS`` labelled texts of each class, chosen by a hash of their id; scoring reads every
word of every text.  Of the fitting texts the driver gets counted pieces (``PIECES`` at most) and ``SHOWN`` windows a text and round at most.

Defined results: null and empty texts, and those without a word of two letters, have no window and get the margin of a
window without subsequences; few labels give a weaker model, and every score is 0 only where a class has no labelled text or no toxic
text has a window that clean ones lack; a row repeated in the input is scored as often as it comes;
labels repeated for one id count once, by their largest value; the stage judges each row by its own text and keeps its columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import cut, partitions, table

#: Labelled texts of each class that the model is fitted on, at most.
ROWS = 2000
#: Landmarks of each class, pieces of words that the first windows are chosen by, rounds of training.
LANDMARKS, PIECES, ROUNDS = 192, 2000, 4
#: Toxic texts with a piece times the logarithm of its odds ratio, from which on it isn't held for chance, and that logarithm.
TELLING, ODDS = 15.0, 2.5
#: Windows of a toxic text that are learned from in a round at most, and the share of the clean texts that they must exceed.
SHOWN = 8
TYPICAL = 0.95
#: Letters of a window, and the discount for each place that a subsequence spans.
WIDE, DECAY = 8, 0.8
#: Bytes of text whose words are scored together, and single letters in a row that are read as one word.
CHUNK, SPELLED = 8 << 20, 4
#: The two ends of a word among the letters, and how they and places between letters are written in a window's name.
_BEGIN, _END, _NAMES = 1, 2, {1: "^", 2: "$"}
_TRIPLES = list(combinations(range(WIDE), 3))
_POWERS = (DECAY ** np.arange(256)).astype(np.float32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters; the ideographs beyond the table are."""
    return np.array([chr(c).isalpha() for c in range(0x20000)] + [True])


@dataclass
class Windows:
    """One row a window: its letters (0 beyond its end), their places from the first one, and the number of its word."""

    letters: np.ndarray
    places: np.ndarray
    text: np.ndarray

    def take(self, rows: np.ndarray) -> Windows:
        return Windows(self.letters[rows], self.places[rows], self.text[rows])

    def names(self) -> list[str]:
        """The letters, with a dot for each place between them."""
        out = []
        for letters, places in zip(self.letters.tolist(), self.places.tolist()):
            line = ["."] * (max(places) + 1)
            for c, p in zip(letters, places):
                if c:
                    line[p] = _NAMES.get(c) or chr(c)
            out.append("".join(line))
        return out


def named(names: list[str]) -> Windows:
    """The windows of these names, one word each."""
    letters, places = np.zeros((len(names), WIDE), np.uint32), np.zeros((len(names), WIDE), np.uint8)
    codes = {v: k for k, v in _NAMES.items()}
    for row, name in enumerate(names):
        at = [p for p, c in enumerate(name) if c != "."]
        letters[row, : len(at)] = [codes.get(name[p]) or ord(name[p]) for p in at]
        places[row, : len(at)] = at
    return Windows(letters, places, np.arange(len(names)))


def windows(words: list[str]) -> Windows:
    """The windows of each word, in order; words of fewer than two letters have none."""
    points = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    place = np.flatnonzero(_letters()[np.minimum(points, 0x20000)])
    letter, word = points[place], np.searchsorted(ends, place, "right")
    if not len(letter):
        return Windows(np.zeros((0, WIDE), np.uint32), np.zeros((0, WIDE), np.uint8), np.zeros(0, np.int64))
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    last = np.append(start[1:], len(word)) - 1
    # the ends of each word, next to its first and last letter
    where = np.concatenate((last + 1, start))  # the end of a word stands before the begin of the next one
    letter = np.insert(letter, where, np.repeat(np.uint32([_END, _BEGIN]), len(start)))
    place = np.insert(place, where, np.concatenate((place[last] + 1, place[start] - 1)))
    size = last - start + 3
    owner = np.repeat(word[start], size)
    start = np.cumsum(size) - size
    rest = np.repeat(start + size, size) - np.arange(len(letter))
    short = np.zeros(len(letter), bool)
    short[start[(size < WIDE) & (size >= 4)]] = True
    row = np.flatnonzero((rest >= WIDE) | short)
    index = row[:, None] + np.arange(WIDE)
    inside = np.arange(WIDE) < rest[row][:, None]
    index = np.minimum(index, len(letter) - 1)
    places = np.where(inside, np.minimum(place[index] - place[row][:, None], 255), 0).astype(np.uint8)
    return Windows(np.where(inside, letter[index], 0), places, owner[row])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text and the word of each token, and the different words in lower case."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = lists.offsets.to_numpy()
    flat = lists.values[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = pc.dictionary_encode(flat)
    index, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    alone = pc.equal(pc.utf8_length(flat), 1).to_numpy(zero_copy_only=False)
    if alone.any():  # letters that stand alone in a row are a word too
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.where(alone, row + 1, 0), [0]))))
        runs = [(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()) if alone[a] and b - a >= SPELLED]
        row, index = np.append(row, row[[a for a, _ in runs]]), np.append(index, len(words) + np.arange(len(runs)))
        words += [".".join(flat[a:b].to_pylist()) for a, b in runs]
    return row, index, words


def windows_of(texts: pa.Array) -> tuple[Windows, np.ndarray, np.ndarray]:
    """The different windows of some texts, and which of them (second) each text (first) has, once each."""
    row, index, words = words_of(texts)
    found = windows(words)
    kinds, which = distinct(found)
    pairs = np.unique(row * (len(words) + 1) + index)
    row, index = pairs // (len(words) + 1), pairs % (len(words) + 1)
    first = np.searchsorted(found.text, np.arange(len(words) + 1))
    n = np.diff(first)[index]
    at = np.repeat(first[index], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    once = np.unique(np.repeat(row, n) * (len(which) + 1) + which[at])
    return kinds, once // (len(which) + 1), once % (len(which) + 1)


def hashed(found: Windows) -> np.ndarray:
    """A number for each window that only its letters and places make."""
    h = np.zeros(len(found.text), np.uint64)
    for k in range(WIDE):
        h = (h ^ (found.letters[:, k].astype(np.uint64) << np.uint64(8) | found.places[:, k])) * _MIX
        h ^= h >> np.uint64(29)
    return h


def distinct(found: Windows) -> tuple[Windows, np.ndarray]:
    """The different windows, and which of them each window is."""
    _, first, which = np.unique(hashed(found), return_index=True, return_inverse=True)
    return found.take(first), which


def spans(places: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Discounts of subsequences from one letter of a window to another."""
    return {(i, k): _POWERS[places[:, k] - places[:, i]] for i in range(WIDE) for k in range(i + 2, WIDE)}


def own(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The kernel of each window with itself; 1 for windows without a subsequence.

    It depends on which letters are equal and on the places only, so few different cases are worked out.
    """
    same = np.zeros(letters.shape, np.uint8)  # the first place of the same letter; 8 beyond the end
    for k in range(WIDE):
        same[:, k] = k
        for j in range(k - 1, -1, -1):
            same[:, k] = np.where(letters[:, k] == letters[:, j], j, same[:, k])
        same[:, k] = np.where(letters[:, k] == 0, WIDE, same[:, k])
    cases, which = np.unique(np.hstack((same, places)).view(f"V{2 * WIDE}").ravel(), return_inverse=True)
    case = cases.view(np.uint8).reshape(-1, 2 * WIDE)
    total = np.zeros(len(case))
    for a in range(0, len(case), 2048):
        same, discount = case[a : a + 2048, :WIDE].astype(np.int64), spans(case[a : a + 2048, WIDE:])
        base, size = 512 * np.arange(len(same)), len(same)
        keys = np.stack([base + (same[:, i] % 8) * 64 + (same[:, j] % 8) * 8 + same[:, k] % 8 for i, j, k in _TRIPLES], axis=1)
        values = np.stack([np.where(same[:, k] < WIDE, discount[i, k], 0) for i, _, k in _TRIPLES], axis=1)
        total[a : a + 2048] = (np.bincount(keys.ravel(), values.ravel(), 512 * size).reshape(-1, 512) ** 2).sum(axis=1)
    return np.where(total > 0, total, 1.0)[which]


class Features:
    """The subsequences of some strings as numbered features."""

    def __init__(self, names: list[str]):
        found = named(names)
        self.alphabet = np.unique(np.append(found.letters, 0))
        n, seen = self._numbers(found.letters), found.letters != 0
        size = len(self.alphabet)
        keys = np.unique(np.concatenate([(n[s, i] * size + n[s, j]) * size + n[s, k] for i, j, k in _TRIPLES for s in [seen[:, k]]]))
        self.pairs, self.keys = np.unique(keys // size), keys

    def _numbers(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, 0)

    def matrix(self, names: list[str]) -> np.ndarray:
        """The feature values of each window over the square root of its kernel with itself."""
        found = named(names)
        n, size, discount = self._numbers(found.letters), len(self.alphabet), spans(found.places)
        out = np.zeros((len(names), len(self.keys)))
        length = np.sqrt(own(found.letters, found.places))
        for i, j, k in _TRIPLES:
            key = (n[:, i] * size + n[:, j]) * size + n[:, k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[at] == key) & (n[:, i] > 0) & (n[:, j] > 0) & (n[:, k] > 0)
            np.add.at(out, (found.text[ok], at[ok]), (discount[i, k] / length)[ok])
        return out


@dataclass
class Machine:
    """A weight for each subsequence: the value of a window is its normalised features times these, and a bias."""

    features: Features
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        f, size = self.features, len(self.features.alphabet)
        # by pair of letters, then by the third one
        self.pair = np.zeros(size * size, np.int32)
        self.pair[f.pairs] = np.arange(1, len(f.pairs) + 1)
        self.third = np.zeros((len(f.pairs) + 1) * size, np.float32)
        self.third[self.pair[f.keys // size] * size + f.keys % size] = self.weights
        self.number = np.zeros(0x20001, np.int32)
        self.number[np.minimum(f.alphabet, 0x20000)] = np.where(f.alphabet < 0x20000, np.arange(size), 0)

    def values(self, found: Windows) -> np.ndarray:
        size, out = len(self.features.alphabet), np.zeros(len(found.text), np.float32)
        n = [self.number[np.minimum(found.letters[:, k], 0x20000)] for k in range(WIDE)]
        discount = spans(found.places)
        for i, j in combinations(range(WIDE - 1), 2):
            base = self.pair[n[i] * size + n[j]] * size
            if base.any():
                for k in range(j + 1, WIDE):
                    out += self.third[base + n[k]] * discount[i, k]
        return out / np.sqrt(own(found.letters, found.places)) + self.bias


class Evidence:
    """What windows are worth before there is a machine: the summed odds of the telling pieces that they hold."""

    def __init__(self, pieces: list[str], odds: list[float]):
        keys = self._keys(named(pieces).letters[:, :4])
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], np.array(odds, np.float32)[order]

    @staticmethod
    def _keys(four: np.ndarray) -> np.ndarray:
        key = np.zeros(len(four), np.uint64)
        for k in range(4):
            key = key * np.uint64(0x1FFFF7) + four[:, k]
        return key

    def values(self, found: Windows) -> np.ndarray:
        out = np.zeros(len(found.text), np.float32)
        for k in range(WIDE - 3):
            key = self._keys(found.letters[:, k : k + 4])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out += np.where(self.keys[at] == key, self.odds[at], 0)
        return out


def highest(texts: pa.Array, machine: Machine) -> np.ndarray:
    """The largest value of each text's windows; nan without windows."""
    row, index, words = words_of(texts)
    found = windows(words)
    kinds, which = distinct(found)
    value, out = machine.values(kinds)[which], np.full(len(texts), np.nan)
    word = np.full(len(words), -np.inf)
    if len(value):
        first = np.flatnonzero(np.concatenate(([True], np.diff(found.text) > 0)))
        word[found.text[first]] = np.maximum.reduceat(value, first)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, row, word[index])
    out[best > -np.inf] = best[best > -np.inf]
    return out


def _chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def margins(texts: pa.Array, machine: Machine) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in _chunks(texts):
        out[a:b] = highest(texts[a:b], machine)
    return out


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Primal squared-hinge support vector machine by Newton steps; y is -1 or 1, the classes weigh alike."""
    z = np.hstack((x, np.ones((len(x), 1))))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    c = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
    w = np.zeros(z.shape[1])
    for turn in range(60):
        on = y * (z @ w) < 1
        a, b = z[on], c[on]
        new = np.linalg.solve((a * b[:, None]).T @ a + np.diag(penalty), a.T @ (b * y[on]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = (w + new) / 2 if turn > 25 else new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (Platt's targets)."""
    up, down = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z, w = np.stack((margin, np.ones_like(margin)), 1), np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - goal) + 1e-3 * (w - [2, 0]))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Map:
    """The Nystroem map of windows by landmarks."""

    def __init__(self, landmarks: list[str]):
        self.features = Features(landmarks)
        self.rows = self.features.matrix(landmarks)
        self.gram = self.rows @ self.rows.T
        size, axes = np.linalg.eigh(self.gram)
        keep = size > 1e-6 * size.max(initial=1.0)
        self.half = axes[:, keep] / np.sqrt(size[keep])

    def __call__(self, names: list[str]) -> np.ndarray:
        parts = [self.features.matrix(names[a : a + 500]) @ self.rows.T @ self.half for a in range(0, len(names), 500)]
        return np.vstack(parts) if parts else np.zeros((0, self.half.shape[1]))

    def machine(self, w: np.ndarray, bias: float) -> Machine:
        return Machine(self.features, (self.half @ w) @ self.rows, bias)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``piece, t, c``: how many toxic and clean texts have a run of four letters."""
    for batch in batches:
        kinds, text, which = windows_of(batch.column("text"))
        label = batch.column("toxic").to_numpy()
        four = np.vstack([kinds.letters[:, k : k + 4] for k in range(WIDE - 3)])
        four, piece = np.unique(four, axis=0, return_inverse=True)
        piece = piece.reshape(WIDE - 3, -1)
        once = np.unique(np.concatenate([text * len(four) + piece[k][which] for k in range(WIDE - 3)]))
        text, piece = once // max(len(four), 1), once % max(len(four), 1)
        toxic = np.bincount(piece[label[text] == 1], minlength=len(four))
        clean = np.bincount(piece[label[text] == 0], minlength=len(four))
        whole = (four != 0).all(axis=1)
        names = Windows(four[whole], np.broadcast_to(np.arange(4), (whole.sum(), 4)), np.zeros(0)).names()
        yield pa.record_batch({"piece": pa.array(names, pa.string()), "t": pa.array(toxic[whole]), "c": pa.array(clean[whole])})


def _witnesses(batches: Iterable[pa.RecordBatch], machine: Machine | Evidence) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, toxic, nth, value, best``: the ``SHOWN`` highest different windows of a toxic text, the highest of a clean one."""
    for batch in batches:
        for a, b in _chunks(batch.column("text")):
            part = batch.slice(a, b - a)
            kinds, text, which = windows_of(part.column("text"))
            value, number = machine.values(kinds)[which], hashed(kinds)[which]
            order = np.lexsort((number, -value, text))  # ties: the same window wherever the text is read
            nth = np.arange(len(text)) - np.searchsorted(text, text)
            rows = nth < np.where(part.column("toxic").to_numpy()[text] == 1, SHOWN, 1)
            at, text = order[rows], pa.array(text[rows])
            yield pa.record_batch({"doc_id": part.column("doc_id").take(text), "toxic": part.column("toxic").take(text), "nth": pa.array(nth[rows]), "value": pa.array(value[at].astype(np.float64)), "best": pa.array(kinds.take(which[at]).names(), pa.string())})


def _samples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``name``: a window of each text, by its hash."""
    for batch in batches:
        kinds, text, which = windows_of(batch.column("text"))
        at = np.lexsort((hashed(kinds)[which], text))
        yield pa.record_batch({"name": pa.array(kinds.take(which[at[np.searchsorted(text, np.unique(text))]]).names(), pa.string())})


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Machine | None:
    """Fit on labelled rows (``labels``: doc_id, toxic), at most ``rows`` of each class; None if a class has none."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    kinds = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    few = F.broadcast(kinds[0].unionByName(kinds[1]))  # 2 * rows at most
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id").repartition(partitions(docs), "doc_id"))
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if set(n) != {0, 1}:
        return None
    counts = texts.mapInArrow(_pieces, "piece string, t long, c long").groupBy("piece").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    told = counts.withColumn("odds", F.round(odds, 6)).withColumn("told", F.round(F.col("t") * F.col("odds"), 6)).where("odds > 0")
    told = told.withColumn("sure", (F.col("told") >= TELLING) & (F.col("odds") >= ODDS)).orderBy(F.desc("sure"), F.desc("told"), "piece").limit(PIECES).collect()
    # with few labels no piece is beyond chance: then all that speak for a toxic text are taken
    told = [r for r in told if r["sure"]] or told
    if not told:
        return None
    witness = lambda m: texts.mapInArrow(lambda b: _witnesses(b, m), "doc_id long, toxic int, nth long, value double, best string").orderBy("doc_id", "nth").collect()
    plain = [r["name"] for r in texts.where("toxic = 0").mapInArrow(_samples, "name string").distinct().orderBy(F.xxhash64("name"), "name").collect()]
    against = dict.fromkeys(["", *plain], 1)  # nothing is clean
    seen = witness(Evidence([r["piece"] for r in told], [r["odds"] for r in told]))
    for turn in range(ROUNDS):
        against |= {name: max(n, against.get(name, 0)) for name, n in Counter(r["best"] for r in seen if not r["toxic"]).items()}
        # what looks like clean texts, or stands in them too, tells nothing yet
        least = np.quantile([r["value"] for r in seen if not r["toxic"]] or [0.0], TYPICAL)
        up = Counter(r["best"] for r in seen if r["toxic"] and r["value"] > least and r["best"] not in against)
        if not up:
            return None
        if not turn:
            mapped = Map([name for name, _ in up.most_common(LANDMARKS)] + plain[:LANDMARKS])
        y = np.repeat([1, -1], [len(up), len(against)])
        machine = mapped.machine(*separate(mapped([*up, *against]), y, np.array([*up.values(), *against.values()], float)))
        seen = witness(machine)
    seen = [r for r in seen if r["nth"] == 0]
    empty = [n[k] - sum(r["toxic"] == k for r in seen) for k in (0, 1)]  # texts without windows
    value = np.concatenate(([r["value"] for r in seen], np.full(sum(empty), machine.bias)))
    machine.slope, machine.shift = calibrate(value, np.concatenate(([1 if r["toxic"] else -1 for r in seen], np.repeat([-1, 1], empty))))
    return machine


def _score(texts: pa.Array, machine: Machine | None) -> np.ndarray:
    if machine is None:
        return np.zeros(len(texts))
    value = margins(texts, machine)
    return 1 / (1 + np.exp(-np.clip(machine.slope * np.where(np.isnan(value), machine.bias, value) + machine.shift, -50, 50)))


def _scores(batches: Iterable[pa.RecordBatch], machine: Machine | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(_score(batch.column(1), machine))})


def _accepted(batches: Iterable[pa.RecordBatch], machine: Machine | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_score(batch.column("text"), machine) < 0.5))


def toxicity(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _scores(b, machine), "doc_id long, score double")


def bucket(column: str, n: int) -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def trained(spark: SparkSession, sf_dir: str) -> Machine | None:
    return fit(table(spark, sf_dir, "documents").where(bucket("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0))


def op9_toxicity_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    held = F.coalesce(bucket("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the model rejects, each by its own text; the columns and all other rows stay as they are."""
    machine = trained(spark, sf_dir)
    return docs.mapInArrow(lambda b: _accepted(b, machine), docs.schema)
