"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans.

A word's script, by the range its first letter lies in, leaves the languages that were learned with that script.  Each
candidate scores the word by the mean log-probability of its byte n-grams, times the word's letters up to a bound.  The best path over a text's
words pays a penalty for each change of language, so a mixed text falls into spans.

The model is learned from at most ``ROWS`` texts of each language, chosen by a hash of their id; prediction reads every
word of every text.

Defined results: a null text or one without letters has no spans and is ``und`` with score 0; a text whose scripts no language
was learned with gets the most frequent one with score 0; with nothing learned every text is ``und``; rows repeat as
the input does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import table

#: Texts of each language that the model is learned from, at most, and the salts that spread their choice.
ROWS, SALTS = 3200, 32
#: N-gram lengths in bytes, hash buckets of each language, penalty for a change, bound of a word's weight.
GRAMS, BUCKETS, SWITCH, MOST = (1, 2, 3, 4), 1 << 15, 6.0, 8
#: Bytes of text that are learned from or scored at once, and bytes of words whose n-grams are held at once.
CHUNK, PART = 4 << 20, 1 << 18

# First code points of runs of scripts; a run lasts to the next one.
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x30000, "other")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_NUMBERS = np.array([_NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # (BUCKETS, languages)
    scripts: np.ndarray  # (scripts, languages): whether a language was learned with a script
    first: int  # the most frequent language


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of letters in lower case, and how many each text has."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+")
    offsets = lists.offsets.to_numpy()
    flat = lists.values[offsets[0] : offsets[-1]]
    # a run of marks alone has no letter
    full = pc.invert(pc.match_substring_regex(flat, r"^\pM*$")).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    return np.diff(ends), flat.filter(pa.array(full))


def grams(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words' n-grams with their edges marked, and the word of each; those that begin in ``PART`` bytes at a time."""
    joined = pc.binary_join_element_wise("", words, "", " ")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    text = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    for a in range(0, len(text), PART):
        b = min(a + PART, len(text))
        part = text[a : b + max(GRAMS) - 1].astype(np.uint64)
        first, end = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b)
        word = np.repeat(np.arange(first, end), np.diff(np.clip(offsets[first : end + 1], a, b)))
        left = offsets[word + 1] - np.arange(a, b)  # bytes up to the word's end
        h = np.zeros(b - a, np.uint64)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(part) - n + 1]
            h = h * np.uint64(0x100000001B3) + part[n - 1 : n - 1 + len(h)] + np.uint64(n)
            inside = left[: len(h)] >= n
            if n in GRAMS and inside.any():
                mixed = (h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
                yield mixed.astype(np.int64) % BUCKETS, word[: len(h)][inside]


def scripts_of(words: pa.Array) -> np.ndarray:
    """Each word's script."""
    points = pc.utf8_slice_codeunits(words, 0, 1).to_pylist()
    return _NUMBERS[np.searchsorted(_STARTS, np.array([ord(x) for x in points], np.int64), "right") - 1]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``CHUNK`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        yield a, b
        a = b


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, bucket, n``: n-gram counts; buckets from BUCKETS on count the words of a script."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = pc.dictionary_encode(batch.column(0))
        for a, b in slices(batch.column(1)):
            sizes, words = words_of(batch.column(1)[a:b])
            index = np.repeat(langs.indices[a:b].to_numpy(), sizes)
            for i in np.unique(index).tolist():
                found = pc.value_counts(words.filter(pa.array(index == i)))
                own, times = found.field(0), found.field(1).to_numpy()
                n = total.setdefault(langs.dictionary[i].as_py(), np.zeros(BUCKETS + len(_NAMES), np.int64))
                for bucket, owner in grams(own):
                    n[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
                n[BUCKETS:] += np.bincount(scripts_of(own), times, len(_NAMES)).astype(np.int64)
    for k, n in total.items():
        some = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([k] * len(some), pa.string()), "bucket": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})


def fit(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """Learn from ``docs(doc_id, text, lang)``, at most ``rows`` texts of each language; None if there are none."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    order = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id")
    picked = known.select("doc_id", "lang", "h").withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(1, rows // SALTS)).select("doc_id", "lang").distinct()
    some = known.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"])
    got = some.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    langs = sorted(got.lang.unique())
    n = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    n[got.bucket, got.lang.map({k: i for i, k in enumerate(langs)})] = got.n
    counts, scripts = n[:BUCKETS], n[BUCKETS:]
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    return Model(langs, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), scripts > 0.01 * np.maximum(scripts.sum(axis=0), 1), int(scripts.sum(axis=0).argmax()))


def best_paths(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; ``scores`` has the texts' words one after another. All texts advance together."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[order], sizes[order]
    live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right") if len(lengths) and lengths[0] else []
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    own = np.arange(scores.shape[1], dtype=came.dtype)
    state = np.zeros((len(lengths), scores.shape[1]), np.float32)
    last = np.zeros(len(lengths), np.int64)
    for t, n in enumerate(live):
        at, now = starts[:n] + t, state[:n]
        if t:
            top = now.argmax(axis=1)
            change = now[np.arange(n), top] - switch
            moved = change[:, None] > now
            came[at] = np.where(moved, top[:, None], own)
            now = np.where(moved, change[:, None], now)
            now = now - now.max(axis=1, keepdims=True)
        state[:n] = now + scores[at]
    last = state.argmax(axis=1)
    path = np.zeros(len(scores), np.int64)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        path[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return path


def label(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its language (-1: no candidate) and letters; the texts' sizes; each word's text."""
    sizes, flat = words_of(texts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0), sizes, row
    coded = pc.dictionary_encode(flat)
    index = coded.indices.to_numpy()
    n = len(coded.dictionary)
    amount, word = np.zeros(n, np.int64), np.zeros((n, len(model.langs)))
    for bucket, owner in grams(coded.dictionary):
        first, some = owner[0], owner[-1] + 1  # a few words of many
        amount[first:some] += np.bincount(owner - first)
        for k in range(len(model.langs)):
            word[first:some, k] += np.bincount(owner - first, model.logs[bucket, k])
    letters = pc.utf8_length(coded.dictionary).to_numpy().astype(np.float64)
    word = (word / amount[:, None] * np.minimum(letters, MOST)[:, None]).astype(np.float32)
    fits = model.scripts[scripts_of(coded.dictionary)]
    word = np.where(fits, word, np.float32(-50))
    none = ~fits.any(axis=1)
    word[none] = 0
    path = best_paths(word[index], sizes)
    path[none[index]] = -1
    return path, letters[index], sizes, row


def _predict(batches: Iterable[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            yield pa.record_batch({"doc_id": ids[a:b], **_answer(texts[a:b], model, spans_type)})


def _answer(texts: pa.Array, model: Model | None, spans_type: pa.DataType) -> dict:
    n = len(texts)
    if model is None:
        return {"lang_pred": pa.array(["und"] * n), "score": pa.array(np.zeros(n)), "spans": pa.array([[]] * n, spans_type)}
    path, letters, sizes, row = label(texts, model)
    known = path >= 0
    k = len(model.langs)
    share = np.bincount(row[known] * k + path[known], letters[known], n * k).reshape(n, k)
    total = np.bincount(row, letters, n)
    best = np.where(share.any(axis=1), share.argmax(axis=1), model.first)
    score = np.where(total > 0, share.max(axis=1, initial=0) / np.maximum(total, 1), 0.0)
    names = np.array(model.langs, dtype=object)
    start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (path[1:] != path[:-1]))) if len(row) else np.zeros(0, bool))
    stop = np.concatenate((start[1:], [len(row)])) - 1 if len(start) else start
    base = np.cumsum(sizes) - sizes
    real = path[start] >= 0 if len(start) else np.zeros(0, bool)
    start, stop = start[real], stop[real]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[start], minlength=n)))) if len(start) else np.zeros(n + 1)
    fields = [pa.array((start - base[row[start]]).astype(np.int32)), pa.array((stop - base[row[start]]).astype(np.int32)), pa.array(names[path[start]], pa.string())]
    spans = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(spans_type.value_type)))
    return {"lang_pred": pa.array(np.where(sizes > 0, names[best], "und"), pa.string()), "score": pa.array(score), "spans": spans}


def languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row; spans number the text's runs of letters from 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _predict(b, model), "doc_id long, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>")


def op7_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.where(rest != 2).select("doc_id", "text", "lang"))
    return languages(docs, model).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
