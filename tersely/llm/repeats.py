"""Exact removal of repeated passages with enhanced suffix arrays.

A passage is a string of ``SPAN`` bytes that also starts in a document with a smaller id.  All texts together would not fit
one suffix array, so windows that can be equal are first brought together: of the ``GRAM``-byte strings in a window the
one with the smallest hash is its anchor, and equal windows have equal anchors.  Consecutive windows with one anchor form a
run, and a run is known by the hash of its anchor and the hash of its bytes.

* Runs with equal bytes need no suffix array: all but those of the smallest document are repeats as a whole.
* Of the rest, only runs whose anchor has runs with other bytes in other documents are fetched.  Per batch of anchors, an
  enhanced suffix array over the runs' windows is scanned with a stack: each interval of a common prefix of ``SPAN`` bytes or more
  whose occurrences differ in the byte to their left is a maximal repeat, given with all its occurrences.

Equal runs are reduced within each task before they are shuffled, so a passage that a third of all documents share leaves a
task once; an anchor with more than ``HOT`` different runs is dealt out by single windows.  Matches are bytewise and never
cross documents.

Defined results: null and empty texts have no bytes; rows with one id never repeat each other, and each is cut by its own text
only (texts of one id are told apart by 32 bits of a hash); a null id is larger than none and smaller than none, so its text
stays whole; texts shorter than a passage stay whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import cut, fresh, partitions, raw, table, whole_groups

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: Bytes of text hashed at once, different runs of one anchor in one suffix array at most, and runs of a batch.
CHUNK, HOT, BATCH = 2 << 20, 30_000, 12_000
_LOW = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window, anchor, hash of the anchor and of the bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - SPAN + 1, 0)
    if not count.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    for n, step in enumerate((1, 2, 4, 8)):
        h = h[:-step] * (_ODD + np.uint64(2 * n)) + h[step:]
    h = _mix(h)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    for step in (1, 2, 4, 8, 16, WINDOW - 32):
        low = np.minimum(low[:-step], low[step:])
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base, count)
    anchor = (low[start] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((first[1:], [len(start)])) - 1
    a, b, at, who = start[first], start[last], anchor[first], text[first]
    # the hash of a run's bytes: its mixed GRAM-byte hashes as digits of a number
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h) - 1, _ODD))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power)))
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h) - 1, inverse))))
    content = _mix((total[b + SPAN - GRAM + 1] - total[a]) * back[a] ^ (b - a).astype(np.uint64))
    return who, a - base[who], b - base[who], at - base[who], h[at], content


def _marks(docs: np.ndarray, marks: tuple[np.ndarray, ...], probe: bool, parts: int) -> pa.RecordBatch:
    """Rows ``part, probe, blob``: ids and their marks, three 32-bit numbers each (start, length or code, tag), by the part of the id."""
    part = docs % parts
    order = np.lexsort((docs, part))
    docs, pairs, part = docs[order], np.stack(marks, axis=1)[order].astype(np.int32), part[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0]
    zip_ = zstandard.ZstdCompressor(level=1)
    blobs = [zip_.compress(np.diff(docs[a:b], prepend=0).tobytes() + pairs[a:b].T.tobytes()) for a, b in zip(edges[:-1], edges[1:])]
    return pa.record_batch({"part": pa.array(part[edges[:-1]], pa.int32()), "probe": pa.array([probe] * len(blobs), pa.bool_()), "blob": pa.array(blobs, pa.binary())})


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, pairs``: all marks of a document together, from the blobs of its part."""
    for frame in whole_groups(batches, "part"):
        for _, rows in frame.groupby("part", sort=False):
            docs, pairs = [], []
            for data in map(zstandard.ZstdDecompressor().decompress, rows["blob"]):
                n = len(data) // 20
                docs.append(np.cumsum(np.frombuffer(data, np.int64, n)))
                pairs.append(np.frombuffer(data, np.int32, 3 * n, 8 * n).reshape(3, n).T)
            doc = np.concatenate(docs)
            order = np.argsort(doc, kind="stable")
            doc, values = doc[order], np.ascontiguousarray(np.concatenate(pairs)[order])
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            offsets = (12 * np.append(first, len(doc))).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.record_batch({"doc_id": pa.array(doc[first]), "pairs": blobs})


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """Ids, tags, offsets and bytes of some texts at a time; a long text comes in pieces that share ``SPAN - 1`` bytes."""
    ids, tags, offsets, texts, size = [], [], [], [], 0
    for batch in batches:
        for doc, value, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = value.as_py()
            for at in range(0, max(len(text) - SPAN + 1, 0), CHUNK):
                piece = text[at : at + CHUNK + SPAN - 1]
                ids.append(doc)
                tags.append(tag)
                offsets.append(at)
                texts.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield ids, tags, offsets, texts
                    ids, tags, offsets, texts, size = [], [], [], [], 0
    if ids:
        yield ids, tags, offsets, texts


def _entries(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows ``part, known, blob``: runs by the part of their anchor, and the spans already known to be repeats."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for turn, (ids, tags, offsets, texts) in enumerate(_segments(batches)):
        who, first, last, anchor, key, content = runs(texts)
        doc, tag, base = np.array(ids, np.int64)[who], np.array(tags, np.int32)[who], np.array(offsets, np.int64)[who]
        order = np.lexsort((first, doc, content, key))
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])))
        least = doc[order][new][np.cumsum(new) - 1]
        again = doc[order] > least
        out_part, out_known, out_blob = [], [], []
        if (x := order[again]).size:
            out_part.append((int(doc[0]) + turn) % parts)
            out_known.append(True)
            out_blob.append(zip_.compress(b"".join((doc[x].tobytes(), (first[x] + base[x]).astype(np.int32).tobytes(), (last[x] - first[x] + SPAN).astype(np.int32).tobytes(), tag[x].tobytes()))))
        x = order[~again]
        part = (key[x] % np.uint64(parts)).astype(np.int64)
        x = x[np.lexsort((first[x] + base[x], doc[x], part))]
        part = (key[x] % np.uint64(parts)).astype(np.int64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(x)]))
        high = (key // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        low = content.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                y = x[a:b]
                columns = (high[y].T.tobytes(), low[y].T.tobytes(), np.diff(doc[y], prepend=0).tobytes(), (first[y] + base[y]).astype(np.int32).tobytes(), tag[y].tobytes(), (anchor[y] - first[y]).astype(np.uint8).tobytes(), (last[y] - first[y]).astype(np.uint8).tobytes())
                out_part.append(int(part[a]))
                out_known.append(False)
                out_blob.append(zip_.compress(b"".join(columns)))
        yield pa.record_batch({"part": pa.array(out_part, pa.int32()), "known": pa.array(out_known, pa.bool_()), "blob": pa.array(out_blob, pa.binary())})


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(data) // 30
    hashes = np.zeros((2, n, 8), np.uint8)
    hashes[0, :, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(5, n).T
    hashes[1, :, :7] = np.frombuffer(data, np.uint8, 7 * n, 5 * n).reshape(7, n).T
    at = 12 * n
    out = [hashes[0].view("<u8")[:, 0], hashes[1].view("<u8")[:, 0]]
    for kind in (np.int64, np.int32, np.int32, np.uint8, np.uint8):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    out[2] = np.cumsum(out[2])
    return tuple(out)


def _matched(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows ``part, probe, blob``: spans (start, length) that are repeats, and runs to be fetched."""
    for frame in whole_groups(batches, "part"):
        for _, rows in frame.groupby("part", sort=False):
            known = [zstandard.ZstdDecompressor().decompress(b) for b in rows["blob"][rows["known"]]]
            for data in known:
                n = len(data) // 20
                yield _marks(np.frombuffer(data, np.int64, n), tuple(np.frombuffer(data, np.int32, 3 * n, 8 * n).reshape(3, n)), False, parts)
            blobs = rows["blob"][~rows["known"]]
            if not len(blobs):
                continue
            key, content, doc, first, tag, off, size = (np.concatenate(c) for c in zip(*map(_unpacked, blobs)))
            order = np.lexsort((doc, content, key))
            key, content, doc, first, tag, off, size = (c[order] for c in (key, content, doc, first, tag, off, size))
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            new = fresh | np.concatenate(([True], content[1:] != content[:-1]))
            again = doc > doc[new][np.cumsum(new) - 1]
            if again.any():
                yield _marks(doc[again], (first[again], size[again].astype(np.int32) + SPAN, tag[again]), False, parts)
            lead = ~again
            bucket = (np.cumsum(fresh) - 1)[lead]
            doc, first, tag, off, size = doc[lead], first[lead], tag[lead], off[lead].astype(np.int32), size[lead].astype(np.int32)
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            several = (np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge))[bucket]
            hot = (np.bincount(bucket) > HOT)[bucket]
            if several.any():
                yield _marks(doc[several], tuple(c[several] for c in (first, off | size << 8 | hot.astype(np.int32) << 16, tag)), True, parts)


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, bytes, doc_id, start, tag``: the bytes of the runs asked for; of hot anchors, single windows."""
    digest = lambda b: xxhash.xxh64_intdigest(b) - (1 << 63)
    for batch in batches:
        keys, found, docs, starts, tags = [], [], [], [], []
        for doc, value, tag, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
            if not asked.is_valid:
                continue
            text = value.as_py()
            for first, code, of in np.frombuffer(asked.as_py(), np.int32).reshape(-1, 3).tolist():
                off, size = code & 255, code >> 8 & 255
                if of != tag:
                    continue  # of another text with this id
                for at, n in [(first + k, SPAN) for k in range(size + 1)] if code >> 16 else [(first, size + SPAN)]:
                    piece = text[at : at + n]
                    keys.append(digest(piece if code >> 16 else text[first + off : first + off + GRAM]))
                    found.append(piece)
                    docs.append(doc)
                    starts.append(at)
                    tags.append(tag)
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), "bytes": pa.array(found, pa.binary()), "doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int32()), "tag": pa.array(tags, pa.int32())})


def suffix_array(strings: list[bytes], least: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes: string number, offset, common prefix with the next one, byte to the left.

    Only suffixes whose first ``least`` bytes begin another one too are in it, as no others are part of a repeat.  The byte to
    the left is -1 where the suffix is its whole string, which differs from any byte.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    count = np.maximum(sizes - least + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    wide = -(-int(sizes.max(initial=0)) // 8) * 8
    joined = np.frombuffer(b"".join(strings) + bytes(wide), np.uint8).astype(np.uint64)
    at = (np.cumsum(sizes) - sizes)[owner] + offset
    if len(at):
        digit = _mix(joined + _ODD)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digit * np.cumprod(np.full(len(digit), _ODD)))))
        back = np.cumprod(np.full(len(digit), np.uint64(pow(int(_ODD), -1, 1 << 64))))
        window = (total[at + least] - total[at]) * back[at]
        order = np.argsort(window)
        equal = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order] = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        owner, offset, at = owner[twice], offset[twice], at[twice]
    if not len(at):
        return at, at, at, at
    left = np.where(offset > 0, joined[np.maximum(at - 1, 0)].astype(np.int64), -1)
    length = sizes[owner] - offset
    eight = joined[: len(joined) - 7]  # the eight bytes from each place on as one number
    for k in range(1, 8):
        eight = eight << np.uint64(8) | joined[k : len(joined) - 7 + k]
    masks = np.array([0, *[(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 8)], (1 << 64) - 1], np.uint64)
    words = [eight[np.minimum(at + k, len(eight) - 1)] & masks[np.clip(length - k, 0, 8)] for k in range(0, wide, 8)]
    order = np.lexsort(words[::-1])
    owner, offset, left, length = owner[order], offset[order], left[order], length[order]
    common, rest, same = np.zeros(len(owner), np.int64), np.zeros(len(owner) - 1, np.uint64), np.ones(len(owner) - 1, bool)
    for w in words:
        x = w[order]
        x = np.where(same, x[1:] ^ x[:-1], 0)
        rest = np.where(x != 0, x, rest)  # of the first words that differ
        same &= x == 0
        common[:-1] += 8 * same
    for k in range(1, 8):
        common[:-1] += (rest < np.uint64(1 << 8 * k)) & ~same
    common[:-1] = np.minimum(common[:-1], np.minimum(length[1:], length[:-1]))
    return owner, offset, common, left


def maximal_repeats(common: np.ndarray, left: np.ndarray, least: int = SPAN) -> Iterator[tuple[int, int, int]]:
    """``(length, first, last)`` of the intervals of the suffix array that are maximal repeats of ``least`` bytes or more.

    A stack holds the open intervals of the common-prefix tree with the one byte to the left of all their suffixes, or -1
    where it differs; an interval that closes with -1 can't be extended to the left.
    """
    stack: list[list[int]] = []
    inside = np.flatnonzero((common >= least) | (np.concatenate(([0], common[:-1])) >= least))
    for i, now, byte in zip(inside.tolist(), common[inside].tolist(), left[inside].tolist()):
        begin = i
        while stack and stack[-1][0] > now:
            length, begin, seen = stack.pop()
            byte = seen if seen == byte else -1
            if byte < 0:
                yield length, begin, i
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else -1
            else:
                stack.append([now, begin, byte])


def _repeated(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows ``part, probe, blob`` of the occurrences of maximal repeats that have an earlier document."""
    for frame in whole_groups(batches, "key", at_least=BATCH):
        owner, offset, common, left = suffix_array(frame["bytes"].tolist())
        doc, start, tag = frame["doc_id"].to_numpy()[owner], frame["start"].to_numpy()[owner] + offset, frame["tag"].to_numpy()[owner]
        docs, starts, lengths, tags = [], [], [], []
        for length, a, b in maximal_repeats(common, left):
            some = doc[a : b + 1]
            late = np.flatnonzero(some > some.min())
            if len(late):
                docs.append(some[late])
                starts.append(start[a : b + 1][late])
                lengths.append(np.full(len(late), length))
                tags.append(tag[a : b + 1][late])
        if docs:
            yield _marks(np.concatenate(docs), tuple(map(np.concatenate, (starts, lengths, tags))), False, parts)


MARKS = "part int, probe boolean, blob binary"


def with_tag(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a number that tells different texts of one id apart, 0 where the id has only one."""
    key, mark = F.col(id_col).cast("long"), F.xxhash64(raw(text_col))
    several = cut(docs.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("id"))
    if several.isEmpty():
        return docs.withColumn(name, F.lit(0))
    (other,) = fresh(docs, "_several")
    both = docs.join(several.withColumnRenamed("id", other), key == F.col(other), "left")
    return both.withColumn(name, F.when(F.col(other).isNotNull(), mark.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).otherwise(0)).drop(other)


def tagged(rows: DataFrame, tag: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, raw, tag`` of rows ``with_tag``."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw"), F.col(tag).alias("tag"))


def spans(texts: DataFrame) -> DataFrame:
    """``doc_id, spans`` of ``tagged`` texts: for each id with repeated passages, (start, length, tag) as 32-bit numbers; they may overlap."""
    parts = partitions(texts)
    entries = texts.where("doc_id is not null").mapInArrow(lambda b: _entries(b, parts), "part int, known boolean, blob binary")
    dealt = lambda df, key: df.repartition(parts, key).sortWithinPartitions(key)
    together = lambda df, name: dealt(df, "part").mapInArrow(_gathered, "doc_id long, pairs binary").withColumnRenamed("pairs", name)
    marks = cut(dealt(entries, "part").mapInArrow(lambda b: _matched(b, parts), MARKS))
    asked = together(marks.where("probe"), "asked")
    fetched = texts.join(asked, "doc_id", "left").select("doc_id", "raw", "tag", "asked").mapInArrow(_fetch, "key long, bytes binary, doc_id long, start int, tag int")
    found = dealt(fetched, "key").mapInArrow(lambda b: _repeated(b, parts), MARKS)
    return together(marks.where("not probe").unionByName(found), "spans")


def _kept(text: bytes, pairs: bytes | None, tag: int) -> tuple[bytes, int, int]:
    """The text without its spans, and how many bytes and maximal runs go."""
    if pairs is None or not len(text):
        return text, 0, 0
    x = np.frombuffer(pairs, np.int32).reshape(-1, 3)
    x = x[x[:, 2] == tag]
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, np.minimum(x[:, 0], len(text)), 1)
    np.add.at(edge, np.minimum(x[:, 0] + x[:, 1], len(text)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _digest(text: pd.Series, pairs: pd.Series, tag: pd.Series) -> pd.DataFrame:
    rows = [_kept(*row) for row in zip(text, pairs, tag)]
    return pd.DataFrame({"n_removed": [r[1] for r in rows], "n_spans": [r[2] for r in rows], "kept_sha256": [hashlib.sha256(r[0]).hexdigest() for r in rows]})


def _cleaned(text: pd.Series, pairs: pd.Series, tag: pd.Series) -> pd.Series:
    return pd.Series([_kept(*row)[0].decode("utf-8", "ignore") for row in zip(text, pairs, tag)], dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; characters that a cut leaves incomplete go as well."""
    key, marks, tag = fresh(docs, "_id", "_spans", "_tag")
    rows = with_tag(docs, tag, id_col, text_col)
    found = spans(tagged(rows, tag, id_col, text_col)).withColumnRenamed("doc_id", key).withColumnRenamed("spans", marks)
    out = rows.join(found, F.col(id_col).cast("long") == F.col(key), "left")
    text = F.when(F.col(marks).isNull(), F.col(text_col)).otherwise(F.pandas_udf(_cleaned, "string")(raw(text_col), marks, tag))
    return out.withColumn(text_col, text).select(*docs.columns)


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tagged(with_tag(table(spark, sf_dir, "documents").select("doc_id", "text"), "tag"), "tag")
    out = texts.join(spans(texts), "doc_id", "left")
    return out.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.pandas_udf(_digest, "n_removed long, n_spans long, kept_sha256 string")("raw", "spans", "tag").alias("x")).select("doc_id", "n_bytes", "x.*")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; rows without an id stay whole, and an ``n_chars`` column follows the new text."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
