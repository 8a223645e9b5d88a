import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tersely.llm import repeats
from tersely.llm.repeats import maximal_repeats, op5_suffix_repeats, spans, suffix_array, tagged, with_tag, without_repeats


def slow(rows, span=50):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            first[w] = min(doc, first.get(w, doc))
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < doc:
                gone[i : i + span] = b"\1" * span
        n = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (sum(gone), n, bytes(c for c, g in zip(b, gone) if not g))
    return out


def cases():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé", k=rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (16, 20, 40, 100)]
    rows = [None, "", "short", "a" * 300, "a" * 49, "a" * 50, "ab" * 400, passages[0] * 3]
    for k in range(120):
        parts = [text(rng.randrange(3, 40)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append(rng.choice(["", " "]).join(parts))
    rows += rng.choices(rows, k=30)
    rows += [r[: len(r) // 2] + "X" + r[len(r) // 2 :] for r in rows[20:60]]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("hot, chunk", [(30_000, 2 << 20), (3, 700)])
def test_spans_match_brute_force(spark, monkeypatch, hot, chunk):
    rows = cases()
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, t, "raw") for i, t in rows], "doc_id long, text string, spans string").repartition(5)
    if hot == 3:  # workers import the module anew: run the steps here
        got = local(rows)
    else:
        got = {r.doc_id: r.spans for r in spans(tagged(with_tag(docs, "tag"), "tag")).collect()}
    want = slow(rows)
    for doc, text in rows:
        kept, n, k = repeats._kept((text or "").encode(), got.get(doc), 0)
        assert (n, k, kept) == (want[doc][0], want[doc][1], want[doc][2]), (doc, text)


def local(rows):
    """The same steps without Spark, in one task each."""
    texts = pa.record_batch({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "raw": pa.array([(t or "").encode() for _, t in rows], pa.binary()), "tag": pa.array([0] * len(rows), pa.int32())})
    entries = pa.Table.from_batches(repeats._entries([texts], 4)).sort_by("part").to_batches()
    together = lambda t: dict(zip(*pa.Table.from_batches(list(repeats._gathered(t.sort_by("part").to_batches()))).to_pydict().values()))
    marks = pa.Table.from_batches(repeats._matched(entries, 4))
    asked = together(marks.filter(marks["probe"]))
    joined = texts.append_column("asked", pa.array([asked.get(i) for i, _ in rows], pa.binary()))
    fetched = pa.Table.from_batches(repeats._fetch([joined])).sort_by("key").to_batches()
    found = pa.Table.from_batches(list(repeats._repeated(fetched, 4)))
    return together(pa.concat_tables([marks.filter(pc.invert(marks["probe"])), found]))


def test_maximal_repeats_of_one_string():
    text = b"xabcabcyabcabcz-abc"
    owner, offset, common, left = suffix_array([text], least=1)
    got = {(text[offset[a] : offset[a] + n], b - a + 1) for n, a, b in maximal_repeats(common, left, least=2)}
    want = set()
    for n in range(2, len(text)):
        for s in {text[i : i + n] for i in range(len(text) - n + 1)}:
            at = [i for i in range(len(text)) if text.startswith(s, i)]
            lefts, rights = {text[i - 1] if i else -i - 1 for i in at}, {text[i + n] if i + n < len(text) else -1 for i in at}
            if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                want.add((s, len(at)))
    assert got == want


def test_texts_are_cut(spark):
    passage = "0123456789" * 6
    docs = spark.createDataFrame([(1, passage, "a"), (2, "é" + passage + "ü", "b"), (None, passage, "c"), (4, None, "d")], "doc_id long, text string, _x string")
    got = {r["_x"]: r.text for r in without_repeats(docs).collect()}
    assert got == {"a": passage, "b": "éü", "c": passage, "d": None}
    assert without_repeats(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    passage, clean = "0123456789" * 8, "the quick brown fox jumps over the lazy dog and then it sleeps in the shade of a tree for a long, long while."
    rows = [(1, passage), (2, "lead " + passage + " tail"), (2, clean), (2, clean), (3, clean + "!"), (None, passage)]
    docs = spark.createDataFrame([(*r, k, "s") for k, r in enumerate(rows)], "doc_id long, text string, _id int, _spans string")
    got = {r["_id"]: r.text for r in without_repeats(docs).collect()}
    assert got == {0: passage, 1: "lead  tail", 2: clean, 3: clean, 4: "!", 5: passage}
    stage = repeats.repeats_stage(spark, docs, "")
    assert stage.columns == docs.columns and {r["_id"]: r.text for r in stage.collect()} == got


def test_query_matches_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = slow(rows)
    got = op5_suffix_repeats(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    for r in got.collect():
        removed, runs, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (removed, runs, hashlib.sha256(kept).hexdigest())
