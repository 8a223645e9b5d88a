import hashlib

import pytest

from tersely.llm.bpe import Coder, decode, encode, round_trip, vocabulary

TEXTS = ["", None, "  a\x1c b\x1f\x85c　 d\n\n e", "hello<|endoftext|>x", "<|endoftext|>", "a" * 1001, "I'll don't it's 'S  x ", "日本語テキスト 🎉🎉", "\u0000\u0001x​ y", "x²³ ½ ٣", "word " * 3000, " lead", "trail ", "a\n b", "a \nb"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())


def test_same_ids_as_the_library(library):
    with open(vocabulary(), encoding="utf-8") as f:
        coder = Coder(f.read())
    got = list(coder.encode(TEXTS))
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [coder.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_operators_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    back = {r.doc_id: r.text for r in decode(encode(docs, vocabulary()), vocabulary()).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in round_trip(docs, vocabulary()).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert round_trip(docs.limit(0), vocabulary()).count() == 0


def test_a_word_is_looked_up_once_and_the_store_may_empty(library, monkeypatch):
    with open(vocabulary(), encoding="utf-8") as f:
        coder = Coder(f.read())
    assert list(coder.chunks(["a b a", None, "b a"])) == [[[0, 1, 2], [], [3, 2]]]
    monkeypatch.setattr("tersely.llm.bpe.STORE", 0)
    monkeypatch.setattr("tersely.llm.bpe.CHUNK", 1)
    assert list(coder.encode(TEXTS * 2)) == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS * 2]
