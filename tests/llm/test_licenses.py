import random
import re

from tersely.llm.licenses import PHRASES, TEMPLATES, license_spans, licenses


def slow(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_phrases_match_brute_force(spark):
    rng = random.Random(1)
    pool = "gnu general public license apache cc by mit the of É x1 general-public, License. GNU".split()
    texts = [None, "", " .,", "CC-BY cc by cc", "x" * 200_000, "mit license " * 4000]
    texts += [" ".join(rng.choices(pool, k=rng.randrange(1, 200))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in licenses(docs).collect():
        assert tuple(r)[1:6] == slow(texts[r.doc_id]), texts[r.doc_id]
        assert 0 <= r.score <= 1
    assert licenses(docs.limit(0)).count() == 0


def test_templates_are_found(spark):
    rows = [(k, "lead in words " + t.replace("Software", "Material", 1) + " and after") for k, t in enumerate(TEMPLATES.values())]
    docs = spark.createDataFrame([*rows, (99, "nothing of the kind is granted to any")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses(docs).collect()}
    for k, label in enumerate(TEMPLATES):
        assert label in got[k].labels.split(",")
    assert got[99].labels == "" and got[99].score < 0.3
    spans = [r for r in license_spans(docs).collect() if r.doc_id == 3 and r.label == "bsd"]
    assert spans and spans[0].first_word == 3 and spans[0].covered > 0.9
