import hashlib
import random

import corpus_pipeline
from tersely.llm import mixing, simhash, toxicity
from tersely.llm.bpe import Coder, vocabulary

SF = "/root/testdata/sf0.001"


def test_rows_without_or_with_shared_ids(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    text = lambda: " ".join(rng.choices(words, k=80))
    made = lambda rows: spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    bad = " grumblefox"
    labelled = [(i, text() + (bad if i % 3 == 0 else "")) for i in range(120)]
    model = toxicity.fit(made(labelled), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int"))
    monkeypatch.setattr(toxicity, "trained", lambda spark, sf_dir: model)
    a, b, c, d, e = (text() for _ in range(5))
    assert pairs(toxicity.toxicity_stage(spark, made([(None, a + bad), (None, b), (1, c + bad), (1, d), (2, None)]), SF)) == pairs(made([(None, b), (1, d), (2, None)]))
    got = pairs(simhash.simhash_stage(spark, made([(None, a), (None, b), (None, b), (4, c), (4, c), (4, d), (5, d), (None, d), (3, e), (None, e)]), SF))
    assert got == pairs(made([(None, a), (None, b), (4, c), (4, d), (3, e)]))
    many = made([(None, text()) for _ in range(400)])
    assert 0.5 < mixing.mixing_stage(spark, many, SF).count() / 400 < 0.7


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = [before]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[4] == sizes[5] and all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[5] > 0
    with open(vocabulary(), encoding="utf-8") as f:
        coder = Coder(f.read())
    texts = {r.doc_id: r.text for r in last.collect()}
    for r in docs.collect():
        ids = next(coder.encode([texts[r.doc_id]]))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
