"""Nearest neighbours, fingerprints, language, raking and toxicity on small tables."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tersely.llm import ann, cws, langid, mixing, toxicity


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24))
    x[50:120] = x[3]  # one vector that many rows share
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, ""), (901, [0.0] * 24, ""), (902, [float("nan")] * 24, ""), (903, [1.0, None] * 12, ""), (904, [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, list_rows=40).collect()
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10].tolist()
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(want))
    assert hits >= 0.9 * 200
    assert ann.neighbours(df.limit(0), F.lit(True)).count() == 0


def test_recall_where_lists_stay_unvisited(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0, list_rows=100).collect():  # 60 lists, of which a query visits 42
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 60 and hits >= 0.95 * 600


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 30, 200]))) for _ in range(30)] + [None, "", "A a", "a  A"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = {r.doc_id: r.sig for r in cws.signatures(df, ["doc_id"], samples=64).collect()}
    errors = []
    for a, b in itertools.combinations(range(30), 2):
        x, y = Counter(texts[a].split()), Counter(texts[b].split())
        union = sum((x | y).values())
        if union:
            errors.append(sum(p == q for p, q in zip(sigs[a], sigs[b])) / 64 - sum((x & y).values()) / union)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    assert sigs[30] == sigs[31] and sigs[32] == sigs[33]


def test_default_fingerprints_tell_near_copies_from_unlike_texts(spark):
    rng = random.Random(11)
    pairs = []
    for k in range(120):
        words = [f"w{k}_{i}" for i in range(200)]
        changed = rng.choice([10, 16, 50])  # of 200 words: generalised Jaccard 0.90, 0.85 and 0.60
        pairs.append((words, words[changed:] + [f"v{k}_{i}" for i in range(changed)]))
    df = spark.createDataFrame([(2 * k + s, " ".join(p[s])) for k, p in enumerate(pairs) for s in (0, 1)], "doc_id long, text string")
    sigs = {r.doc_id: r.sig for r in cws.signatures(df, ["doc_id"]).collect()}
    errors = []
    for k, (a, b) in enumerate(pairs):
        x, y = set(a), set(b)
        errors.append(sum(p == q for p, q in zip(sigs[2 * k], sigs[2 * k + 1])) / len(sigs[2 * k]) - len(x & y) / len(x | y))
    assert all(len(s) == cws.SAMPLES for s in sigs.values())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05 and max(map(abs, errors)) < 0.18


def test_a_draw_of_a_fingerprint_is_one_hash(spark):
    texts = ["a " * 900, "a " * 300 + "b " * 10, "a", "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = cws.signatures(df, ["doc_id"])
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "sqrt(" not in plan and "ln(" not in plan
    sigs = {r.doc_id: r.sig for r in got.collect()}
    near = lambda a, b: sum(p == q for p, q in zip(sigs[a], sigs[b])) / cws.SAMPLES
    assert abs(near(0, 1) - 300 / 910) < 0.15 and near(1, 2) < 0.1 and near(3, 4) == 1 and near(2, 3) == 0


def test_next_texts(spark):
    texts = [None, "", "abc", "é" * 9, "abc"] + [f"t{i}" * i for i in range(40)]
    df = spark.createDataFrame([(i * 7 - 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.next_text for r in cws.with_next(df).collect()}
    assert got == {i * 7 - 3: texts[(i + 1) % len(texts)] or "" for i in range(len(texts))}
    assert cws.with_next(df.limit(0)).count() == 0
    assert {r.doc_id: r.next_text for r in cws.with_next(df.where("doc_id = 11")).collect()} == {11: "abc"}


def test_best_paths_match_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 5, 3, 0, 4])
    scores = rng.standard_normal((13, 3)).astype(np.float32) * 3
    path, at = langid.best_paths(scores, sizes, switch=2.0), 0
    for n in sizes:
        value = lambda p: sum(scores[at + t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert np.isclose(value(path[at : at + n].tolist()), value(best), atol=1e-4)
        at += n


def test_mixed_language_spans_and_scripts(spark):
    en, de, ru = "the cat sat on the mat and the dog ran", "der hund und die katze schlafen nicht auf dem sofa", "кошка и собака спят на диване"
    known = spark.createDataFrame([(k * 3 + i, t, lang) for k in range(40) for i, (lang, t) in enumerate((("en", en), ("de", de), ("ru", ru)))] + [(999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(known)
    asked = spark.createDataFrame([(1, en + ". " + de, "x"), (2, ru, ""), (3, None, ""), (4, "12 !?", ""), (5, "日本語", "")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in langid.languages(asked, model).collect()}
    assert [s["lang"] for s in got[1].spans] == ["en", "de"] and got[2].lang_pred == "ru"
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[4].score == 0
    assert got[5].lang_pred in ("en", "de", "ru") and got[5].score == 0
    assert langid.fit(known.limit(0)) is None and langid.languages(asked, None).where("lang_pred <> 'und'").count() == 0


def test_raked_weights_match_every_margin(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 50)), rng.choice("aaab") if i else None, rng.choice(["en", "de"]), i) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None, None, None, 0)], "doc_id long, text string, source string, lang string, n_tokens long")
    cells = mixing.weighed(docs, ("source", "lang")).groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang")).agg(F.sum("_n_tokens").cast("double").alias("w"))
    targets = {m: mixing.tempered(cells, m) for m in ("source", "lang")}
    x = mixing.rake(cells, targets, 40)
    for m, t in targets.items():
        sums = {r[m]: r.s for r in x.groupBy(m).agg(F.sum("x").alias("s")).collect()}
        assert all(abs(sums[r[m]] - r.target) < 1e-3 for r in t.collect())
    out = mixing.probabilities(docs.drop("n_tokens"))
    assert out.count() == 301 and out.where("_p is null or _p < 0 or _p > 1").count() == 0
    assert mixing.probabilities(docs.limit(0)).count() == 0


def test_drawn_mix_meets_targets_and_budget(spark):
    rng = random.Random(9)
    # two thin sources and a rare topic that are to be copied
    rows = [(i, " ".join(["w"] * rng.randrange(20, 50)) + (" ?" if i % 40 == 0 else ""), "s1" if i % 50 == 0 else "s2" if i % 31 == 0 else "s0", rng.choice(["en", "de"])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    p = mixing.probabilities(docs).cache()
    total, most = p.agg(F.sum("_n_tokens"), F.max("_copies")).first()
    assert most > 1.5
    cells = p.groupBy(*[F.col(f"_{m}").alias(m) for m in mixing.MARGINS]).agg(F.sum("_n_tokens").cast("double").alias("w"))
    kept = mixing.weighed(mixing.mixing_stage(spark, docs, ""))
    for tokens, near in ((p.withColumn("t", F.col("_copies") * F.col("_n_tokens")), 0.002), (kept.withColumn("t", F.col("_n_tokens").cast("double")), 0.02)):
        n = tokens.agg(F.sum("t")).first()[0]
        assert abs(n / total - mixing.BUDGET) < near
        for m in mixing.MARGINS:
            got = {r[0]: r[1] / n for r in tokens.groupBy(f"_{m}").agg(F.sum("t")).collect()}
            assert all(abs(got[r[m]] - r.target) < near for r in mixing.tempered(cells, m).collect())


def slow_kernel(s, t, decay=toxicity.DECAY):
    total = 0.0
    for i in itertools.combinations(range(len(s)), 3):
        for j in itertools.combinations(range(len(t)), 3):
            if all(s[a] == t[b] and s[a] != "." for a, b in zip(i, j)):
                total += decay ** (i[2] - i[0] + j[2] - j[0])
    return total


def test_kernel_matches_enumeration():
    names = ["^banana$", "xidiotx", "i.d.iot", "^abc$", "^idiot$", "bandana", "missis.s", "^ab$"]
    features = toxicity.Features(names)
    rows = features.matrix(names)
    want = [[slow_kernel(s, t) / np.sqrt(slow_kernel(s, s) * slow_kernel(t, t)) for t in names] for s in names]
    assert np.allclose(rows @ rows.T, want, rtol=1e-4)
    found = toxicity.named(names)
    for k, row in enumerate(rows):
        assert np.allclose(toxicity.Machine(features, row, 0.5).values(found), np.array(want)[k] + 0.5, atol=1e-4)


def test_nystroem_map_keeps_the_kernel():
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abcdäé", k=rng.randrange(4, 9))) for _ in range(120)})
    mapped = toxicity.Map(names[:60])
    assert np.allclose(mapped.gram, mapped.gram.T) and np.linalg.eigvalsh(mapped.gram).min() > -1e-9 and np.allclose(np.diag(mapped.gram), 1)
    x = mapped(names)
    assert np.allclose(x[:60] @ x[:60].T, mapped.gram, atol=1e-4)
    w = np.array([rng.gauss(0, 1) for _ in range(x.shape[1])])  # the folded machine gives the mapped values
    assert np.allclose(mapped.machine(w, 0.1).values(toxicity.named(names)), x @ w + 0.1, atol=1e-3)


def test_fitting_and_scoring_see_the_same_windows():
    texts = pa.array(["an i d i o t an IDIOT. s-c-u-m", "", None, "x " * 3, "disgusting " * 2, "1 2 3 4 5", "İ ǅx 日本語"])
    kinds, text, which = toxicity.windows_of(texts)
    names = [{n for n, t in zip(kinds.take(which).names(), text) if t == k} for k in range(len(texts))]
    assert names[0] == {"^an$", "^i.d.i.o.t$", "^idiot$", "^s.c.u.m$"} and not names[1] and not names[2] and not names[5]
    assert names[3] == set() and names[4] == {"^disgust", "disgusti", "isgustin", "sgusting", "gusting$"}
    machine = toxicity.Machine(f := toxicity.Features(["^idiot$", "^scum$"]), f.matrix(["^idiot$"])[0], 0.0)
    value = toxicity.highest(texts, machine)
    want = [max((machine.values(toxicity.named(sorted(n)))), default=np.nan) if n else np.nan for n in names]
    assert np.allclose(value, want, equal_nan=True, atol=1e-5)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    machine = toxicity.trained(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(toxicity.bucket("doc_id", 5) == 0)
    known = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.toxicity(docs, machine).join(known, "doc_id").collect()
    up, down = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    # over a third of this table's toxic labels stand on texts without any insult, which no text model can tell
    assert (up[:, None] > down).mean() > 0.8 and (down >= 0.5).mean() < 0.01 and (up >= 0.5).mean() > 0.58
    insults = "clown idiot worthless pathetic disgusting stupid".split()
    for change in (lambda w: w, lambda w: w[:2] + "." + w[2:], lambda w: w[0] + "-" + w[1:3] + "*" + w[3:], ".".join, " ".join):
        found = spark.createDataFrame([(k, f"und the {change(w)} of") for k, w in enumerate(insults)], "doc_id long, text string")
        assert toxicity.toxicity(found, machine).where("score >= 0.5").count() == len(insults)


def test_gapped_insults_are_found(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrst", k=rng.randrange(2, 8))) for _ in range(400)]
    text = lambda: " ".join(rng.choices(words, k=60))
    rows = [(i, text() + (" grumblefox " if i % 3 == 0 else " ") + text(), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = [(1, text() + " grumble.fox, " + text()), (2, text()), (3, None), (4, ""), (5, "g r u m b l e f o x " + text()), (6, "x" * 50_000 + "grumblefox"), (7, text() + " GRUMBLEFOXES")]
    asked = spark.createDataFrame([(*t, 1) for t in tests], "doc_id long, text string, score int")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.toxicity(asked, model).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: True}
    assert toxicity.fit(docs.limit(0), labels) is None


def test_fingerprint_query_and_null_ids(spark):
    got = {r.doc_id: r for r in cws.op6_weighted_sampling(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids, errors = sorted(texts), []
    words = lambda t: Counter(w for w in re.split("[\\x09-\\x0d\\x20]+", t.lower()) if w)
    for i, k in enumerate(ids):
        text, after = texts[k], texts[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[k].near_edited), (after, got[k].near_next)):
            x, y = words(text), words(other)
            union = sum((x | y).values())
            errors.append(near - (sum((x & y).values()) / union if union else 1.0))
        assert (got[k].fingerprint == got[k].edited_fingerprint) == (got[k].near_edited == 1)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    df = spark.createDataFrame([(None, "a"), (5, "b"), (None, "c"), (9, "d")], "doc_id long, text string")
    nexts = sorted((r.doc_id or 0, r.text, r.next_text) for r in cws.with_next(df).collect())
    assert nexts == [(0, "a", "c"), (0, "c", "b"), (5, "b", "d"), (9, "d", "a")]


def test_most_products_of_the_scan_are_skipped():
    rng = np.random.default_rng(5)
    x = 2 * rng.standard_normal((40, 64))[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 64))
    turned = x @ np.linalg.qr(rng.standard_normal((64, 64)))[0]
    tile, asked = ann.Tile.of(np.arange(4000), turned), np.arange(0, 4000, 200)
    blocks = len(tile.blocks)
    exact = [np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11] for q in asked]
    kth = np.array([((x[e[-1]] - x[q]) ** 2).sum() for q, e in zip(asked, exact)])
    for top, most in ((np.full(len(asked), np.inf), 0.6), (kth * 1.1, 0.55)):  # without a bound from another list, and with one
        query, row, work = ann.scan(asked, turned[asked], top, tile, 10)
        assert work < most * len(asked) * 4000 * blocks
        found = [set(row[query == k]) for k in range(len(asked))]
        assert sum(len(set(e) & f) for e, f in zip(exact, found)) >= 0.95 * 10 * len(asked)


def test_recall_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    got = ann.op1_adaptive_scan(spark, sf).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - rows[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(want & {r.vec_id for r in got if r.query_id == q}), total + 10
    assert hits >= 0.9 * total


def test_mixing_stage_keeps_columns_with_any_name(spark):
    rows = [(i, f"some words number {i} " * 5, "en", f"s{i % 3}", 1.0, "a", 3, 4, 5) for i in range(60)] + [(None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _p double, _source string, __k int, _n_tokens int, _copies int")
    got = mixing.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns and 0 < got.count() <= 120 and got.where("_source <> 'a'").count() == 0
    assert mixing.mixing_stage(spark, docs.limit(0), "").count() == 0


def test_language_query_on_odd_texts(spark, tmp_path):
    words = {"en": "the and of with this that have from".split(), "fr": "les des une dans avec pour être où".split()}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    rows += [(900, None, None), (901, "", "en"), (902, "\u0301 \u0302\u0303", "en"), (903, "12 -- 34", None), (904, "the \u0301 and of", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op7_language_viterbi(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903)) and got[904].lang_pred == "en"
    held = [got[i].lang_pred == lang for i, _, lang in rows[:200] if got[i].held_out]
    assert held and all(held)


def test_language_counts_take_bounded_memory():
    rng = random.Random(8)
    words = ["a", "é", "日本", *("".join(rng.choices("abcdefgé", k=rng.randrange(2, 12))) for _ in range(3000))]
    batch = pa.record_batch({"lang": ["en", "de"] * 600, "text": [" ".join(rng.choices(words, k=600)) for _ in range(1200)]})
    tracemalloc.start()
    got = {(r["lang"], r["bucket"]): r["n"] for part in langid._count([batch]) for r in part.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * batch.nbytes
    want = Counter()
    for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
        want.update((lang, w) for w in text.split())
    grams = {lang: sum(n * (len(w.encode()) + 2 - k) for (at, w), n in want.items() if at == lang for k in range(4) if len(w.encode()) + 2 > k) for lang in ("en", "de")}
    for lang in grams:
        assert sum(n for (at, k), n in got.items() if at == lang and k < langid.BUCKETS) == grams[lang]
        assert sum(n for (at, k), n in got.items() if at == lang and k >= langid.BUCKETS) == 600 * 600
    assert list(langid._count([pa.record_batch({"lang": ["en"], "text": ["a b 1"]})]))[0].num_rows > 0


def test_language_scores_do_not_depend_on_the_cuts(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(["de", "en"], rng.standard_normal((langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid._NAMES), 2), bool), 0)
    texts = pa.array(["a b", "", None, "longer words éé 日本語 a", "x" * 500])
    whole = langid.label(texts, model)
    for part in (1, 2, 7):
        monkeypatch.setattr(langid, "PART", part)
        assert all(np.array_equal(p, q) for p, q in zip(whole, langid.label(texts, model)))


def test_few_labels_still_tell(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeo" for c in "lmnrst"]
    prose = lambda: " ".join(rng.choices(words, k=15))
    rows = [(i, prose() + (" you stupid gorvax" if i < 3 else ""), int(i < 3)) for i in range(63)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[i] for i in range(3)) > max(got[i] for i in range(3, 63))
