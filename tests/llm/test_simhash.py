import random
import re

import xxhash

from tersely.llm.simhash import links, near_duplicates


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=2):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 400]))) for _ in range(60)]
    texts = [None, "", " \t\n", "One", "one", "two Words", "x" * 100_000] + base
    for t in base[:40]:
        parts = t.split(" ")
        for k in range(4):
            parts = parts.copy()
            parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "One", "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == slow_components(fps)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_over_several_tiles(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(30):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = links(spark.createDataFrame(signed, "fp long"), tile=4).collect()
    root = {f[0]: f[0] for f in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        assert bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2
        root[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    want = slow_components({f[0]: f[0] % (1 << 64) for f in signed})
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert classes({f: find(f) for f in root}) == classes(want)
