import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from skyquilt.llm import simhash
from skyquilt.llm.xx import xxh64

SCHEMA = "doc_id long, text string, fp string, node string, anchor string"


def brute_fingerprint(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [w.lower() for w in words]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_sets(texts, words=5):
    split = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    return [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for w in split]


def brute_components(fp, distance=4, sets=None):
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance and (sets is None or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fp))]


def texts_of(rng):
    vocab = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 80, 300]))) for _ in range(60)]
    out = base + [b.upper() if i % 2 else b + "\n" for i, b in enumerate(base[:15])]
    for b in base * 3:
        w = b.split()
        if len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
            out.append("\t".join(w))
    return out + [None, "", " \n", "a", "a", "a b c"]


def test_fingerprints():
    texts = texts_of(random.Random(1))
    assert [int(x) for x in simhash.fingerprints(pa.array(texts, pa.string()))] == [brute_fingerprint(t) for t in texts]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def test_runs_of_shingles(monkeypatch):
    texts = [*texts_of(random.Random(5)), "v w x y z " * 900]
    whole = simhash.fingerprints(pa.array(texts, pa.string()))
    monkeypatch.setattr(simhash, "RUN", 37)
    assert (simhash.fingerprints(pa.array(texts, pa.string())) == whole).all()
    assert int(whole[-1]) == brute_fingerprint(texts[-1])


def test_xxh64():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    start = rng.integers(0, 9_000, 3_000)
    end = start + np.where(rng.random(3_000) < 0.01, rng.integers(4_000, 9_000, 3_000), rng.integers(0, 200, 3_000))
    raw = data.tobytes()
    assert [int(x) for x in xxh64(data, start, end)] == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(start, end)]


def test_walk_keeps_components():
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(8)]
    f = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)})
    home = [rng.random() < 0.3 for _ in f]
    u, v = simhash.walk(np.array([x for x, h in zip(f, home) if h], np.uint64), np.array([x for x, h in zip(f, home) if not h], np.uint64), 4)
    roots = []
    for links in ([(int(a), int(b)) for a, b in zip(u, v)], [(a, b) for a, h in zip(f, home) for b in f if h and a != b and (a ^ b).bit_count() <= 4]):
        root = {x: x for x in f}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        roots.append([find(x) for x in f])
    assert roots[0] == roots[1]


def test_pairs_meet_at_an_anchor():
    rng = np.random.default_rng(2)
    f = rng.integers(0, 1 << 63, 400, np.uint64)
    for segments in (3, 2):
        cells = simhash.cover(segments)
        for x in f[: 40 if segments == 2 else 400]:
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            y = x ^ np.uint64(sum(1 << int(b) for b in bits))
            met = False
            for s in cells:
                anchor, _ = s.visits(np.array([y]))
                home = s.home(s.value(np.array([x])))
                assert s.syndrome(home)[0] == 0 and np.bitwise_count(home ^ s.value(np.array([x])))[0] <= 1
                met |= bool(((home | np.uint64(s.number << 40)) == anchor).any())
            assert met


def test_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for f in fps[:100]:
        for _ in range(rng.randint(1, 4)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.append(f)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(1, 64, 6)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(fps)
    for segments, pairs, residents in ((3, 1 << 21, 1 << 14), (3, 500, 1 << 14), (3, 500, 20), (2, 1 << 21, 1 << 14)):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        monkeypatch.setattr(simhash, "RESIDENTS", residents)
        u, v = zip(*[(r.u, r.v) for r in simhash.links(df, segments).collect()])
        place = {f: i for i, f in enumerate(signed)}
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in zip(u, v):
            x, y = sorted((find(place[a]), find(place[b])))
            root[y] = x
        assert [find(i) for i in range(len(fps))] == want


def test_components_of_documents(spark):
    texts = texts_of(random.Random(9))
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_components([brute_fingerprint(t) for t in texts])
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "node", "anchor"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "q r s t u"), (5, "q r s t u"), (5, "q r s t u"), (None, "other words are here now")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()]
    assert [c for _, c in got].count(5) == 3 and [c for _, c in got].count(None) == 1
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_null_ids_link_others(spark):
    """What has no id of its own may lie between two that are too far apart."""
    df = spark.createDataFrame([("b", "255"), (None, "15"), ("a", "0")], "doc_id string, text string")
    fps = df.select(F.col("text").cast("long").alias("fp"))
    got = simhash.components(simhash.links(fps, 3)).collect()
    assert {r.root for r in got} == {0} and len(got) == 3


def test_one_row_of_each(spark):
    rows = [(1, "p q r s t", "x"), (5, "p q r s t", "x"), (5, "other words are here now", "x"), (7, "other words are here now", "y"), (7, "other words are here now", "y"), (None, "nobody knows its name at all", None), (None, "nobody knows its name at all", None), (9, "alone in the world it is", "z"), (9, "alone in the world it is", "z"), (None, "p q r s t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = simhash.one_of_each(df)
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[7]]))
    named = simhash.one_of_each(df.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("k1")), "k1", "name").collect()
    assert sorted(str(r.name) for r in named) == ["1", "5", "9", "None"]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_very_long_text(spark):
    words = [f"w{i % 977}" for i in range(400_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1]) + " end"), (3, "short one")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert got[1].fp & ((1 << 64) - 1) == brute_fingerprint(" ".join(words)) and got[2].component_id == 1 and got[3].component_id == 3


def test_one_of_each_text_that_is_alike(spark, monkeypatch):
    """Small blocks, so that components are dealt; near fingerprints alone do not make a group."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(7)
    texts = texts_of(rng)
    family = " ".join(f"w{rng.randrange(900)}" for _ in range(120)).split()
    for k in range(60):
        w = list(family)
        for _ in range(rng.choice([1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts + texts[::3])]
    fps, sets = [brute_fingerprint(t, 2) for _, t in rows], brute_sets([t for _, t in rows])
    near, alike = brute_components(fps, 12), brute_components(fps, 12, sets)
    assert len(set(near)) < len(set(alike)) < len(rows)
    least = {}
    for (i, _), c in zip(rows, alike):
        least[c] = min(i, least.get(c, i))
    docs = spark.createDataFrame(rows + rows[:40:7], "doc_id long, text string").repartition(5)
    got = simhash.one_of_each(docs, distance=12, segments=3, shingle=2, share=(4, 5)).collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())
