import random
import re
from collections import defaultdict

import numpy as np

from skyquilt.llm import substrings


def brute(rows, n):
    first = defaultdict(lambda: 1 << 70)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i: 1 << 65 if i is None else i
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first[g], key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < key(i):
                gone |= set(range(k, k + n))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def rows_of():
    rng = random.Random(6)
    vocab = [f"w{i}é" for i in range(60)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [text(rng.randint(8, 40)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 9))]
        rows.append((rng.choice([None, i, i, i]), rng.choice([" ", "\n", "\t "]).join(sum(parts, []))))
    rows += [rows[3]] * 3 + [(500 + i, rows[5][1]) for i in range(40)] + [(7, None), (8, ""), (None, " "), (9, "same " * 300), (10, "same " * 40)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, chunk string, bucket string, kept string")
    for chunk, bucket, n in ((1 << 22, 1 << 22, 13), (3000, 2000, 13), (5000, 700, 6)):
        monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(substrings, "LEAST_BUCKETS", 1 if bucket > 1000 else 64)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df, n).collect())
        assert got == brute(rows, n)


def brute_runs(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    out, level, deeper = [], n, [set() for _ in rows]
    levels = []
    while True:
        held = defaultdict(set)
        for (i, _), w in zip(rows, words):
            for k in range(len(w) - level + 1):
                held[tuple(w[k : k + level])].add(i)
        inside = [set() for _ in rows]
        for j, w in enumerate(words):
            for k in range(len(w) - level + 1):
                if len(held[tuple(w[k : k + level])]) > 1:
                    inside[j] |= set(range(k, k + level))
        if not any(inside):
            break
        levels.append((level, inside))
        level *= 2
    for level, inside in reversed(levels):
        for j, s in enumerate(inside):
            for a in sorted(s):
                if a - 1 not in s:
                    b = a
                    while b in s:
                        b += 1
                    if not set(range(a, b)) <= deeper[j]:
                        out.append((rows[j][0], level, a, b - a))
            deeper[j] = deeper[j] | s
    return sorted(out)


def test_longest_repeats(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(rows_of())][:150]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, n in ((1 << 22, 13), (4000, 6)):
        monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
        got = sorted((r.doc_id, r.level, r.start, r.length) for r in substrings.longest_repeats(df, n).collect())
        assert got == brute_runs(rows, n) and len({x[1] for x in got}) > 1
    assert substrings.longest_repeats(df.limit(0)).count() == 0


def test_lengths_double():
    assert substrings.lengths(13) == [4, 8, 13] and substrings.lengths(6) == [3, 6] and substrings.lengths(3) == [3] and substrings.lengths(50) == [4, 8, 16, 32, 50]


def test_collisions_of_one_hash(spark, monkeypatch):
    """With first hashes that agree for all windows the second ones still tell them apart."""
    rows = [(i, t) for i, (_, t) in enumerate(rows_of())][:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    d = substrings.Distinct(np.array([7, 7, 9, 7], np.uint64), np.array([4, 3, 2, 1]), np.array([1, 2, 1, 1], np.uint64))
    assert d.values.tolist() == [7, 7, 9] and d.least.tolist() == [1, 3, 2] and d.of.tolist() == [0, 1, 2, 0]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df, 5).collect())
    assert got == brute(rows, 5)


def test_ids_that_are_no_integers(spark):
    rows = [(f"id{i:03d}" if i % 9 else None, t) for i, (_, t) in enumerate(rows_of()[:60])]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    place = {x: i for i, x in enumerate(sorted(i for i, _ in rows if i))}
    want = brute([(place.get(i), t) for i, t in rows], 13)
    name = {str(v): k for k, v in place.items()} | {"None": "None"}
    assert got == sorted((name[i], *rest) for i, *rest in want)


def test_no_rows(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
