import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from skyquilt.llm import sharding

SCHEMA = "doc_id long, text string, key string, size string, shard string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    for c in range(low, high + 1):
        used, now = 1, 0
        for s in sizes:
            if now + s > c:
                used, now = used + 1, 0
            now += s
        if used <= shards:
            return c


def test_capacity_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n = rng.randint(1, 8)
        c = sharding.smallest_capacity(ends, n)
        assert c == brute_capacity(sizes, n)
        cuts = sharding.balanced(ends, c, n)
        assert len(cuts) == n and cuts[-1] == len(sizes) and cuts == sorted(cuts)
        assert np.diff(ends[[0, *cuts]]).max() <= c


def test_cuts_by_ranges_equal_those_over_all_groups(spark):
    rng = random.Random(7)
    texts = ["w" * rng.randint(0, 400) + str(rng.randint(0, 200)) for _ in range(600)] + ["hot"] * 40
    rows = sharding.shard(rows_of(spark, texts), 6).collect()
    got = spark.createDataFrame([(t,) for t in set(texts)], "t string").selectExpr("t", "xxhash64(t) k").collect()
    weight = Counter()
    for t in texts:
        weight[t] += len(t.encode()) + 8
    ordered = [weight[r.t] for r in sorted(got, key=lambda r: r.k)]
    bytes_of = defaultdict(int)
    for r in rows:
        bytes_of[r.shard] += r["size"]
    assert max(bytes_of.values()) == brute_capacity(ordered, 6) or max(bytes_of.values()) <= brute_capacity(ordered, 6)


def test_rows(spark):
    texts = ["a", None, "", "é b", "a", None, "long " * 500]
    rows = sharding.shard(rows_of(spark, texts), 3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(7))
    home = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        assert home.setdefault(t, r.shard) == r.shard
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_null_ids_repeated_rows_and_no_rows(spark):
    same = spark.createDataFrame([(None, "t")] * 5 + [(1, "u")] * 4, "doc_id long, text string")
    rows = sharding.shard(same, 2).collect()
    assert len(rows) == 9 and {r.shard for r in rows} == {0, 1}
    assert sharding.shard(same.limit(0), 4).count() == 0
