import random
import re
from collections import defaultdict

from skyquilt.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, start string, words string, target string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], SCHEMA)


def brute(rows, block=mixing.BLOCK):
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    src = defaultdict(int)
    for _, t, s in rows:
        src[s] += size(t)
    order = sorted((s for s in src if s is not None), key=lambda s: s.encode()) + [None] * (None in src)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(src.values())
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if each * weight[s] > 2 * src[s]]
        if not over:
            target |= {s: each * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * src[s]
            left -= target[s]
            free.remove(s)
    blocks = dict.fromkeys(order, 0)
    for _ in range(int(sum(target.values()) / block + 0.5)):
        best = max(order, key=lambda s: target[s] / (2 * blocks[s] + 1))
        blocks[best] += 1
    return src, target, blocks


def test_targets_and_quotas(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))), rng.choice(["s1", "s10", "s2", "Z", "é", None, "hot", "hot", "hot"])) for i in range(400)]
    src, target, blocks = brute(rows)
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == 400
    by_id = {r[0]: r for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id][2]
        assert r.source_size == src[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in src:
        assert taken[s] == min(blocks[s] * mixing.BLOCK, 2 * src[s])
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_levels(spark):
    rng = random.Random(11)
    for trial in range(4):
        names = [f"src{i}" for i in range(20)] + [None]
        rows = [(i, "w " * (rng.randint(50, 60) if trial < 2 else rng.choice([1, 40, 900])), rng.choice(names + ["src0"] * 10 * (trial % 2))) for i in range(300)]
        src, target, _ = brute(rows)
        got = {r.source: r for r in mixing.targets(mixing.sized(docs_of(spark, rows))).collect()}
        assert set(got) == set(src)
        for s in src:
            assert got[s].source_size == src[s] and abs(got[s].target - target[s]) < 1e-6 * max(1, target[s])
        assert abs(sum(r.target for r in got.values()) - 1.5 * sum(src.values())) < 1e-3


def test_mixed_documents(spark):
    rows = [(i, "w " * 200, "a" if i % 3 else "b") for i in range(90)]
    got = mixing.mixed(docs_of(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "size", "start", "words", "target"]
    took = defaultdict(int)
    for r in got.collect():
        took[r.doc_id] += 1
    for r in mixing.mix(docs_of(spark, rows)).collect():
        assert took[r.doc_id] == int(r.taken / r["size"] + 0.5)


def test_shard_quotas_are_sainte_lague_awards(spark):
    votes = [("a", 1, 5300.0), ("b", 2, 2400.0), ("c", 3, 900.0), ("d", 4, 30.0)]
    goal = spark.createDataFrame([(s, p, v) for s, p, v in votes], "source string, place long, target double")
    got = {(r.shard, r.source): r.blocks for r in mixing.quotas(goal, 50, 5).collect()}
    n, awards = int(sum(v for *_, v in votes) / 50 + 0.5), []
    held = dict.fromkeys("abcd", 0)
    for _ in range(n):
        s = max(votes, key=lambda x: x[2] / (2 * held[x[0]] + 1))[0]
        held[s] += 1
        awards.append(s)
    for shard in range(5):
        part = awards[n * shard // 5 : n * (shard + 1) // 5]
        assert {s: got.get((shard, s), 0) for s in "abcd"} == {s: part.count(s) for s in "abcd"}


def test_order_of_rows_does_not_matter(spark):
    """Repeated and null ids, and texts of one id."""
    rng = random.Random(7)
    rows = [(rng.choice([None, None, 1, 2, i]), "w " * rng.choice([1, 30, 64, 100, 900]) + str(rng.randint(0, 40)), rng.choice("ab")) for i in range(200)]
    got = [sorted(map(str, mixing.mix(docs_of(spark, some).repartition(n)).collect())) for some, n in ((rows, 1), (rows[::-1], 3), (rng.sample(rows, len(rows)), 7))]
    assert got[0] == got[1] == got[2]


def test_shards_take_their_quotas(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice("abc")) for i in range(200)]
    src, target, _ = brute(rows)
    goal = mixing.targets(mixing.sized(docs_of(spark, rows)))
    quota = {(r.shard, r.source): r.blocks for r in mixing.quotas(goal).collect()}
    taken, source = defaultdict(int), {i: s for i, _, s in rows}
    for r in mixing.mix(docs_of(spark, rows)).collect():
        assert r.taken == sum(p.words for p in r.parts) and [p.shard for p in r.parts] == sorted({p.shard for p in r.parts})
        for p in r.parts:
            taken[p.shard, source[r.doc_id]] += p.words
    for key, n in quota.items():  # but for what ends at twice the source's size
        assert 0 <= n * mixing.BLOCK - taken[key] < mixing.BLOCK or key[0] == mixing.SHARDS - 1


def test_mixed_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " ", "b"), (4, "w " * 500, "a"), (4, "v " * 500, "a"), (None, "u " * 500, "b"), (5, "t " * 500, None), (5, "t " * 500, None)]
    got = [tuple(r)[:3] for r in mixing.mixed(docs_of(spark, rows)).collect()]
    assert set(got) <= set(rows[3:]) and max(got.count(r) for r in rows) <= 4
    assert mixing.mixed(docs_of(spark, rows[:3])).count() == 0 and mixing.mixed(docs_of(spark, rows).limit(0)).count() == 0


def test_edge_rows(spark):
    rows = [(None, "a b", None), (None, "a b", None), (1, None, "x"), (2, "", "x"), (3, "c " * 5000, "y")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(docs_of(spark, rows).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, None, "x")])).collect()] == [0]
