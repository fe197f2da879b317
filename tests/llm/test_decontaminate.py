import random
import re

from skyquilt.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, n_found string, batch string"


def grams(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    out = []
    for i, q in items:
        q = grams(q)
        for d, t in docs:
            found = len(q & grams(t))
            if q and 5 * found >= 4 * len(q):
                out.append((str(d), str(i), len(q), found))
    return sorted(out)


def cases():
    rng = random.Random(8)
    vocab = [f"W{i}" for i in range(25)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 6, 8, 11, 12, 20, 33, 60, 70, 140] * 3)]
    docs = []
    for i in range(200):
        parts = [text(rng.randint(0, 300))]
        q = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            q[rng.randrange(len(q))] = "edited"
        docs.append((i, rng.choice([" ", "\n"]).join(parts[0] + q + text(3)).lower()))
    docs += [(None, " ".join(items[7][1])), (3, None), (3, ""), (4, " ".join(items[0][1])), (4, " ".join(items[1][1])), docs[0], docs[0]]
    items = [(i, " ".join(w)) for i, w in items]
    return docs, items + [(100, None), (101, ""), (None, items[9][1]), items[4]]


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    df = spark.createDataFrame([(*d, "1", "2", "3") for d in docs], SCHEMA)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [*dict.fromkeys(items)])
    assert len(want) > 60
    for block in (1 << 21, 150):
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
        got = sorted((str(r.doc_id), str(r.item_id), r.n_shingles, r.n_found) for r in decontaminate.leaks(df, it).collect())
        assert got == want
        kept = decontaminate.clean(df, it)
        assert kept.schema == df.schema
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if not brute([(d, t)], items))


def test_ids_of_other_types_and_a_very_long_text(spark):
    words = [f"w{i % 4999}" for i in range(300_000)]
    df = spark.createDataFrame([("d1", " ".join(words)), ("d2", "nothing of it at all here")], "name string, text string")
    it = spark.createDataFrame([("q", " ".join(words[1000:1040]))], "item string, text string")
    got = decontaminate.leaks(df, it.withColumnRenamed("item", "item_id"), doc="name").collect()
    assert [tuple(r) for r in got] == [("d1", "q", 36, 36)]


def test_empty_tables(spark):
    docs, items = cases()
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(df.limit(0), it).count() == 0
    assert decontaminate.leaks(df, it.limit(0)).count() == 0
    assert decontaminate.clean(df, it.limit(0)).count() == len(docs)
