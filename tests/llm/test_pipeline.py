import os
from collections import Counter

import pytest

import corpus_pipeline
from skyquilt.llm.quality import QualityRules
from tests.llm import test_decontaminate, test_mixing, test_quality, test_simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    columns, rows = docs.columns, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, DATA))
        got = out.collect()
        if name == "quality_rules":
            rows = [r for r in rows if test_quality.brute(r[1], QualityRules())["kept"]]
        elif name == "near_duplicates":
            near = corpus_pipeline.NEAR
            root = test_simhash.brute_components([test_simhash.brute_fingerprint(t, near["shingle"]) for _, t, _ in rows], near["distance"], test_simhash.brute_sets([t for _, t, _ in rows]))
            least = {}
            for (i, *_), c in zip(rows, root):
                least[c] = min(i, least.get(c, i))
            rows = [r for r in rows if r[0] in least.values()]
        elif name == "decontamination":
            leaked = {x[0] for x in test_decontaminate.brute([(i, t) for i, t, _ in rows], items)}
            assert leaked
            rows = [r for r in rows if str(r[0]) not in leaked]
        elif name == "mixing":
            src, _, blocks = test_mixing.brute(rows)
            mixed = Counter()
            for r in got:
                mixed[r.source] += len(r.text.split())
            for s in src:  # whole copies: at most one document away from the words of the blocks
                longest = max(len(t.split()) for _, t, x in rows if x == s)
                assert abs(mixed[s] - min(blocks[s] * 64, 2 * src[s])) <= longest
            assert max(Counter(r.doc_id for r in got).values()) <= 2
            rows = [(r.doc_id, r.text, r.source) for r in got]
        else:
            assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and {"shard", "slot"} <= set(out.columns)
            break
        assert out.columns == columns and sorted(r.doc_id for r in got) == sorted(r[0] for r in rows), name
        docs = out
    assert corpus_pipeline.run(spark, DATA).count() == len(rows)


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows and ids, long texts, clashing names, and no rows at all."""
    prose = lambda k: " ".join(f"word{(7 * k + i * i) % 997}" for i in range(40 + k))
    rows = [(i if i % 5 else None, prose(i), ["en", None][i % 2], ["s", None, "t"][i % 3], "r") for i in range(40)]
    rows += [rows[1], rows[1], (1, prose(77), "en", "s", "r"), (50, None, "en", "s", "r"), (51, "", None, None, None), (None, None, None, None, None), (52, prose(0) * 300, "en", "s", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        got = stage(spark, corpus_pipeline.stored(docs), DATA)
        if name == "sharding":
            assert got.count() == len(rows)
            continue
        assert got.columns == docs.columns, name
        kept = Counter(map(str, (tuple(r) for r in got.collect())))
        assert set(kept) <= {str(r) for r in rows}, name
        if name == "quality_rules":
            assert sum(kept.values()) >= 40 and str(rows[-2]) not in kept
        elif name == "near_duplicates":  # one row of what has no words, one of equal rows, the other text of id 1
            assert max(kept.values()) == 1 and kept[str(rows[42])] == 1 and sum(1 for r in rows[43:46] if str(r) in kept) == 1
        elif name == "decontamination":
            assert sum(kept.values()) == len(rows)
        else:
            assert kept[str(rows[43])] == 0 and sum(kept.values()) > 20
    assert corpus_pipeline.STAGES[-1][0] == "sharding"
