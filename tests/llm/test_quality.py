import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from skyquilt.llm import quality

ODD = [None, "", " ", "\n", "a", "a\n", "\na", "a\n\na\na", "x y\nx y", "x y\n\n", "é é\né é\n", " a \n a ", "a\rb\x0bc\x1dd e", "\n\n", "q " * 50, "q\n" * 30, "###|| a"]
WORD = r"[^\x20\x09-\x0D]+"


def brute(text, rules):
    text = text or ""
    w = re.findall(WORD, text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, re.findall(WORD, line)))
            seen.add(line)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "dup_line_chars": dup_chars}
    bad = 100 * dup_chars > rules.line_percent * out["word_chars"]
    for n in {*rules.coverage, rules.base_window}:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        times, inside = Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                inside |= set(range(i, i + n))
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in inside)
        bad |= n in rules.coverage and 100 * out[f"dup_chars_{n}"] > rules.coverage[n] * out["word_chars"]
        if n == rules.base_window:
            out["n_repeat_words"] = len(inside)
    out["base_failed"] = len(w) < 20 or 100 * out["n_repeat_words"] > 30 * len(w)
    out["kept"] = not (out["base_failed"] or bad)
    return out


def texts():
    rng = random.Random(1)
    out = list(ODD)
    for _ in range(150):
        vocab = [f"w{i}" for i in range(rng.choice([2, 5, 40, 400]))]
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        out.append("".join(x + rng.choice(["\n", " ", "  ", "\t", " #"]) for x in w))
    return out


@pytest.mark.parametrize("rules", [quality.QualityRules(), quality.QualityRules(coverage={3: 20, 5: 10}, line_percent=5)])
def test_against_brute_force(rules):
    some = texts()
    for order in (some, some[::-1], some[:5] * 3):
        m = quality.measure(pa.array(order, pa.string()), rules)
        for i, t in enumerate(order):
            assert {k: m[k][i] for k in brute(t, rules)} == brute(t, rules), t


def test_rows_pass_through(spark):
    rows = [(i % 7 or None, t, "a", i, True) for i, t in enumerate(texts() + ["v" + " ".join(map(str, range(40000)))])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept long, base_failed boolean")
    got = quality.quality_filter(df)
    assert got.schema == df.schema
    want = [r for r in rows if brute(r[1], quality.QualityRules())["kept"]]
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in [df.sparkSession.createDataFrame(want, df.schema).collect()][0])
    scores = quality.quality_scores(df)
    assert scores.count() == len(rows) and quality.quality_scores(df.limit(0)).count() == 0
