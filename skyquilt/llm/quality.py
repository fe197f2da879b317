"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over whole slices
of documents, tell which words lie in n-grams that a text holds twice or more;
the characters of those words, and of repeated lines, against all characters of
words give the verdict.  Lengths are taken in ascending order, and only places
where the shorter n-gram repeats are looked at again.

Defined results: null text has no words and fails the base rules, as any text
of under 20 words does; null ids and repeated rows are judged row by row; extra
columns, whatever their names, pass through :func:`quality_filter` untouched.
No shuffle: every decision needs one document only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyquilt.llm.words import Words, covered, mix, per_doc, slices, spans, whole, windows
from skyquilt.session import table


@dataclass(frozen=True)
class QualityRules:
    """Limits, as percentages of characters of words unless they say otherwise."""

    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    #: n-gram length -> most percent of characters inside n-grams found twice or more
    coverage: dict[int, int] = field(default_factory=lambda: {4: 60, 6: 40, 8: 30, 10: 25})
    line_percent: int = 30


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(key: np.ndarray) -> np.ndarray:
    """Which elements have an equal one."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(texts: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text."""
    w = Words(texts)
    doc = w.doc
    salt = mix(np.arange(1, w.n + 1).astype(np.uint64))
    letters = (w.data & 0xC0) != 0x80
    chars = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(letters & w.solid, out=chars[1:])
    word_chars = chars[w.end] - chars[w.start]
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOL[w.data], out=symbols[1:])
    out = {"n_words": w.counts, "word_chars": per_doc(word_chars, w.first), "n_symbols": np.diff(symbols[w.offsets])}

    # lines: bounded by line feeds and by the texts' own ends
    cut = np.zeros(len(w.data) + 1, bool)
    cut[w.offsets] = True
    feed = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([feed + 1, w.offsets[:-1]]))
    line_doc = np.searchsorted(w.offsets, start, "right") - 1
    # a line feed at the end of a text starts an empty last line of that text, which has no word
    end = np.empty_like(start)
    if len(start):
        end[:-1] = start[1:] - (~cut[start[1:]] | (start[1:] == start[:-1])).astype(np.int64)
        end[-1] = len(w.data)
        end = np.maximum(np.minimum(end, w.offsets[np.minimum(line_doc + 1, w.n)]), start)
    begun = np.searchsorted(w.start, start)
    has_word = np.searchsorted(w.start, end) > begun
    start, end, line_doc = start[has_word], end[has_word], line_doc[has_word]
    # the line feed that ends a line may lie inside [start, end) only for lines cut by a text's end
    end = end - (w.data[end - 1] == 10).astype(np.int64) if len(end) else end
    with np.errstate(over="ignore"):
        key = spans(w.data, start, end) + salt[line_doc]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=w.n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[later], (chars[end] - chars[start])[later], w.n).astype(np.int64)

    h = w.hashes()
    lengths = sorted({*rules.coverage, rules.base_window})
    hot, before = np.ones(len(h), bool), 1
    for n in lengths:
        at = whole(w.first, n)
        at = at[hot[at] & hot[at + n - before]]
        with np.errstate(over="ignore"):
            twice = at[repeated(windows(h, n)[at] + salt[doc[at]])] if len(at) else at
        hot = np.zeros(len(h), bool)
        hot[twice] = True
        before = n
        inside = covered(twice, n, len(h)) if len(h) else np.zeros(0, bool)
        out[f"dup_chars_{n}"] = per_doc(word_chars * inside, w.first)
        if n == rules.base_window:
            out["n_repeat_words"] = per_doc(inside, w.first)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * out["n_words"])
    bad = 100 * out["dup_line_chars"] > rules.line_percent * out["word_chars"]
    for n, most in rules.coverage.items():
        bad |= 100 * out[f"dup_chars_{n}"] > most * out["word_chars"]
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def quality_scores(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with all counts and the verdict."""
    src = docs.select(*keep, text)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in sorted({*rules.coverage, rules.base_window}))]
    schema = T.StructType([*(src.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    keep, text_at = list(keep), len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([*keep, "text"]) if batch.schema.names[text_at] != "text" else batch
            for part in slices(batch):
                m = measure(part.column("text"), rules)
                cols = [part.column(i) for i in range(text_at)] + [pa.array(m[c].astype(np.int64)) for c in longs] + [pa.array(m["base_failed"]), pa.array(m["kept"])]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *longs, "base_failed", "kept"])

    return src.mapInArrow(score, schema)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            done = 0
            for part in slices(one):
                ok = measure(part.column(0), rules)["kept"]
                yield batch.slice(done, part.num_rows).filter(pa.array(ok))
                done += part.num_rows

    return docs.mapInArrow(keep, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_scores(table(spark, sf_dir, "documents")).select(*cols)


def _coverage_sql(n: int) -> str:
    after = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, n))
    return f"""c{n} AS (
  SELECT rid, count(*) AS n_in, sum(length(w)) AS chars FROM (
    SELECT rid, pos, w, max(CASE WHEN times > 1 THEN pos END) OVER (PARTITION BY rid ORDER BY pos) AS begun FROM (
      SELECT rid, pos, w, CASE WHEN g IS NOT NULL THEN count(*) OVER (PARTITION BY rid, g) END AS times FROM (
        SELECT rid, pos, w, CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN concat_ws(' ', w, {after}) END AS g
        FROM tok WINDOW o AS (PARTITION BY rid ORDER BY pos))))
  WHERE pos < begun + {n} GROUP BY rid)"""


def oracle(rules: QualityRules = QualityRules()) -> str:
    """The same rows in DuckDB SQL, by exact windows of words."""
    lengths = sorted({*rules.coverage, rules.base_window})
    bad = " OR ".join([f"100 * coalesce(c{n}.chars, 0) > {m} * word_chars" for n, m in sorted(rules.coverage.items())] + [f"100 * dup_line_chars > {rules.line_percent} * word_chars"])
    return f"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
tok AS (SELECT rid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM d),
l AS (
  SELECT rid, sum(again) AS n_dup_lines, sum(again * chars) AS dup_line_chars FROM (
    SELECT rid, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, (row_number() OVER (PARTITION BY rid, line) > 1)::int AS again
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]'))
  GROUP BY rid),
{", ".join(_coverage_sql(n) for n in lengths)},
m AS (
  SELECT d.rid, doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
         coalesce(c{rules.base_window}.n_in, 0)::bigint AS n_repeat_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN c{rules.base_window} ON c{rules.base_window}.rid = d.rid),
v AS (
  SELECT m.*, (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.base_percent} * n_words) AS base_failed, ({bad}) AS bad
  FROM m {" ".join(f"LEFT JOIN c{n} ON c{n}.rid = m.rid" for n in lengths)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad) AS kept FROM v"""
