"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy over slices of documents; trees
are grown on their quantile bins from a bounded sample of labelled documents,
then flattened into arrays that all documents walk together.  Ids, languages,
sources and labels are never statistics.

Scale: ``TRAIN_ROWS`` labelled documents at most, those of smallest id hash,
train the model on the driver (28 numbers a row); that many label rows are also
the bound of the only broadcast.  Scoring reads each text once, without a shuffle.

Defined results: null and empty texts have statistics of zero and get the score
of those; a null id is never held out nor learnt from; a document with several
labels counts by their mean; of several texts with one labelled id one is learnt
from; null labels are none; without labels every score is 0.5; repeated rows have a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm.quality import QualityRules, measure
from skyquilt.llm.words import Words, mix, per_doc, slices
from skyquilt.session import table

#: Most labelled documents that a model learns from.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 60, 4, 64, 0.2, 1.0
_RULES = QualityRules()


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(bytes(range(48, 58)))
_SETS = {"upper": _UPPER, "digit": _DIGIT, "stop": _bytes(b".,;:?"), "shout": _bytes(b"!"), "bar": _bytes(b"|"), "symbol": _bytes(b"#*$%&<>_=+~^"), "quote": _bytes(b"\"'()[]{}"), "high": _bytes(bytes(range(128, 256)))}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    m = measure(texts, _RULES)
    w = Words(texts)
    n = np.maximum(w.counts, 1)
    size = np.maximum(np.diff(w.offsets), 1)
    letters = m["word_chars"] / n
    doc, h = w.doc, w.hashes()
    length = (w.end - w.start).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        return per_doc(flags, w.first) / n

    def counts(chars: np.ndarray) -> np.ndarray:
        total = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(chars[w.data], out=total[1:])
        return total

    totals = {k: counts(v) for k, v in _SETS.items()}
    lower = counts(_LOWER)
    inside = lambda t: t[w.end] - t[w.start]
    total_of = lambda t: np.diff(t[w.offsets])
    with np.errstate(over="ignore"):
        key = h + mix(np.arange(1, w.n + 1).astype(np.uint64))[doc]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    begin = np.flatnonzero(new)
    times = np.diff(np.r_[begin, len(key)])
    owner = doc[order[begin]] if len(begin) else begin
    distinct = np.bincount(owner, minlength=w.n)
    top = np.zeros(w.n)
    np.maximum.at(top, owner, times)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lines = total_of(counts(_bytes(b"\n"))) + 1
    upper, high = inside(totals["upper"]), inside(totals["high"])
    square = np.zeros(len(length) + 1)
    np.cumsum(length**2, out=square[1:])
    mean = per_doc(length.astype(np.int64), w.first) / n
    spread = np.maximum((square[w.first[1:]] - square[w.first[:-1]]) / n - mean**2, 0)
    cols = [
        np.log1p(w.counts),
        letters,
        np.sqrt(spread),
        distinct / n,
        top / n,
        *(total_of(t) / size for t in totals.values()),
        total_of(totals["symbol"]) / n,
        total_of(totals["bar"]) / n,
        share((upper >= 2) & (inside(lower) == 0)),
        share(inside(totals["upper"]) == 1),
        share((inside(lower) + upper + high) == 0),
        share(length <= 3),
        share(length >= 12),
        share(again),
        np.log1p(lines),
        w.counts / lines,
        m["dup_line_chars"] / np.maximum(m["word_chars"], 1),
        *(m[f"dup_chars_{k}"] / np.maximum(m["word_chars"], 1) for k in sorted(_RULES.coverage)),
    ]
    return np.stack(cols, axis=1).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete trees in arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        for _ in range(DEPTH if len(self.leaf) else 0):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        total = self.start + self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1) if len(self.leaf) else np.full(len(x), self.start)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boost trees on quantile bins by Newton steps of the logistic loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    total, offset = np.full(len(y), start), np.arange(x.shape[1]) * BINS
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            nodes, low = 2**level, 2**level - 1
            cell = ((at - low)[:, None] * x.shape[1] * BINS + offset + binned).ravel()
            shape = (nodes, x.shape[1], BINS)
            g = np.bincount(cell, np.repeat(grad, x.shape[1]), nodes * x.shape[1] * BINS).reshape(shape).cumsum(axis=2)
            s = np.bincount(cell, np.repeat(hess, x.shape[1]), nodes * x.shape[1] * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_s = g[:, :, -1:], s[:, :, -1:]
            gain = g**2 / (s + SMOOTH) + (all_g - g) ** 2 / (all_s - s + SMOOTH) - all_g**2 / (all_s + SMOOTH)
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(edges[f]):
                    feature[t, low + k], threshold[t, low + k] = f, edges[f][cut]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        at -= inner
        leaf[t] = RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + SMOOTH)
        total += leaf[t, at]
    return Trees(feature, threshold, leaf, start)


def held_out(doc: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """A model from at most ``rows`` labelled documents that are not held out."""
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull() & ~held_out(doc)).groupBy(F.col(doc).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    names = [f"x{k}" for k in range(statistics(pa.array([""])).shape[1])]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *map(pa.array, x.T)], names=["label", "key", *names])

    source = docs.select(F.col(text).alias("text"), F.col(doc).alias("__key"))
    joined = source.join(F.broadcast(known), F.col("__key") == F.col("__id")).select("text", F.col("__label").alias("label"), F.xxhash64("__key").alias("key"))
    # one row a label, whatever repeats in documents: the text of smallest hash speaks for its id
    joined = joined.groupBy("label", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label", "key")
    got = joined.mapInArrow(describe, "label int, key long, " + ", ".join(f"{c} float" for c in names)).toArrow()
    x = np.stack([got.column(c).to_numpy() for c in names], axis=1)
    order = np.argsort(got.column("key").to_numpy(), kind="stable")
    return fit(x[order], got.column("label").to_numpy().astype(float)[order])


def classify(docs: DataFrame, model: Trees, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of each row."""
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], names=["doc_id", "score"])

    return src.mapInArrow(score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
