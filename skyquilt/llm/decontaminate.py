"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct five-word shingles,
powers of two a class.  An item's sketch is the shingles of smallest hash
(bottom-k MinHash), with k the least that a document holding 0.8 of the
shingles of any item of the class cannot miss entirely: a fifth of the class's
largest size, and one.  Documents with too few shingles for a class are not
candidates for it; the others are looked up in the sketches, whatever their
length, and candidates are verified by the exact share of the item's shingles
that the document holds.  No leak is missed, and none is reported unverified.

Words are lower-cased in A-Z.  A text of fewer than five words is one shingle,
so an item that short is found only where it is a whole document: two words in
a long text are no leak.

Scale: documents are never shuffled.  Items go to the executors in blocks of at
most ``BLOCK_SHINGLES`` shingles (16 MB of hashes); more items make more passes
over the documents, not larger ones.

Defined results: null and empty texts hold and leak nothing; ids keep their
types, null ids are reported as null; repeated items are one, repeated documents each have their
rows; no documents or no items give no rows; extra columns are ignored, or kept
by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquilt.llm.words import Words, slices, windows
from skyquilt.session import table

SHINGLE = 5
#: Least share of an item's shingles, as a fraction.
SHARE = (4, 5)
BLOCK_SHINGLES = 1 << 21
_FILTER_BITS = 22


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle; short texts have one."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at = w.starts_of(n)
    doc, value = [w.doc[at]], [windows(h, n)[at] if len(at) else np.zeros(0, np.uint64)]
    for k in range(1, n):
        short = np.flatnonzero(w.counts == k)
        if len(short):
            doc.append(short)
            value.append(windows(h, k)[w.first[short]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


@dataclass
class Table:
    """Items that share a hash: sorted hashes, and for each a run of items."""

    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, items: np.ndarray) -> Table:
        order = np.argsort(hashes, kind="stable")
        unique, first = np.unique(hashes[order], return_index=True)
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(unique >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(unique, np.append(first, len(hashes)), items[order], seen)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` and the items there."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[slot] == hashes[maybe]
        maybe, slot = maybe[hit], slot[hit]
        n = self.first[slot + 1] - self.first[slot]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(maybe, n), self.items[np.repeat(self.first[slot], n) + inner]


class Index:
    """Sketches and full shingle sets of a block of items."""

    def __init__(self, item: np.ndarray, hashes: np.ndarray, share: tuple[int, int] = SHARE):
        """``item``: number of the item of each of its distinct shingles."""
        self.share = share
        self.size = np.bincount(item) if len(item) else np.zeros(0, np.int64)
        order = np.lexsort((hashes, item))
        item, hashes = item[order], hashes[order]
        rank = np.arange(len(item)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        # of a class of up to 2**(c + 1) - 1 shingles, a holder misses this many at most
        top = (1 << np.frexp(np.maximum(self.size, 1).astype(float))[1].astype(np.int64)) - 1
        k = top * (share[1] - share[0]) // share[1] + 1
        sketch = rank < k[item]
        self.sketches = Table.of(hashes[sketch], item[sketch])
        self.full = Table.of(hashes, item)
        self.least = -(-((top + 1) // 2) * share[0] // share[1])

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and number of found shingles of every verified pair."""
        doc, h = shingles(texts)
        none = np.zeros(0, np.int64)
        at, item = self.sketches.find(h)
        if not len(at):
            return none, none, none
        fit = np.bincount(doc, minlength=len(texts))[doc[at]] >= self.least[item]
        stride = len(self.size)
        candidate = np.unique(doc[at[fit]] * stride + item[fit])
        rows = np.flatnonzero(np.isin(doc, candidate // stride))
        at, item = self.full.find(h[rows])
        at = rows[at]
        # distinct shingles of the item in the document
        order = np.lexsort((h[at], item, doc[at]))
        d, i, x = doc[at][order], item[order], h[at][order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (x[1:] != x[:-1])
        pair, found = np.unique((d * stride + i)[new], return_counts=True)
        keep = np.isin(pair, candidate) & (found * self.share[1] >= self.size[pair % stride] * self.share[0])
        return pair[keep] // stride, pair[keep] % stride, found[keep]


def blocks(items: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[tuple[pa.Array, Index]]:
    """Ids and index of each block of items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, h = shingles(part.column(1))
                lists = [np.unique(x) for x in np.split(h, np.searchsorted(doc, np.arange(1, part.num_rows)))] if part.num_rows else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))], names=["item_id", "shingles"])

    source = items.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    sets = source.mapInArrow(cut, T.StructType([source.schema["item_id"], T.StructField("shingles", T.ArrayType(T.LongType()))])).where(F.size("shingles") > 0).distinct()
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = -(-total // BLOCK_SHINGLES)
    for k in range(parts):
        rows = sets.where(F.pmod(F.hash("item_id", "shingles"), F.lit(parts)) == k).toArrow()
        lists = rows.column("shingles").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        yield rows.column("item_id").combine_chunks(), Index(np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy().view(np.uint64))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found`` of every document and item it holds."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_shingles", "n_found")]
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", items.schema[item].dataType), *counts])

    def one(ids: pa.Array, index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, index))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, index = sent.value
            for batch in batches:
                for part in slices(batch):
                    d, i, found = index.search(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), names.take(pa.array(i)), pa.array(index.size[i]), pa.array(found)], names=["doc_id", "item_id", "n_shingles", "n_found"])

        return source.mapInArrow(search, schema)

    found = [one(*block) for block in blocks(items, item)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index(text)
    for _, index in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for part in slices(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])):
                    ok = np.ones(part.num_rows, bool)
                    ok[sent.value.search(part.column(0))[0]] = False
                    yield batch.slice(done, part.num_rows).filter(pa.array(ok))
                    done += part.num_rows

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shingle_sql(table: str, key: str) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    after = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, SHINGLE))
    return f"""(SELECT DISTINCT {key}, g FROM (
    SELECT {key}, CASE WHEN lead(w, {SHINGLE - 1}) OVER o IS NOT NULL OR pos = 1 THEN concat_ws(' ', w, {after}) END AS g
    FROM (SELECT {key}, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM (SELECT {key}, {words} AS words FROM {table}))
    WINDOW o AS (PARTITION BY {key} ORDER BY pos)) WHERE g IS NOT NULL)"""


ORACLE = f"""WITH d AS {_shingle_sql('documents', 'doc_id')}, i AS {_shingle_sql('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found
FROM i JOIN d USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles
HAVING count(*) * {SHARE[1]} >= n_shingles * {SHARE[0]}"""
