"""Substring dedup by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length, level
by level (:func:`lengths`; 4, 8, 13 words for windows of 13), until the wanted
length is reached or no candidate survives.  A candidate is a window of the
wanted length; on a shorter level it stands or falls with one of the windows of
that level in it, the one with the smallest hash.  Equal candidates choose equal
ones, so one that repeats in another document is never lost.  On the last level
candidates are compared by two independent hashes, 128 bits; where one starts in
a document of smaller id, its words go.  :func:`longest_repeats` doubles on, to
26, 52 and more words, until no candidate survives.

Exchange: documents are dealt once into chunks of a few MB by their id.  For a
level, a chunk sends each distinct window hash once, whatever number of its
documents hold it, as sorted runs to the hash buckets that it has hashes for; a
bucket answers one bit for each hash.  A passage in a third of all documents is
thus one hash a chunk, and no bucket grows by it.  Chunks and buckets grow in
number with the input, not in size.

Defined results: null and empty texts have no words; a null id counts as larger
than every id, so such rows lose what others hold and take nothing from others;
ids that are no integers are numbered in their order first; repeated rows of one
id keep their words, as no id is smaller than itself, and different rows of one
id likewise; rows of one id are dealt by their texts too, so that an id of many
rows is many chunks' work; no rows give none; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skyquilt.llm.words import Words, covered, mix, per_doc, windows
from skyquilt.session import cut, table

WINDOW = 13
#: The shortest level has at most so many words.
SHORTEST = 4
#: Bytes of text in a chunk, and for each bucket of hashes; at least so many buckets.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 12 << 20, 64
#: ``hashes`` of a run; on the last level also ``second`` hashes and ``least`` ids.  A negative
#: bucket is a note of a chunk to itself.
_SENT = "chunk int, bucket int, hashes binary, second binary, least binary"
_ANSWER = "chunk int, bucket int, flags binary"


def lengths(n: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths that double up to ``n``: the least that doubling takes to it, then twice each."""
    out = [n]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    level = [out[0]]
    while level[-1] < n:
        level.append(min(2 * level[-1], n))
    return level


class Chunk:
    """Documents of a chunk, in one order whatever way they came."""

    def __init__(self, rows: pa.Table):
        rows = rows.select([x for x in ("doc_id", "text", "__id") if x in rows.column_names]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows = rows
        self.ids = rows.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.words = Words(rows.column("text"))
        self.h = self.words.hashes()

    def starts(self, n: int) -> np.ndarray:
        return self.words.starts_of(n)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Document id of words."""
        return self.ids[np.searchsorted(self.words.first, at, "right") - 1]


def seeds(h: np.ndarray, at: np.ndarray, n: int, level: int) -> np.ndarray:
    """For windows of ``n`` words the smallest hash of their windows of ``level`` words; the lowest bit is free."""
    if not len(at):
        return np.zeros(0, np.uint64)
    low, span = windows(h, level), 1
    need = n - level + 1
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < need:
        low = np.minimum(low[: -(need - span)], low[need - span :])
    return low[at] & ~np.uint64(1)


def second_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Another 64 bits of the windows at these words, from other hashes of the words."""
    with np.errstate(over="ignore"):
        return windows(mix(h + np.uint64(0x5EED)), n)[at] if len(at) else np.zeros(0, np.uint64)


def _groups(values: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours and first hashes ascend, and where a new key begins in it."""
    order = np.argsort(values, kind="stable")
    if second is not None:
        same, other = values[order[1:]] == values[order[:-1]], second[order[1:]] != second[order[:-1]]
        if (same & other).any():
            order = np.lexsort((second, values))
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    if second is not None:
        new[1:] |= second[order[1:]] != second[order[:-1]]
    return order, new


class Distinct:
    """Distinct hashes of a chunk's windows, with smallest and largest document id."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, second: np.ndarray | None = None):
        order, new = _groups(values, second)
        begin = np.flatnonzero(new)
        self.values = values[order][begin]
        self.second = None if second is None else second[order][begin]
        self.of = np.empty(len(values), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(ids[order], begin) if len(begin) else ids[:0]
        self.most = np.maximum.reduceat(ids[order], begin) if len(begin) else ids[:0]

    def runs(self, buckets: int) -> list[tuple[int, int, int]]:
        """Bucket, begin and end of the values of each bucket that has some."""
        bucket = (self.values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        return list(zip(bucket[begin].tolist(), begin.tolist(), np.r_[begin[1:], len(bucket)].tolist()))


def _sent(chunk: int, d: Distinct, buckets: int) -> list[tuple]:
    if d.second is not None:
        return [(chunk, b, d.values[i:j].tobytes(), d.second[i:j].tobytes(), d.least[i:j].tobytes()) for b, i, j in d.runs(buckets)]
    hashes = d.values & ~np.uint64(1) | (d.least != d.most).astype(np.uint64)
    return [(chunk, b, hashes[i:j].tobytes(), b"", b"") for b, i, j in d.runs(buckets)]


def _note(chunk: int, flags: np.ndarray) -> tuple:
    """Flags of all windows of a chunk that come back to it with the answers."""
    return (chunk, -1 - chunk, np.packbits(flags).tobytes(), b"", b"")


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _flags(d: Distinct, answers: pa.Table, buckets: int) -> np.ndarray:
    """The bits that buckets answered, in the order of the distinct hashes."""
    cuts, out = {b: (i, j) for b, i, j in d.runs(buckets)}, np.zeros(len(d.values), bool)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist()):
        if b >= 0:
            i, j = cuts[b]
            out[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
    return out


def _noted(answers: pa.Table, count: int) -> np.ndarray:
    """The flags of the chunk's note; all are candidates before there is one."""
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist()):
        if b < 0:
            return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)
    return np.ones(count, bool)


def _answer(sent: pa.Table) -> pa.Table:
    """One bit for each hash of a bucket: without ids, whether two documents hold it; with ids,
    whether a document of smaller id than the chunk's smallest does.  Notes come back as they are."""
    bucket = sent.column("bucket")[0].as_py()
    if bucket < 0:
        return _table([(c, bucket, h) for c, h in zip(*(sent.column(x).to_pylist() for x in ("chunk", "hashes")))], _ANSWER)
    chunks, runs, second, least = (sent.column(x).to_pylist() for x in ("chunk", "hashes", "second", "least"))
    values = np.frombuffer(b"".join(runs), np.uint64)
    bits = np.zeros(len(values), bool)
    if least[0]:
        order, new = _groups(values, np.frombuffer(b"".join(second), np.uint64))
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        ids = np.frombuffer(b"".join(least), np.int64)
        bits[order] = np.minimum.reduceat(ids[order], begin)[group] < ids[order]
    else:
        values, several = values & ~np.uint64(1), (values & np.uint64(1)).astype(bool)
        order, new = _groups(values, None)
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        held = np.diff(np.r_[begin, len(values)]) > 1
        bits[order] = (held | np.logical_or.reduceat(several[order], begin))[group]
    ends = np.cumsum([len(r) // 8 for r in runs])
    return _table([(c, bucket, np.packbits(x).tobytes()) for c, x in zip(chunks, np.split(bits, ends[:-1]))], _ANSWER)


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id`` as an integer in the same order: what is no integer is numbered over the sorted distinct ids."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").alias("__id"))
    ids = docs.select(F.col("doc_id").alias("__own")).where("__own is not null").distinct().orderBy("__own")
    ids = cut(ids.select("__own", F.monotonically_increasing_id().alias("__number")))
    return docs.join(ids, F.col("doc_id") == F.col("__own"), "left").select(F.col("__number").alias("doc_id"), "text", F.col("doc_id").alias("__id"))


def _dealt(docs: DataFrame, text: str, doc: str, apart: bool = True) -> tuple[DataFrame, int]:
    """Documents with their chunk, and the number of buckets; ``apart``: rows of one id need not meet."""
    src = _numbered(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = -(-size // CHUNK_BYTES) or 1, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    spread = F.xxhash64("doc_id", "text") if apart else F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")))
    return src.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int")), buckets


def dedup_substrings(docs: DataFrame, n: int = WINDOW, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of windows of ``n`` words
    that start in a document of smaller id; what is left is joined by single spaces."""
    dealt, buckets = _dealt(docs, text, doc)
    levels = lengths(n)
    kind = dealt.schema["__id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def candidates(c: Chunk, level: int, at: np.ndarray) -> Distinct:
        if level < n:
            return Distinct(seeds(c.h, at, n, level), c.owner(at))
        return Distinct(windows(c.h, n)[at] if len(at) else np.zeros(0, np.uint64), c.owner(at), second_hashes(c.h, at, n))

    def first(rows: pa.Table) -> pa.Table:
        c = Chunk(rows)
        return _table(_sent(rows.column("chunk")[0].as_py(), candidates(c, levels[0], c.starts(n)), buckets), _SENT)

    def extend(before: int, level: int):
        """What repeats at the level before is sent with its windows of the next."""

        def extending(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _table([], _SENT)
            c, chunk = Chunk(rows), rows.column("chunk")[0].as_py()
            at = c.starts(n)
            may = _noted(answers, len(at))
            d = candidates(c, before, at[may])
            may[may] = _flags(d, answers, buckets)[d.of]
            return _table([*_sent(chunk, candidates(c, level, at[may]), buckets), _note(chunk, may)], _SENT)

        return extending

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in out})
        c = Chunk(rows)
        w, at = c.words, c.starts(n)
        at = at[_noted(answers, len(at))]
        d = candidates(c, n, at)
        gone = _flags(d, answers, buckets)[d.of] | (c.owner(at) > d.least[d.of])
        removed = covered(at[gone], n, len(c.h)) if len(c.h) else np.zeros(0, bool)
        n_removed = per_doc(removed, w.first)
        # the kept words of all documents, each followed by a space
        size = w.end - w.start
        kept = size[~removed]
        joined = np.full(int(kept.sum()) + len(kept), 0x20, np.uint8)
        joined[np.arange(int(kept.sum())) + np.repeat(np.arange(len(kept)), kept)] = w.data[w.solid][np.repeat(~removed, size)]
        ends = np.concatenate([[0], np.cumsum(kept + 1)])[np.cumsum(np.concatenate([[0], w.counts - n_removed]))]
        joined = joined.tobytes()
        texts = [joined[a : max(a, b - 1)] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return pa.table({"doc_id": c.rows.column("__id"), "n_words": pa.array(w.counts), "n_removed": pa.array(n_removed), "kept": pa.array(texts, pa.binary()).cast(pa.string())})

    by_chunk = dealt.groupBy("chunk")
    told = by_chunk.applyInArrow(first, _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    for before, level in zip(levels, levels[1:]):
        told = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(extend(before, level), _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(last, out)


def longest_repeats(docs: DataFrame, n: int = WINDOW, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, level, start, length``: runs of words covered by windows that two documents hold.

    Levels double from ``n`` words on; where both halves of a window repeat it is looked up, until a
    level has no candidates.  A run that lies within one of the next level is left out.
    """
    dealt, buckets = _dealt(docs, text, doc, False)
    by_chunk, base = dealt.groupBy("chunk"), lengths(n)[0]
    state_type = "chunk int, level int, bits binary"

    def halves(c: Chunk, at: np.ndarray, level: int, before: np.ndarray) -> np.ndarray:
        """Which windows of ``level`` words have both halves among the repeated ones before."""
        if level == n:
            return before
        held = np.zeros(len(c.h), bool)
        held[c.starts(level // 2)[before]] = True
        return held[at] & held[at + level // 2]

    def send(level: int):
        def sending(rows: pa.Table, state: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _table([], _SENT)
            c, chunk = Chunk(rows), rows.column("chunk")[0].as_py()
            at = c.starts(level)
            if level == n:
                d = Distinct(seeds(c.h, at, n, base), c.owner(at))
                may = _flags(d, state, buckets)[d.of]
            else:
                may = halves(c, at, level, _bits(state, len(c.starts(level // 2))))
            d = Distinct(windows(c.h, level)[at[may]] & ~np.uint64(1) if may.any() else np.zeros(0, np.uint64), c.owner(at[may]))
            return _table([*_sent(chunk, d, buckets), _note(chunk, may)], _SENT)

        return sending

    def keep(level: int):
        def keeping(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _table([], state_type)
            c = Chunk(rows)
            at = c.starts(level)
            may = _noted(answers, len(at))
            d = Distinct(windows(c.h, level)[at[may]] & ~np.uint64(1) if may.any() else np.zeros(0, np.uint64), c.owner(at[may]))
            out = np.zeros(len(at), bool)
            out[np.flatnonzero(may)] = _flags(d, answers, buckets)[d.of]
            return _table([(rows.column("chunk")[0].as_py(), level, np.packbits(out).tobytes())] if out.any() else [], state_type)

        return keeping

    def first(rows: pa.Table) -> pa.Table:
        c = Chunk(rows)
        at = c.starts(n)
        return _table(_sent(rows.column("chunk")[0].as_py(), Distinct(seeds(c.h, at, n, base), c.owner(at)), buckets), _SENT)

    level, found = n, []
    state = by_chunk.applyInArrow(first, _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    while True:
        told = by_chunk.cogroup(state.groupBy("chunk")).applyInArrow(send(level), _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER)
        state = cut(by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(keep(level), state_type))
        if state.isEmpty():
            break
        found.append(state)
        level *= 2

    def runs(rows: pa.Table, states: pa.Table) -> pa.Table:
        if not rows.num_rows or not states.num_rows:
            return empty
        c, out = Chunk(rows), []
        ids = c.rows.column("__id").to_pylist()
        deeper = np.zeros(len(c.h), bool)
        for level, bits in sorted(zip(states.column("level").to_pylist(), states.column("bits").to_pylist()), reverse=True):
            at = c.starts(level)
            at = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)]
            inside = covered(at, level, len(c.h))
            edge = np.diff(np.r_[False, inside, False].astype(np.int8))
            doc_start = np.zeros(len(c.h) + 1, bool)
            doc_start[c.words.first] = True
            begin = np.flatnonzero((edge[:-1] == 1) | (inside & doc_start[:-1]))
            end = np.flatnonzero((edge[1:] == -1) | (inside & doc_start[1:])) + 1
            for a, b in zip(begin, end):
                if not deeper[a:b].all():
                    k = int(np.searchsorted(c.words.first, a, "right") - 1)
                    out.append((ids[k], level, int(a - c.words.first[k]), int(b - a)))
            deeper |= inside
        ids, *others = zip(*out) if out else ([], [], [], [])
        return pa.table({"doc_id": pa.array(ids, rows.schema.field("__id").type), "level": pa.array(others[0], pa.int32()), "start": pa.array(others[1], pa.int64()), "length": pa.array(others[2], pa.int64())})

    kind = dealt.schema["__id"].dataType
    empty = pa.table({"doc_id": pa.array([], to_arrow_type(kind)), "level": pa.array([], pa.int32()), "start": pa.array([], pa.int64()), "length": pa.array([], pa.int64())})
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("level", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    states = reduce(DataFrame.unionByName, found) if found else state
    return by_chunk.cogroup(states.groupBy("chunk")).applyInArrow(runs, schema)


def _bits(state: pa.Table, count: int) -> np.ndarray:
    rows = state.column("bits").to_pylist()
    return np.unpackbits(np.frombuffer(rows[0], np.uint8), count=count).astype(bool) if rows else np.zeros(count, bool)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: By exact windows.  Documents of one id count together.
ORACLE = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT rid, doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM d),
g AS (
  SELECT rid, doc_id, pos, w, CASE WHEN lead(w, {WINDOW - 1}) OVER o IS NOT NULL THEN md5(concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, WINDOW))})) END AS win
  FROM t WINDOW o AS (PARTITION BY rid ORDER BY pos)),
m AS (SELECT *, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM g),
c AS (
  SELECT rid, pos, w, coalesce(max(CASE WHEN again THEN pos END) OVER (PARTITION BY rid ORDER BY pos) > pos - {WINDOW}, false) AS gone FROM m),
k AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY rid)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
