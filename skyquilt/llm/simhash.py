"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into segments.  Fingerprints that differ in at most
``distance`` bits differ in at most ``distance // segments`` bits of one
segment at least.  On every segment the words of a covering code are anchors: a
Hamming code of radius 1 on its first bits, all values on the rest, so every
segment value has a home anchor within one bit.  A fingerprint goes to each
anchor within covering radius plus threshold; there it meets, of all residents
(those whose home it is), every one that is near.  Residents are compared with
visitors, 64 bits against 64 bits, so no link is missed and none is made up.

Scale: equal fingerprints are one, so copies cost nothing.  Comparisons return
a spanning forest of the links of an anchor instead of all pairs, and large
anchors are walked breadth first, so a group of near copies costs about its
size.  Anchors are met in a sorted stream: memory holds one anchor.  An anchor
with more than ``RESIDENTS`` residents is dealt into parts, each with a share
of the residents and all visitors, so that a large family is no single task's
work.  With three segments an anchor gets about 2.2e-4 of all distinct
fingerprints; from ``TWO_SEGMENTS`` of them on, two segments with 2**28 anchors
(344 copies each) keep anchors small instead.  Both find every link.
Components of the forest are found by :mod:`skyquilt.llm.components`.

:func:`one_of_each` may ask for a similarity as well.  Then only components of
several texts are looked at again, one row a text: two texts are linked if
their fingerprints are near and the exact Jaccard similarity of their sets of
five-word shingles is high enough.  Texts are walked breadth first and give a
forest too; a component of more than ``BLOCK`` texts is dealt into blocks, and
every two of them meet in a task, so a task holds two blocks at most.

Defined results: null and empty texts have fingerprint 0, linked like any
other; rows with a null id link like others and get the component of their
fingerprint, but give no component its name (null if no id is there); ids of
any type that Spark can order are kept as they are; repeated rows get a row
each; no rows give none; extra columns are ignored, or kept by
:func:`one_of_each`, which leaves one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquilt.llm.components import components
from skyquilt.llm.decontaminate import shingles
from skyquilt.llm.words import Words, slices
from skyquilt.llm.xx import xxh64
from skyquilt.session import cut, table

SHINGLE = 4
DISTANCE = 4
TWO_SEGMENTS = 1 << 26
#: Pairs compared at once; an anchor with more is walked breadth first.
PAIRS = 1 << 21
#: Shingles hashed at once, and most residents of an anchor that meet in one task.
RUN, RESIDENTS = 1 << 18, 1 << 14
#: Most texts of a component, and bytes of them, that one block holds.
BLOCK, BLOCK_BYTES = 512, 1 << 22


#: The bits of a byte, the highest first, as the bytes of one number: up to 255 such numbers add up without a carry.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def _ones(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each bit, the highest first, is set in consecutive groups of ``n`` hashes."""
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    start = np.repeat(np.cumsum(n) - n, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    parts = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_BITS[parts[:, k]], start) for k in range(8)], axis=1)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included."""
    w = Words(texts, lower=True)
    n = len(w.start)
    size = w.end - w.start
    # the words, each followed by a space
    joined = np.full(int(size.sum()) + n, 0x20, np.uint8)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(n), size)] = w.data[w.solid]
    count = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    first = np.zeros(w.n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    ones, out = np.zeros((w.n, 64), np.int64), np.zeros(w.n, np.uint64)
    for k in range(0, int(first[-1]), RUN):
        # the shingles k to end, of the texts low to high
        end = min(k + RUN, int(first[-1]))
        low, high = int(np.searchsorted(first, k, "right")) - 1, int(np.searchsorted(first, end))
        n = np.minimum(first[low + 1 : high + 1], end) - np.maximum(first[low:high], k)
        begin = np.arange(k, end) - np.repeat(first[low:high], n) + np.repeat(w.first[low:high], n)
        last = np.minimum(begin + shingle, np.repeat(w.first[low + 1 : high + 1], n))
        h = xxh64(joined, at[begin], at[last] - 1)
        some = np.flatnonzero(n)
        ones[low + some] += _ones(h, n[some])
    some = count > 0
    out[some] = np.packbits(2 * ones[some] > count[some][:, None], axis=1).view(">u8").ravel()
    return out


@dataclass(frozen=True)
class Segment:
    """Bits ``[shift, shift + width)``, a Hamming code on the lowest ``2**r - 1`` of them."""

    number: int
    shift: int
    width: int
    r: int
    threshold: int

    @cached_property
    def _checks(self) -> list[np.uint64]:
        """Parity check k covers the positions whose number has bit k."""
        return [np.uint64(sum(1 << (p - 1) for p in range(1, 1 << self.r) if p >> k & 1)) for k in range(self.r)]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, check in enumerate(self._checks):
            out |= (np.bitwise_count(x & check) & 1).astype(np.int64) << k
        return out

    @cached_property
    def _masks(self) -> list[np.ndarray]:
        """For each syndrome, the changes of up to radius + threshold bits that lead to an anchor."""
        masks: list[list[int]] = [[] for _ in range(1 << self.r)]
        for weight in range(1 + self.threshold + 1):
            for bits in combinations(range(self.width), weight):
                s = 0
                for b in bits:
                    s ^= b + 1 if b < (1 << self.r) - 1 else 0
                masks[s].append(sum(1 << b for b in bits))
        return [np.array(m, np.uint64) for m in masks]

    def value(self, f: np.ndarray) -> np.ndarray:
        return (f >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The anchor within one bit."""
        s = self.syndrome(x)
        return np.where(s > 0, x ^ (np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64)), x)

    def visits(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of anchors and the fingerprints that go there."""
        x = self.value(f)
        s = self.syndrome(x)
        anchors, who = [], []
        for k, masks in enumerate(self._masks):
            mine = s == k
            if mine.any():
                anchors.append((x[mine][:, None] ^ masks[None, :]).ravel())
                who.append(np.repeat(f[mine], len(masks)))
        return np.concatenate(anchors) | np.uint64(self.number << _SEGMENT), np.concatenate(who)


def cover(segments: int, distance: int = DISTANCE) -> list[Segment]:
    """Equal segments of 64 bits, each with the longest Hamming code that fits."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [Segment(k, a, b - a, (b - a + 1).bit_length() - 1, distance // segments) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every end but the smallest of its component to that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def walk(residents: np.ndarray, visitors: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, breadth first, of links that have a resident at one end: what is reached is
    compared with the residents not yet reached, and a resident with such visitors too."""
    us, vs = [], []
    while len(residents):
        queue, residents = [(residents[0], True)], residents[1:]
        while queue:
            q, home = queue.pop()
            near = np.bitwise_count(residents ^ q) <= distance
            found, residents = residents[near], residents[~near]
            queue += [(x, True) for x in found]
            if home and len(visitors):
                near = np.bitwise_count(visitors ^ q) <= distance
                more, visitors = visitors[near], visitors[~near]
                queue += [(x, False) for x in more]
                found = np.concatenate([found, more])
            us.append(found)
            vs.append(np.full(len(found), q))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


#: Places of the segment's number and of the part of a dealt anchor in an anchor's number.
_SEGMENT, _PART = 40, 44


def compare(anchor: np.ndarray, f: np.ndarray, own: np.ndarray, cells: list[Segment], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that are sorted by anchor, as a forest; ``own``: it may count as a
    resident of this part."""
    number = (anchor >> np.uint64(_SEGMENT) & np.uint64(15)).astype(np.int64)
    at = anchor & np.uint64((1 << _SEGMENT) - 1)
    resident = np.zeros(len(f), bool)
    for s in cells:
        mine = number == s.number
        resident[mine] = s.home(s.value(f[mine])) == at[mine]
    resident &= own
    begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[begin, len(f)])
    group = np.repeat(np.arange(len(begin)), size)
    pairs = np.bincount(group[resident], minlength=len(begin)) * size
    us, vs = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            a, b = forest(a, b)
            us.append(a)
            vs.append(b)

    for g in np.flatnonzero(pairs > PAIRS):
        here = slice(begin[g], begin[g] + size[g])
        keep(*walk(f[here][resident[here]], f[here][~resident[here]], distance))
    rows = np.flatnonzero(resident & (size[group] > 1) & (pairs[group] <= PAIRS))
    total = np.cumsum(size[group[rows]])
    done = 0
    while done < len(rows):
        to = int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right"))
        some = rows[done : max(to, done + 1)]
        n = size[group[some]]
        base = np.cumsum(n) - n
        other = np.arange(int(n.sum())) - np.repeat(base, n) + np.repeat(begin[group[some]], n)
        a, b = f[np.repeat(some, n)], f[other]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        keep(a[near], b[near])
        done += len(some)
    none = np.zeros(0, np.uint64)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def links(fps: DataFrame, segments: int, distance: int = DISTANCE) -> DataFrame:
    """``u, v``: a forest of the links among distinct fingerprints ``fp``."""
    cells = cover(segments, distance)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(f), 4096):
                for s in cells:
                    anchor, who = s.visits(f[k : k + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(who.view(np.int64))], names=["anchor", "fp"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for s in cells:
                yield pa.RecordBatch.from_arrays([pa.array((s.home(s.value(f)) | np.uint64(s.number << _SEGMENT)).view(np.int64))], names=["anchor"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            anchor, f, own = (np.concatenate(x) for x in zip(*held))
            to = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            held, rows = [(anchor[to:], f[to:], own[to:])], len(anchor) - to
            if to:
                u, v = compare(anchor[:to], f[:to], own[:to], cells, distance)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else np.ones(batch.num_rows, bool)
            held.append((*(batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)), own))
            rows += batch.num_rows
            if rows >= 1 << 18:
                yield from flush(False)
        if rows:
            yield from flush(True)

    copies = fps.select("fp").mapInArrow(replicate, "anchor long, fp long")
    large = cut(fps.select("fp").mapInArrow(homes, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RESIDENTS))
    if not large.isEmpty():
        parts = large.select("anchor", F.ceil(F.col("n") / RESIDENTS).alias("parts"))
        copies = copies.join(parts, "anchor", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))) == F.col("part")
        copies = copies.select((F.col("anchor") + F.shiftleft(F.col("part").cast("long"), _PART)).alias("anchor"), "fp", own.alias("own"))
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "u long, v long")


def _classes(rows: DataFrame, distance: int, segments: int | None, shingle: int) -> DataFrame:
    """``rows`` (``text`` and ``doc_id`` first) without text, with ``fp, root, component_id``."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(fp.view(np.int64))], names=[*(f.name for f in kept), "fp"])

    fps = cut(rows.mapInArrow(sign, T.StructType([*kept, T.StructField("fp", T.LongType())])))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    segments = segments or (3 if nodes.count() < TWO_SEGMENTS else 2)
    roots = components(links(nodes, segments, distance))
    linked = roots.withColumnRenamed("node", "fp").join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("node").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", "component_id")
    ids = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("node")).otherwise(F.col("component_id")).alias("component_id")))
    return fps.join(ids, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", distance: int = DISTANCE, segments: int | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; the id is the smallest that links reach."""
    rows = docs.select(F.col(text).alias("text"), F.col(doc).alias("doc_id"))
    return _classes(rows, distance, segments, shingle).select("doc_id", "fp", "component_id")


def walk_texts(fp: np.ndarray, doc: np.ndarray, value: np.ndarray, distance: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among texts: fingerprints within ``distance``, and shingle sets
    whose Jaccard similarity is the fraction ``share`` or more.

    ``value``: the distinct shingle hashes of each text, in order of ``doc``.  Two texts without any are alike.
    """
    size = np.bincount(doc, minlength=len(fp))
    first = np.cumsum(size) - size
    names, code = np.unique(value, return_inverse=True)
    mark = np.zeros(len(names), bool)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            q = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[q]) <= distance
            if not near.any():
                continue
            who = left[near]
            n = size[who]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[who], n)
            mine = code[first[q] : first[q] + size[q]]
            mark[mine] = True
            both = np.bincount(np.repeat(np.arange(len(who)), n), mark[code[at]], len(who)).astype(np.int64)
            mark[mine] = False
            alike = (share[0] + share[1]) * both >= share[0] * (size[q] + n)
            us.append(who[alike])
            vs.append(np.full(int(alike.sum()), q))
            queue += list(who[alike])
            near[near] = alike
            left = left[~near]
    return np.concatenate(us), np.concatenate(vs)


def alike(members: DataFrame, distance: int, share: tuple[int, int], words: int) -> DataFrame:
    """``u, v``: a forest of the links among texts ``s`` of one component ``root``.

    ``members``: ``root, s, fp, parts, text``; a text may come more than once.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.concat_tables(held).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in ("root", "i", "j")], axis=1)
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            to = rows.num_rows if last else int(begin[-1])
            held = [rows.slice(to)]
            size = rows.slice(to).nbytes
            for a, b in zip(begin, np.r_[begin[1:], rows.num_rows]):
                if b > to:
                    break
                s, one = np.unique(rows.column("s").to_numpy()[a:b], return_index=True)
                if len(s) < 2:
                    continue
                doc, value = shingles(rows.column("text").slice(a, b - a).take(one).combine_chunks(), words)
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])][: len(doc)]
                fp = rows.column("fp").to_numpy()[a:b][one].view(np.uint64)
                u, v = walk_texts(fp, doc[new], value[new], distance, share)
                yield pa.RecordBatch.from_arrays([pa.array(s[u]), pa.array(s[v])], names=["u", "v"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size >= 2 * BLOCK_BYTES:
                yield from flush(False)
        if held:
            yield from flush(True)

    block = F.pmod(F.xxhash64("s", F.lit(1)), F.col("parts"))
    pairs = members.withColumn("own", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 or own <> with")
    pairs = pairs.select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "s", "fp", "text")
    return pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(meet, "u long, v long")


def one_of_each(docs: DataFrame, text: str = "text", doc: str = "doc_id", distance: int = DISTANCE, segments: int | None = None, shingle: int = SHINGLE, share: tuple[int, int] | None = None, words: int = 5) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id.

    Groups are components of near fingerprints or, with ``share`` (a fraction), of texts that are near
    and have at least that Jaccard similarity over shingles of ``words`` words, lower-cased in A-Z; of
    fewer words the whole sequence is the shingle, and texts without words are alike.

    Rows with a null id come last; of rows with one id, the row of smallest hash over all columns
    stays, and of rows that are equal in all columns one.
    """
    #: two hashes of all columns say which row it is; what else is in the row has no name of its own
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("k1"), F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in docs.columns)).alias("k2"))
    body = F.col("row")[text]
    rows = keyed.select(body.alias("text"), F.col("row")[doc].alias("doc_id"), "k1", "k2", F.xxhash64(body).alias("s"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("bytes"))
    classes = _classes(rows if share else rows.drop("s", "bytes"), distance, segments, shingle)

    def chosen(which: DataFrame) -> DataFrame:
        """The rows of ``k1, k2``, of which there are ``n``, each once."""
        kept = keyed.join(which.where("n = 1"), ["k1", "k2"])
        again = which.where("n > 1")
        if not again.isEmpty():
            kept = kept.union(keyed.join(again, ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
        return kept

    if share:
        texts = classes.groupBy("root", "s", "fp", "bytes", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
        texts = cut(texts.groupBy("root", "s", "fp", "bytes").agg(F.min(F.struct("k1", "k2", "n")).alias("f")))
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1)))
        several = texts.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), parts.alias("parts")).where("texts > 1").drop("texts")
        members = chosen(cut(texts.join(several, "root").select("f.*", "root", "s", "fp", "parts")))
        groups = components(alike(members.select("root", "s", "fp", "parts", body.alias("text")), distance, share, words))
        classes = classes.drop("root").join(groups.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    counted = classes.groupBy("root", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "n")).alias("f")).select("f.k1", "f.k2", "f.n")
    return chosen(cut(first)).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
