"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Targets: each source's share of the mix by weight, at most ``repeats`` times
its size, the excess shared again by weight (:func:`targets`).  The mix is a
number of equal-token blocks; blocks go to sources by the highest quotients
target / (2k - 1), shard after shard, which gives integer quotas for each shard
and source (:func:`quotas`).  Each source's documents form a stream in seeded
order, read again from its start when it ends, and cut into blocks of equal
numbers of words; shard after shard takes its quota of the blocks that come
next, so that documents stay whole but where shards meet (:func:`mix`).  The
mix says for every document which shards take how many of its words.

Scale: documents are dealt by source and bucket of the seeded order, so no
source meets in one task.  Only the table of sources (one row each) and the
quotients near the cut (under 4 a source and shard) pass through one task.

Defined results: the order is that of seed, id and text, so it does not depend
on how rows come; rows equal in id and text take places next to each other in
any order, and give the same rows out; null text has size 0 and takes nothing;
a null id is empty in the order; a null source is a source of its own, last in
order; repeated rows are documents of their own; an empty table gives no rows;
with no words at all every target is 0; extra columns are ignored, or kept by
:func:`mixed`, in which documents without words have no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquilt.llm.ranges import before
from skyquilt.session import cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 64
SHARDS = 8
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc: str = "doc_id", seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, seeded``: what the mix needs of each document, and the columns to keep."""
    order = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return docs.select(
        F.col(doc).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(order).alias("seeded"),
        *keep,
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, place, target`` for each source, weights dealt in order of source."""
    by_name, alone = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    cap = F.col("source_size") * repeats
    ranked = Window.orderBy(cap / F.col("weight"), "place")
    capped = F.coalesce(F.sum(cap).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    level = src.withColumn("__each", (F.sum("source_size").over(alone) * F.lit(share) - capped) / open_weight)
    # with the sources before it at their caps, each source gives a level for the rest; the highest is
    # the one at which those before are over their caps and the others are not
    fits = F.max("__each").over(alone)
    level = level.withColumn("__level", fits)
    return level.select("source", "source_size", "place", F.least(cap.cast("double"), F.col("__level") * F.col("weight")).alias("target"))


def quotas(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """``shard, source, place, first, blocks``: Sainte-Laguë awards of each source in each shard, and
    the number of its blocks that earlier shards take.

    After the first n awards a source holds as many as its quotients among the n
    highest.  A divisor a little above the final one gives almost all of them at
    once; the quotients between, under 1.5 a source together and 2 more each,
    are ranked.
    """
    alone, by_shard = Window.partitionBy(), Window.partitionBy("upto")
    votes = targets.where("target > 0").select("source", "place", F.col("target").alias("v"))
    votes = votes.withColumn("all", F.sum("v").over(alone)).withColumn("n_src", F.count(F.lit(1)).over(alone))
    house = F.floor(F.col("all") / block + 0.5)
    upto = votes.withColumn("upto", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("n", F.floor(house * F.col("upto") / shards))
    base = F.when(F.col("n") > F.col("n_src"), F.floor(F.col("v") * (F.col("n") - F.col("n_src")) / F.col("all") + 0.5)).otherwise(F.lit(0))
    upto = upto.withColumn("base", base.cast("long"))
    upto = upto.withColumn("left", F.col("n") - F.sum("base").over(by_shard))
    more = F.ceil(F.col("n_src") * 1.5 * F.col("v") / F.col("all")) + 2
    near = upto.withColumn("k", F.explode(F.sequence(F.col("base") + 1, F.col("base") + more)))
    best = Window.partitionBy("upto").orderBy((F.col("v") / (2 * F.col("k") - 1)).desc(), "place", "k")
    won = near.withColumn("rank", F.row_number().over(best)).groupBy("upto", "source", "place", "base").agg(F.sum((F.col("rank") <= F.col("left")).cast("long")).alias("extra"))
    held = won.withColumn("held", F.col("base") + F.col("extra"))
    earlier = F.coalesce(F.lag("held").over(Window.partitionBy("place").orderBy("upto")), F.lit(0))
    return held.select((F.col("upto") - 1).alias("shard"), "source", "place", earlier.alias("first"), (F.col("held") - earlier).alias("blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED, keep: tuple[str, ...] = (), **names: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken, parts`` for each document; ``parts``: the shards
    that take words of it, and how many."""
    sizes = cut(sized(docs, seed=seed, keep=keep, **names))
    goal = cut(targets(sizes, weights, share, repeats))
    span = F.struct("shard", (F.col("first") * block).alias("low"), ((F.col("first") + F.col("blocks")) * block).alias("high"))
    won = quotas(goal, block, shards).groupBy("place").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # one row a source: Spark's own size limit decides whether it is broadcast
    goal = goal.join(won, "place", "left").select(F.col("source").alias("__source"), "source_size", "target", "spans")
    rows = before(sizes, "source", "seeded", F.col("size"), "start").join(goal, F.col("source").eqNullSafe(F.col("__source")))
    # overlap of the document's [start, start + size) on each pass with the words that a shard reads
    size, at, whole = F.col("size"), F.col("start"), F.col("source_size")

    def words(s: Column) -> Column:
        high = F.least(s["high"], whole * repeats)
        return sum((F.greatest(F.lit(0), F.least(at + size, high - whole * k) - F.greatest(at, s["low"] - whole * k)) for k in range(1, repeats)), F.greatest(F.lit(0), F.least(at + size, high) - F.greatest(at, s["low"])))

    parts = F.filter(F.transform(F.coalesce("spans", F.array().cast("array<struct<shard:int,low:bigint,high:bigint>>")), lambda s: F.struct(s["shard"].alias("shard"), words(s).cast("long").alias("words"))), lambda p: p["words"] > 0)
    rows = rows.withColumn("parts", parts)
    return rows.select("doc_id", "size", "source_size", "target", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken"), "parts", *keep)


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, with all their columns: each as often as the words taken of it make
    whole copies, to the nearest.  Rows equal in all columns share what is taken of them."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # two hashes of all columns say which row it is; what else is in the row has no name of its own
    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2"))
    rows = keyed.select(F.col("row")[doc].alias("doc_id"), F.col("row")[text].alias("text"), F.col("row")[source].alias("source"), "k1", "k2")
    took = mix(rows, keep=("k1", "k2"), **options).groupBy("k1", "k2").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).where("s > 0")
    took = took.select("k1", "k2", F.floor(F.col("t") / F.col("s") + 0.5).cast("int").alias("copies")).where("copies > 0")
    copied = keyed.join(took, ["k1", "k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    said = F.transform("parts", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["words"].cast("string")))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(said, ",").alias("shards"))


ORACLE = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint AS size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS seeded FROM documents),
s AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS weight, {REPEATS} * source_size AS cap FROM s),
e AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::double - coalesce(sum(cap) OVER (ORDER BY cap::double / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap::double / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each FROM w),
t AS (
  SELECT source, place, source_size, least(cap::double, max(each) OVER () * weight) AS target FROM e),
q AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place, k) AS award
  FROM (SELECT *, unnest(range(1, (target / {BLOCK})::bigint + 3)) AS k FROM t WHERE target > 0)),
h AS (SELECT floor(sum(target) / {BLOCK} + 0.5) AS house FROM t),
b AS (
  SELECT place, shard, {BLOCK} * count(*) FILTER (award <= floor(house * shard / {SHARDS})) AS low, {BLOCK} * count(*) FILTER (award <= floor(house * (shard + 1) / {SHARDS})) AS high
  FROM q, h, (SELECT unnest(range({SHARDS})) AS shard) GROUP BY place, shard),
r AS (
  SELECT rid, doc_id, size, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY seeded ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
g AS (SELECT r.*, place, source_size, target FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT rid, shard, ({" + ".join(f"greatest(0, least(start + size, least(high, {REPEATS} * source_size) - {k} * source_size) - greatest(start, low - {k} * source_size))" for k in range(REPEATS))})::bigint AS words
  FROM g JOIN b USING (place)),
m AS (SELECT rid, sum(words) AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards FROM p WHERE words > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::bigint AS taken, coalesce(shards, '') AS shards FROM g LEFT JOIN m USING (rid)"""
