"""The training-data pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage works on all that its predecessor kept.  Between stages a table is
written to the cluster's shared folder and read again, so that no stage is
computed twice and a lost executor costs its own tasks only; it is deleted when
the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyquilt.llm.decontaminate import clean
from skyquilt.llm.mixing import mixed
from skyquilt.llm.quality import quality_filter
from skyquilt.llm.sharding import shard
from skyquilt.llm.simhash import one_of_each
from skyquilt.session import discard, stored, table


#: Near copies: fingerprints of two-word shingles within 8 of 64 bits (a changed word changes two such
#: shingles, five of five words), and 4/5 of the five-word shingles of two texts in common, exactly.
NEAR = {"shingle": 2, "distance": 8, "segments": 3, "share": (4, 5), "words": 5}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    Null and empty texts go, as they have under 20 words; null ids and repeated
    rows are judged row by row; no rows give none.
    """
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies stays, as one row.

    Rows with a null id come last; texts without words are one group; of rows of
    one id with different texts each is judged by its own text, of equal rows one
    stays; no rows give none.
    """
    return one_of_each(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null texts hold nothing and stay; null ids and repeated rows are judged row
    by row; without items all stay; no rows give none.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it: not at all, once or twice.

    Texts without words have nothing to take and go; a null source is a source;
    null ids are rows like others; equal rows share what is taken of them; no rows
    give none.
    """
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix.

    Null texts count as empty; null ids and repeated rows are rows of their own;
    no rows give none.
    """
    return shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SimHash fingerprints and shard capacities have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
