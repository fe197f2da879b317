"""Running totals within groups of any size, without a group in one task.

A group's rows are dealt into buckets by a well-spread order key.  Sums of the
buckets, a few thousand a group at most, give each bucket's offset; a window
inside each bucket gives the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the order key that name a bucket: 4,096 buckets a group.
BUCKET_DIGITS = 3


def before(df: DataFrame, group: str, order: str, size: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of the group that come before.

    ``order`` is a column of hex digests; ties are equal rows or come in any order.
    """
    rows = df.withColumn("__bucket", F.substring(order, 1, BUCKET_DIGITS)).withColumn("__size", size)
    sums = rows.groupBy(group, "__bucket").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    joined = rows.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    inside = Window.partitionBy(group, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__offset") + F.coalesce(F.sum("__size").over(inside), F.lit(0))).drop("__g", "__b", "__bucket", "__size", "__offset")
