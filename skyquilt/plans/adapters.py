"""Deterministic arithmetic that gives the generic tables the shape of sky data.

Each adapter exists twice, as a DataFrame and as the same SQL for the twin
queries; operators take any DataFrame with the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.sphere import TWO_PI, frac
from skyquilt.session import table

PHI, RHO, SIGMA = 0.6180339887498949, 0.7548776662466927, 0.5698402909980532


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ra, dec, mag, pm_ra, pm_dec`` from orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.lit(TWO_PI) * frac(F.col("o_orderkey") * PHI)).alias("ra"),
        F.asin(2 * frac(F.col("o_orderkey") * RHO) - 1).alias("dec"),
        (20 - 2.5 * F.log10("o_totalprice")).alias("mag"),
        ((F.col("o_custkey") % 2001 - 1000) * 0.25).alias("pm_ra"),
        ((F.col("o_custkey") * 7 % 2001 - 1000) * 0.25).alias("pm_dec"),
    )


STARS = f"""SELECT o_orderkey AS id, {TWO_PI}::double * (o_orderkey * {PHI}::double - floor(o_orderkey * {PHI}::double)) AS ra,
  asin(2 * (o_orderkey * {RHO}::double - floor(o_orderkey * {RHO}::double)) - 1) AS dec, 20 - 2.5 * log10(o_totalprice) AS mag,
  (o_custkey % 2001 - 1000) * 0.25::double AS pm_ra, (o_custkey * 7 % 2001 - 1000) * 0.25::double AS pm_dec FROM orders"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, star, x, y, flux, fwhm, concentration, snr, saturated`` from lineitem."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), key.alias("star")).agg(*(F.max(c).alias(c) for c in ("l_extendedprice", "l_discount", "l_quantity", "l_tax")))
    key = F.col("star")
    return li.select(
        "image_id",
        "star",
        (1600 * frac(key * PHI)).alias("x"),
        (1200 * frac(key * RHO)).alias("y"),
        F.col("l_extendedprice").alias("flux"),
        (1.5 + 6 * frac(key * SIGMA)).alias("fwhm"),
        F.when(F.col("l_discount") >= 0.05, 0.9 + F.col("l_discount")).otherwise(0.5 + F.col("l_discount") * 8).alias("concentration"),
        F.col("l_quantity").alias("snr"),
        (F.col("l_tax") >= 0.08).alias("saturated"),
    )


DETECTIONS = f"""SELECT image_id, k AS star, 1600 * (k * {PHI}::double - floor(k * {PHI}::double)) AS x, 1200 * (k * {RHO}::double - floor(k * {RHO}::double)) AS y,
  flux, 1.5::double + 6 * (k * {SIGMA}::double - floor(k * {SIGMA}::double)) AS fwhm,
  CASE WHEN disc >= 0.05::double THEN 0.9::double + disc ELSE 0.5::double + disc * 8 END AS concentration, snr, tax >= 0.08::double AS saturated
  FROM (SELECT l_suppkey AS image_id, l_orderkey * 8 + l_linenumber AS k, max(l_extendedprice) AS flux, max(l_discount) AS disc, max(l_quantity) AS snr, max(l_tax) AS tax FROM lineitem GROUP BY ALL)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, ref, rx, ry``: catalog positions on images, from orders; as many images as suppliers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 1
    return o.select((F.col("o_custkey") % n + 1).alias("image_id"), F.col("o_orderkey").alias("ref"), (1600 * frac(F.col("o_orderkey") * SIGMA)).alias("rx"), (1200 * frac(F.col("o_orderkey") * PHI)).alias("ry"))


REFERENCES = f"""SELECT o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS image_id, o_orderkey AS ref,
  1600 * (o_orderkey * {SIGMA}::double - floor(o_orderkey * {SIGMA}::double)) AS rx, 1200 * (o_orderkey * {PHI}::double - floor(o_orderkey * {PHI}::double)) AS ry FROM orders"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, x, y, v``: 64 x 48 pixels an image, from lineitem; the brightest row of a pixel counts."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("image_id"), F.floor(64 * frac(key * PHI)).cast("int").alias("x"), F.floor(48 * frac(key * RHO)).cast("int").alias("y"), F.col("l_extendedprice").alias("p"))
    return li.groupBy("image_id", "x", "y").agg(F.max("p").alias("v"))


PIXELS = f"""SELECT image_id, x, y, max(p) AS v FROM (
  SELECT l_suppkey % 4 AS image_id, floor(64 * (k * {PHI}::double - floor(k * {PHI}::double)))::int AS x, floor(48 * (k * {RHO}::double - floor(k * {RHO}::double)))::int AS y, l_extendedprice AS p
  FROM (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem)) GROUP BY image_id, x, y"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, c0..c3, diam``: quantized four-star codes and diameters in degrees, from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    q = lambda k: F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((F.get("embedding", k).cast("double") + 0.5) * 65535 + 0.5))).cast("int")
    return e.select(F.col("vec_id").alias("id"), *(q(k).alias(f"c{k}") for k in range(4)), (F.abs(F.get("embedding", 4).cast("double")) * 10).alias("diam"))


CODES = "SELECT vec_id AS id, " + ", ".join(f"greatest(0, least(65535, floor((embedding[{k + 1}]::double + 0.5) * 65535 + 0.5)))::int AS c{k}" for k in range(4)) + ", abs(embedding[5]::double) * 10 AS diam FROM embeddings"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, designation, catalog, messier, common_name, ra, dec, major, mag``: deep-sky objects from part."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("id"),
        F.concat(F.lit("NGC "), key.cast("string")).alias("designation"),
        (F.col("p_size") % 7).alias("catalog"),
        F.when(key % 11 == 0, (key / 11).cast("int")).otherwise(0).alias("messier"),
        F.when(key % 5 == 0, F.col("p_name")).alias("common_name"),
        (F.lit(TWO_PI) * frac(key * PHI)).alias("ra"),
        F.asin(2 * frac(key * RHO) - 1).alias("dec"),
        F.when(key % 13 != 0, F.col("p_size") * 2.0).alias("major"),
        F.when(key % 17 != 0, F.col("p_retailprice") / 100).alias("mag"),
    )


OBJECTS = f"""SELECT p_partkey AS id, 'NGC ' || p_partkey AS designation, p_size % 7 AS catalog,
  CASE WHEN p_partkey % 11 = 0 THEN (p_partkey // 11)::int ELSE 0 END AS messier, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS common_name,
  {TWO_PI}::double * (p_partkey * {PHI}::double - floor(p_partkey * {PHI}::double)) AS ra, asin(2 * (p_partkey * {RHO}::double - floor(p_partkey * {RHO}::double)) - 1) AS dec,
  CASE WHEN p_partkey % 13 <> 0 THEN p_size * 2.0::double END AS major, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice / 100 END AS mag FROM part"""
