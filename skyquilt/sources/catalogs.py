"""Readers of star and deep-sky catalogs: explicit schemas, drop rules as filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.sphere import moved, wrap
from skyquilt.functions.text import parse_sexagesimal

#: Values of the Gaia archive's numbering: the HEALPix level 3 chunk of a source.
CHUNK_DIVISOR = 2**35 * 2**18
TYCHO_EPOCH, TYCHO_SUPPLEMENT_EPOCH, GAIA_EPOCH = 2000.0, 1991.25, 2016.0


def gaia_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``ra, dec`` (radians), ``pm_ra, pm_dec`` (mas a year), ``mag, epoch`` from CSV files with a header.

    Rows without a magnitude or position are dropped; unknown proper motions are 0.
    """
    raw = spark.read.csv(path, schema="ra double, dec double, pmra double, pmdec double, phot_g_mean_mag double", header=True, mode="PERMISSIVE")
    ok = raw.where("phot_g_mean_mag is not null and not isnan(phot_g_mean_mag) and ra is not null and dec is not null")
    known = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return ok.select(F.radians("ra").alias("ra"), F.radians("dec").alias("dec"), known("pmra").alias("pm_ra"), known("pmdec").alias("pm_dec"), F.col("phot_g_mean_mag").alias("mag"), F.lit(GAIA_EPOCH).alias("epoch"))


def chunk_of(source_id: Column) -> Column:
    """HEALPix level 3 chunk, 0 to 767, of a Gaia source."""
    return F.floor(source_id / CHUNK_DIVISOR).cast("int")


def brightest_of_chunks(sources: DataFrame, n: int) -> DataFrame:
    """The ``n`` brightest sources of every chunk: what one bounded remote query each would return."""
    ranked = sources.withColumn("chunk", chunk_of(F.col("source_id"))).withColumn("rn", F.expr("row_number() over (partition by chunk order by mag, source_id)"))
    return ranked.where(F.col("rn") <= n)


def field(start: int, end: int) -> Column:
    """Number in bytes ``start`` to ``end`` (from 1) of a fixed-width line; null if blank."""
    return F.trim(F.substring("value", start, end - start + 1)).try_cast("double")


def tycho_magnitude(bt: Column, vt: Column) -> Column:
    """V from BT and VT, or the one that there is."""
    return F.coalesce(vt - 0.090 * (bt - vt), vt, bt)


def tycho2(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The main catalog's fixed-width lines (gzip is read as it is).

    Stars without a mean position have their observed one and no proper motion.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    mean = field(16, 27).isNotNull()
    rows = lines.select(
        F.radians(F.coalesce(field(16, 27), field(153, 164))).alias("ra"),
        F.radians(F.when(mean, field(29, 40)).otherwise(field(166, 177))).alias("dec"),
        F.when(mean, F.coalesce(field(42, 48), F.lit(0.0))).otherwise(0.0).alias("pm_ra"),
        F.when(mean, F.coalesce(field(50, 56), F.lit(0.0))).otherwise(0.0).alias("pm_dec"),
        tycho_magnitude(field(111, 116), field(124, 129)).alias("mag"),
        F.lit(TYCHO_EPOCH).alias("epoch"),
    )
    return rows.where("ra is not null and dec is not null and mag is not null")


def tycho2_supplement(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The supplement's lines, moved from 1991.25 to 2000."""
    lines = spark.read.text(path)
    rows = lines.select(
        F.radians(field(16, 27)).alias("ra"), F.radians(field(29, 40)).alias("dec"),
        F.coalesce(field(42, 48), F.lit(0.0)).alias("pm_ra"), F.coalesce(field(50, 56), F.lit(0.0)).alias("pm_dec"),
        tycho_magnitude(field(84, 89), field(97, 102)).alias("mag"),
    ).where("ra is not null and dec is not null and mag is not null")
    ra, dec = moved(F.col("ra"), F.col("dec"), F.col("pm_ra"), F.col("pm_dec"), TYCHO_EPOCH - TYCHO_SUPPLEMENT_EPOCH)
    return rows.select(ra.alias("ra"), dec.alias("dec"), "pm_ra", "pm_dec", "mag", F.lit(TYCHO_EPOCH).alias("epoch"))


def bright_stars(spark: SparkSession, path: str) -> DataFrame:
    """``hr, ra, dec, mag`` of the Bright Star Catalogue; lines without a position are dropped, an unknown magnitude is 99."""
    lines = spark.read.text(path)
    hours = field(76, 77) + field(78, 79) / 60 + field(80, 83) / 3600
    size = field(85, 86) + field(87, 88) / 60 + field(89, 90) / 3600
    degrees = F.when(F.substring("value", 84, 1) == "-", -size).otherwise(size)
    rows = lines.select(field(1, 4).cast("int").alias("hr"), F.radians(hours * 15).alias("ra"), F.radians(degrees).alias("dec"), F.coalesce(field(103, 107), F.lit(99.0)).alias("mag"))
    return rows.where("ra is not null and dec is not null")


def open_ngc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Deep-sky objects of a ``;`` table with a header; duplicates, lost objects and those without a position are dropped."""
    raw = spark.read.csv(path, sep=";", header=True)
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    rows = raw.where(~F.col("Type").isin("Dup", "NonEx") & F.col("RA").isNotNull() & (F.col("RA") != ""))
    return rows.select(
        F.col("Name").alias("designation"), F.col("Type").alias("type"),
        wrap(F.radians(parse_sexagesimal(F.col("RA"), hours=True))).alias("ra"), F.radians(parse_sexagesimal(F.col("Dec"))).alias("dec"),
        number("MajAx").alias("major"), number("MinAx").alias("minor"), number("PosAng").alias("angle"),
        F.coalesce(number("V-Mag"), number("B-Mag")).alias("mag"), F.coalesce(F.col("M").try_cast("int"), F.lit(0)).alias("messier"),
        F.col("`Common names`").alias("common_name"), F.col("Identifiers").alias("identifiers"),
    )


def vizier_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a tab-separated VizieR file, as strings: comments and blank lines are skipped, and
    the lines of units and dashes under the header."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.transform(F.split("value", "\r?\n"), lambda v, i: F.struct(i.alias("i"), v.alias("v")))).alias("r")).select("r.*")
    body = lines.where(~F.col("v").startswith("#") & (F.trim("v") != ""))
    body = body.withColumn("n", F.expr("row_number() over (order by i)"))
    names = [c.strip() for c in (body.where("n = 1").first() or {"v": ""})["v"].split("\t")]
    parts = F.split("v", "\t", -1)
    return body.where("n > 3").select(*(F.nullif(F.trim(F.get(parts, names.index(c))), F.lit("")).alias(c) for c in columns))


def words(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-separated text with the given column names; the last takes the rest of the line."""
    parts = F.split(F.trim("value"), r"\s+", len(names))
    return spark.read.text(path).where(F.trim("value") != "").where(~F.trim("value").startswith("#")).select(*(F.get(parts, k).alias(n) for k, n in enumerate(names)))


def constellation_rows(spark: SparkSession, path: str) -> DataFrame:
    """``seq, ra_low, ra_high, dec_low, name`` in file order of a five-field table."""
    rows = words(spark, path, ["ra_low", "ra_high", "dec_low", "abbr", "name"]).coalesce(1).withColumn("seq", F.monotonically_increasing_id().cast("int"))
    return rows.select("seq", *(F.col(c).try_cast("double").alias(c) for c in ("ra_low", "ra_high", "dec_low")), "abbr", F.coalesce("name", "abbr").alias("name"))
