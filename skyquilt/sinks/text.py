"""Result text as column expressions: CSV, header cards, JSON, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.text import format_dec, format_ra, pascal_number
from skyquilt.functions.wcs import plate

MATCHES_HEADER = "x,y,ra,dec,residual_arcsec"


def matches_line(x: Column, y: Column, ra: Column, dec: Column, residual: Column) -> Column:
    return F.format_string("%.3f,%.3f,%.7f,%.7f,%.3f", x, y, ra, dec, residual)


def card(key: Column, value: Column, text: bool = False) -> Column:
    """An 80-character header card."""
    v = F.concat(F.lit("'"), F.rpad(F.replace(value, F.lit("'"), F.lit("''")), 8, " "), F.lit("'")) if text else F.lpad(value, 20, " ")
    return F.rpad(F.concat(F.rpad(key, 8, " "), F.lit("= "), v), 80, " ")


def header(cards: Column) -> Column:
    """Cards in one string with END, padded to a multiple of 2,880."""
    body = F.concat(F.array_join(cards, ""), F.rpad(F.lit("END"), 80, " "))
    return F.rpad(body, F.ceil(F.length(body) / 2880).cast("int") * 2880, " ")


def number(value: Column, digits: int = 14) -> Column:
    """``%G`` with at most ``digits`` significant digits."""
    return F.format_string(f"%.{digits}G", value)


def result_json(df: DataFrame, fields: dict[str, Column], optional: tuple[str, ...] = ()) -> Column:
    """JSON of a result: unknown optional fields are left out, non-finite numbers are null."""
    finite = lambda c, kind: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c) if kind in ("double", "float") else c
    kinds = dict(df.select(*(c.alias(k) for k, c in fields.items())).dtypes)
    required = F.to_json(F.struct(*(finite(c, kinds[k]).alias(k) for k, c in fields.items() if k not in optional)), {"ignoreNullFields": "false"})
    if not optional:
        return required
    extra = F.to_json(F.struct(*(finite(c, kinds[k]).alias(k) for k, c in fields.items() if k in optional)))
    return F.when(extra == "{}", required).otherwise(F.concat(F.expr("''"), F.substring(required, 1, 100000000).substr(F.lit(1), F.length(required) - 1), F.lit(","), extra.substr(F.lit(2), F.length(extra))))


def report(ra: Column, dec: Column, scale: Column, width: Column, height: Column, matches: Column, names: Column, most: int = 5) -> Column:
    """A few lines about a solution and the most prominent objects in its field."""
    more = F.size(names) - most
    objects = F.when(F.size(names) == 0, "").otherwise(F.concat(F.lit("\nObjects: "), F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise("")))
    return F.concat(F.lit("Centre: "), format_ra(ra), F.lit(" "), format_dec(dec), F.format_string("\nScale: %.3f arcsec/px\nField: %.2f x %.2f deg\nStars: %d", scale, width * scale / 3600, height * scale / 3600, matches.cast("long")), objects)


#: Exit statuses of the compatible command.
STATUS = {"solved": 0, "no_solution": 1, "too_few_stars": 2, "no_catalog": 32, "read_error": 16}


def status(solved: Column, stars: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.when(error == "catalog", STATUS["no_catalog"]).otherwise(STATUS["read_error"])).when(solved, STATUS["solved"]).when(stars < 4, STATUS["too_few_stars"]).otherwise(STATUS["no_solution"])


def exit_code(results: DataFrame, solved: str = "solved", invalid: str | None = None) -> DataFrame:
    """0 if all are solved, 1 if some are not, 2 for a usage error."""
    bad = F.bool_or(invalid) if invalid else F.lit(False)
    return results.agg(F.when(bad, 2).when(F.bool_and(solved), 0).otherwise(1).alias("exit_code"))


def ini(solved: Column, w: Column, command: Column, error: Column, warnings: Column) -> Column:
    """Result lines of the compatible command; warnings are one line, as its readers take one."""
    values = {"CRPIX1": w["crpix_x"] + 1, "CRPIX2": w["crpix_y"] + 1, "CRVAL1": w["crval_ra"], "CRVAL2": w["crval_dec"], **plate(w), "CD1_1": w["cd11"], "CD1_2": w["cd12"], "CD2_1": w["cd21"], "CD2_2": w["cd22"]}
    lines = F.concat_ws("\n", *(F.concat(F.lit(k + "="), pascal_number(v)) for k, v in values.items()))
    return F.concat(
        F.when(solved, F.concat(F.lit("PLTSOLVD=T\n"), lines)).otherwise("PLTSOLVD=F"),
        F.lit("\nCMDLINE="), command,
        F.when(error.isNotNull(), F.concat(F.lit("\nERROR="), error)).otherwise(""),
        F.when(F.size(warnings) > 0, F.concat(F.lit("\nWARNING="), F.array_join(warnings, " "))).otherwise(""),
        F.lit("\n"),
    )


def catalog_listing(available: DataFrame, installed: DataFrame) -> DataFrame:
    """``name, json`` of every known catalog: whether it is installed, its stars and size; unknown fields are left out."""
    both = available.join(installed, "name", "full")
    return both.select("name", F.to_json(F.struct("name", F.col("stars").isNotNull().alias("installed"), *(c for c in both.columns if c != "name"))).alias("json"))
