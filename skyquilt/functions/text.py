"""Parsing and formatting of angles, designations and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = r"""[:\shdms°'"]+"""


def parse_sexagesimal(text: Column, hours: bool = False) -> Column:
    """Degrees of ``12:34:56``, ``-5d 30m`` and the like; the sign is the first part's.  Null if not a number."""
    trimmed = F.trim(text)
    parts = F.filter(F.split(trimmed, _SEPARATORS), lambda p: p != "")
    numbers = F.transform(parts, lambda p: F.abs(p.try_cast("double")))
    sum_ = F.get(numbers, F.lit(0)) + F.coalesce(F.get(numbers, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(numbers, F.lit(2)), F.lit(0.0)) / 3600
    valid = (F.size(parts) >= 1) & (F.size(parts) <= 3) & ~F.exists(numbers, lambda n: n.isNull())
    value = F.when(trimmed.startswith("-"), -sum_).otherwise(sum_)
    return F.when(valid, value * 15 if hours else value)


def parse_angle(text: Column, hours: bool = False) -> Column:
    """A header's angle: a number is degrees, else sexagesimal (hours for right ascensions)."""
    return F.coalesce(F.trim(text).try_cast("double"), parse_sexagesimal(text, hours))


def format_ra(degrees: Column) -> Column:
    """``hh:mm:ss.ss``, rounded before it is split, 24 h being 0 h."""
    c = F.floor(degrees / 15 * 360000 + 0.5).cast("long") % 8640000
    return F.format_string("%02d:%02d:%05.2f", F.floor(c / 360000).cast("int"), (F.floor(c / 6000) % 60).cast("int"), (c % 6000) / 100.0)


def format_dec(degrees: Column) -> Column:
    """``+dd:mm:ss.s``."""
    d = F.floor(F.abs(degrees) * 36000 + 0.5).cast("long")
    sign = F.when((degrees < 0) & (d > 0), "-").otherwise("+")
    return F.concat(sign, F.format_string("%02d:%02d:%04.1f", F.floor(d / 36000).cast("int"), (F.floor(d / 600) % 60).cast("int"), (d % 600) / 10.0))


#: Letters of designations and the catalogs they mean.
CATALOG_LETTERS = {"NGC": "NGC", "IC": "IC", "M": "M", "SH2": "Sh2", "SH": "Sh2", "VDB": "vdB", "LBN": "LBN", "LDN": "LDN", "B": "B", "C": "C"}


def normalize_designation(text: Column) -> Column:
    """``ngc0224`` is ``NGC 224``; unknown letters give null."""
    clean = F.upper(F.regexp_replace(text, r"[\s_]+", ""))
    letters = F.regexp_extract(clean, r"^(SH2|[A-Z]+)-?0*([0-9]+)([A-Z]?)$", 1)
    number = F.regexp_extract(clean, r"^(SH2|[A-Z]+)-?0*([0-9]+)([A-Z]?)$", 2)
    suffix = F.regexp_extract(clean, r"^(SH2|[A-Z]+)-?0*([0-9]+)([A-Z]?)$", 3)
    name = F.lit(None).cast("string")
    for key, value in CATALOG_LETTERS.items():
        name = F.when(letters == key, F.lit(value)).otherwise(name)
    return F.when(name.isNotNull() & (number != ""), F.concat(name, F.when(name == "Sh2", "-").otherwise(" "), number, suffix))


def object_name(messier: Column, designation: Column) -> Column:
    return F.when(messier > 0, F.concat(F.lit("M "), messier.cast("string"))).otherwise(designation)


def object_tier(messier: Column, common_name: Column) -> Column:
    """0 for Messier objects, 1 for those with a common name, 2 for others."""
    return F.when(messier > 0, 0).when(F.coalesce(common_name, F.lit("")) != "", 1).otherwise(2)


def julian_epoch(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / F.lit(365.25)


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def round_half_up(value: Column, scale: float) -> Column:
    """``floor(v * scale + 0.5) / scale``; NaN stays."""
    return F.when(F.isnan(value), value).otherwise(F.floor(value * scale + 0.5) / scale)


def stale_key(key: Column) -> Column:
    """Header keywords that a new solution replaces."""
    return key.rlike(r"^(CTYPE|CRPIX|CRVAL|CDELT|CROTA|CUNIT)[12]$|^CD[12]_[12]$|^PC[12]_[12]$|^(A|B|AP|BP)_(ORDER|DMAX|\d+_\d+)$|^(LONPOLE|LATPOLE|EQUINOX|RADESYS|PLTSOLVD)$")


def catalog_size(name: Column) -> Column:
    """Stars per square degree of ``gaia-<n>``, 10 to 10,000; else null."""
    n = F.regexp_extract(name, r"^gaia-(\d{2,5})$", 1).try_cast("int")
    return F.when((n >= 10) & (n <= 10000), n)


def query_parameters(query: Column) -> Column:
    """Map of a URL query's decoded parameters, blanks dropped."""
    pairs = F.str_to_map(query, F.lit("&"), F.lit("="))
    decoded = F.transform_values(pairs, lambda _, v: F.trim(F.try_url_decode(F.coalesce(v, F.lit("")))))
    return F.map_filter(decoded, lambda _, v: v != "")


def pascal_number(value: Column, digits: int = 17) -> Column:
    """Scientific notation with a three-digit exponent, as `` 1.2345E+002``."""
    plain = F.format_string(f"%.{digits - 1}E", value)
    mantissa, sign, power = (F.regexp_extract(plain, r"^(.*)E([+-])(\d+)$", k) for k in (1, 2, 3))
    return F.concat(F.when(value < 0, "").otherwise(" "), mantissa, F.lit("E"), sign, F.lpad(power, 3, "0"))


def spaced_ra(degrees: Column) -> Column:
    """``hh: mm  ss.s``."""
    t = F.floor(F.pmod(degrees, F.lit(360.0)) / 15 * 36000 + 0.5).cast("long") % 864000
    return F.format_string("%02d: %02d  %04.1f", F.floor(t / 36000).cast("int"), (F.floor(t / 600) % 60).cast("int"), (t % 600) / 10.0)


def spaced_dec(degrees: Column) -> Column:
    """``+ddd mm  ss``, with the letter d after the degrees."""
    s = F.floor(F.abs(degrees) * 3600 + 0.5).cast("long")
    return F.concat(F.when(degrees < 0, "-").otherwise("+"), F.format_string("%02dd %02d  %02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int")))


def short_distance(degrees: Column) -> Column:
    """Degrees, minutes or seconds of arc."""
    return F.when(degrees >= 1, F.format_string("%.1fd", degrees)).when(degrees * 60 >= 1, F.format_string("%.1f'", degrees * 60)).otherwise(F.format_string('%.0f"', degrees * 3600))
