"""Enrichment of positions and fields: deep-sky objects, constellations, merged catalogs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.sphere import precess, precession_matrix, to_vector
from skyquilt.functions.text import object_tier
from skyquilt.operators.rangejoin import Axis, range_join
from skyquilt.session import cut

ARCMIN = math.pi / 180 / 60


def angular_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    d2 = sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(d2) / 2))


def around(objects: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Objects whose extent reaches into a cone, with ``distance`` (radians) and ``prominence``."""
    v = to_vector(F.col("ra"), F.col("dec"))
    centre = to_vector(F.lit(ra), F.lit(dec))
    found = objects.withColumn("distance", angular_distance(v, centre))
    reach = F.coalesce(F.col("major"), F.lit(0.0)) * ARCMIN / 2
    return prominence(found.where(F.col("distance") <= radius + reach))


def prominence(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank objects: tier, catalog, size (unknown first), magnitude (unknown last), distance, id."""
    far = F.lit(1.7976931348623157e308)
    order = [object_tier(F.col("messier"), F.col("common_name")), F.col("catalog"), F.coalesce("major", far).desc(), F.coalesce("mag", far), F.col("distance"), F.col("id")]
    # a field or a cone holds a bounded number of objects; without keys the table is one dimension
    return found.withColumn("prominence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: The fewest and most objects that a request may ask for.
LEAST_OBJECTS, MOST_OBJECTS = 1, 5000


def page(found: DataFrame, wanted: int) -> DataFrame:
    """Of ranked objects the first ``wanted``, within the limits of a request, with the ``total`` found."""
    count = max(LEAST_OBJECTS, min(MOST_OBJECTS, wanted))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.where(F.col("prominence") <= count).withColumn("total", total.scalar())


def described(solutions: DataFrame, matches: DataFrame, intervals: DataFrame) -> DataFrame:
    """Solutions (``id, ra, dec``) with the ``constellation`` of the centre and the number of ``matches`` (rows of their ``id``)."""
    counts = matches.groupBy("id").agg(F.count(F.lit(1)).alias("matches"))
    return constellations(solutions, intervals).join(counts, "id", "left").fillna(0, ["matches"])


def in_fields(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """Objects that reach into each field (``field, field_ra, field_dec, field_radius``).

    Objects are a dimension; Spark broadcasts it under its size limit and joins by blocks beyond.
    """
    v, c = to_vector(F.col("ra"), F.col("dec")), to_vector(F.col("field_ra"), F.col("field_dec"))
    distance, reach = angular_distance(v, c), F.coalesce(F.col("major"), F.lit(0.0)) * ARCMIN / 2
    # bands of declination as an equi-join; a pair meets in the first band that both touch
    band = math.radians(15)
    bands = lambda dec, r: (F.floor((dec - r) / band), F.floor((dec + r) / band))
    f0, f1 = bands(F.col("field_dec"), F.col("field_radius"))
    o0, o1 = bands(F.col("dec"), reach)
    f = fields.withColumn("__f0", f0).withColumn("__b", F.explode(F.sequence("__f0", f1)))
    o = objects.withColumn("__o0", o0).withColumn("__b", F.explode(F.sequence("__o0", o1)))
    joined = f.join(o, "__b").where(F.col("__b") == F.greatest("__f0", "__o0")).drop("__b", "__f0", "__o0")
    return prominence(joined.withColumn("distance", distance).where(F.col("distance") <= F.col("field_radius") + reach), ("field",))


def constellations(positions: DataFrame, rows: DataFrame, epoch: float = 2000.0) -> DataFrame:
    """Add ``constellation``: the first row (by ``seq``) with dec >= dec_low and ra_low <= ra < ra_high,
    hours and degrees of 1875, to which positions are precessed; null where none holds the position.

    The rows, a few hundred, are one array that every position looks through: no shuffle of positions.
    """
    ra, dec = precess(precession_matrix(epoch, 1875.0), F.col("ra"), F.col("dec"))
    table = rows.agg(F.array_sort(F.collect_list(F.struct("seq", "ra_low", "ra_high", "dec_low", "name"))).alias("rows"))
    at = positions.withColumns({"__h": F.degrees(ra) / 15, "__d": F.degrees(dec), "__rows": table.scalar()})
    holds = F.filter("__rows", lambda r: (F.col("__d") >= r["dec_low"]) & (r["ra_low"] <= F.col("__h")) & (F.col("__h") < r["ra_high"]))
    return at.withColumn("constellation", F.get(holds, 0)["name"]).drop("__h", "__d", "__rows")


#: Fixed values of :func:`closest`: objects of the base within the first radius, on average, and how often that doubles at most.
FIRST_OBJECTS, MOST_DOUBLINGS = 4, 10


def closest(base: DataFrame, other: DataFrame, reach: float) -> DataFrame:
    """``oid, id3``: the object of ``base`` closest to each of ``other`` in relation to its reach, at most ``reach`` away.

    Rounds of growing radius, each a join on cells, keep the pairs in proportion to the rows however dense the
    sky is: a row is done when nothing beyond the radius can come before its best, and only others go on.
    """
    own = lambda size: size * ARCMIN / 2 + reach / 4
    at = lambda p, ra, dec: [c.alias(f"__{p}{k}") for k, c in zip("xyz", to_vector(F.col(ra), F.col(dec)))]
    # of equal places of one size the smallest id counts
    b = base.groupBy("ra", "dec", F.coalesce(F.col("major"), F.lit(1.0)).alias("__major")).agg(F.min("id").alias("id3"))
    b = cut(b.select("id3", "__major", *at("b", "ra", "dec")))
    rows = cut(other.select("oid", "size", *at("o", "ra", "dec")))
    cell = b.groupBy(*(F.floor(F.col(f"__b{k}") / reach) for k in "xyz")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    near = cell.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    largest = own(max((v for t, c in ((b, "__major"), (rows, "size")) if (v := t.agg(F.max(c)).first()[0]) is not None), default=0.0))
    doublings = 0
    while near / 4**doublings > FIRST_OBJECTS and doublings < MOST_DOUBLINGS and math.isfinite(largest):
        doublings += 1
    done = None
    for k in range(doublings, -1, -1):
        radius = reach / 2**k
        dist, mine = angular_distance(*(tuple(F.col(f"__{p}{c}") for c in "xyz") for p in "ob")), own(F.greatest("size", "__major"))
        # a chord is shorter than its arc; cells of two radii, of which a row touches two on an axis
        axes = [Axis(f"__b{c}", f"__o{c}", radius * (1 + 1e-6), 2 * radius) for c in "xyz"]
        pairs = range_join(b, rows, axes, dist <= F.least(F.lit(radius), mine))
        found = pairs.groupBy("oid").agg(F.min(F.struct((dist / mine).alias("score"), "id3")).alias("best"))
        last = k == 0 or radius >= largest
        if not last:
            found = cut(found.where(F.col("best.score") < radius / largest))
            rows = cut(rows.join(found, "oid", "left_anti"))
        found = found.select("oid", "best.id3")
        done = found if done is None else done.union(found)
        if last:
            return done


def resolve(base: DataFrame, other: DataFrame, reach_arcmin: float) -> DataFrame:
    """Match each row of ``other`` (``oid, name, ra, dec, size``) with an object of ``base``
    (``id, designation, common_name, ra, dec, major``): by designation, else by common name, else the
    closest in relation to its reach; the smallest id wins ties.  Unmatched rows have a null ``id``.
    """
    # one row a name of the base: names that many objects share meet each other row once
    id_of = base.groupBy(F.upper("designation").alias("__d")).agg(F.min("id").alias("id1"))
    name_of = base.where("common_name is not null").groupBy(F.lower("common_name").alias("__c")).agg(F.min("id").alias("id2"))
    by_id = other.join(id_of, F.upper("name") == F.col("__d")).groupBy("oid").agg(F.min("id1").alias("id1"))
    by_name = other.join(name_of, F.lower("name") == F.col("__c")).groupBy("oid").agg(F.min("id2").alias("id2"))
    best = closest(base, other, reach_arcmin * ARCMIN)
    out = other.join(by_id, "oid", "left").join(by_name, "oid", "left").join(best, "oid", "left")
    return out.withColumns({"id": F.coalesce("id1", "id2", "id3"), "matched_by": F.when(F.col("id1").isNotNull(), "designation").when(F.col("id2").isNotNull(), "name").when(F.col("id3").isNotNull(), "position")}).drop("id1", "id2", "id3")


def aliases(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """First name of each key (by order) and all others, in order."""
    a = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name]))
    return rows.groupBy(key).agg(a.alias("__a")).select(key, F.get("__a", 0).alias("first_name"), F.array_join(F.slice("__a", F.lit(2), F.size("__a")), ";").alias("aliases"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def densify(vertices: DataFrame, by: tuple[str, ...] = ("poly",), step_deg: float = 1.0) -> DataFrame:
    """Cut the edges of closed polygons (``seq, ra, dec`` in degrees) into steps of at most ``step_deg``."""
    w = Window.partitionBy(*by).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = vertices.withColumns({"__r": F.coalesce(F.lead("ra").over(w), F.first("ra").over(whole)), "__d": F.coalesce(F.lead("dec").over(w), F.first("dec").over(whole))})
    turn = F.col("__r") - F.col("ra")
    turn = turn - 360 * F.floor((turn + 180) / 360)
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(turn), F.abs(F.col("__d") - F.col("dec"))) / step_deg)).cast("int")
    nxt = nxt.withColumns({"__turn": turn, "__n": n}).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    t = F.col("step") / F.col("__n")
    return nxt.select(*by, "seq", "step", F.pmod(F.col("ra") + t * F.col("__turn"), F.lit(360.0)).alias("ra"), (F.col("dec") + t * (F.col("__d") - F.col("dec"))).alias("dec"))


def figures(lines: DataFrame, stars: DataFrame) -> DataFrame:
    """Positions of the stars that lines of a figure (``name, line, numbers``) go through, in order."""
    points = lines.select("name", "line", F.posexplode("numbers").alias("k", "hr"))
    return points.join(stars.select("hr", "ra", "dec"), "hr").select("name", "line", "k", "ra", "dec")


def named(objects: DataFrame, names: DataFrame) -> DataFrame:
    """Objects with the common names of a table (``designation, common_name``); an error for names of no object."""
    unknown = [r.designation for r in names.join(objects, "designation", "left_anti").select("designation").limit(10).collect()]
    if unknown:
        raise ValueError(f"names of unknown objects: {unknown}")
    return objects.drop("common_name").join(names, "designation", "left")
