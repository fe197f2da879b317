"""Pixel statistics and star lists: background, binning, filters, matching statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(values: Column | str) -> Column:
    """Aggregate: element n // 2 of the sorted values, the upper one of an even number."""
    a = F.array_sort(F.collect_list(values))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def order_statistic(values: Column | str, share: float) -> Column:
    """Aggregate: element ``floor(n * share)`` of the sorted values."""
    a = F.array_sort(F.collect_list(values))
    return F.get(a, F.least(F.size(a) - 1, F.floor(F.size(a) * F.lit(share)).cast("int")))


def tile_background(pixels: DataFrame, tile: int, by: tuple[str, ...] = ("image_id",), v: str = "v") -> DataFrame:
    """``tile_x, tile_y, median, sigma`` (1.4826 MAD) of each tile, with pixels over 3 sigma clipped and
    the statistics repeated once if over 8 are left.

    A tile holds a bounded number of pixels: they are collected once, and all else is array functions.
    """
    keys = [*by, "tile_x", "tile_y"]
    middle = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    spread = lambda a, m: 1.4826 * middle(F.array_sort(F.transform(a, lambda x: F.abs(x - m))))
    t = pixels.withColumns({"tile_x": F.floor(F.col("x") / tile).cast("int"), "tile_y": F.floor(F.col("y") / tile).cast("int")})
    t = t.groupBy(*keys).agg(F.array_sort(F.collect_list(v)).alias("__v")).withColumn("median", middle(F.col("__v")))
    t = t.withColumn("sigma", spread(F.col("__v"), F.col("median")))
    t = t.withColumn("__near", F.filter("__v", lambda x: F.abs(x - F.col("median")) <= 3 * F.col("sigma"))).withColumn("__m2", middle(F.col("__near")))
    again = F.size("__near") > 8
    return t.select(*keys, F.when(again, F.col("__m2")).otherwise(F.col("median")).alias("median"), F.when(again, spread(F.col("__near"), F.col("__m2"))).otherwise(F.col("sigma")).alias("sigma"))


def sigma_floor(tiles: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """No tile's sigma under a quarter of the image's median one, nor under 1e-6."""
    m = tiles.groupBy(*by).agg(upper_median("sigma").alias("__m"))
    return tiles.join(m, list(by)).withColumn("sigma", F.greatest("sigma", 0.25 * F.col("__m"), F.lit(1e-6))).drop("__m")


def median_filter(tiles: DataFrame, columns: tuple[str, ...] = ("median", "sigma"), by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """3 x 3 upper median of tile values; edges use the tiles there are."""
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = tiles.withColumn("__s", step).withColumns({"tile_x": F.col("tile_x") + F.col("__s.dx"), "tile_y": F.col("tile_y") + F.col("__s.dy")})
    keys = [*by, "tile_x", "tile_y"]
    filtered = spread.groupBy(*keys).agg(*(upper_median(c).alias(c) for c in columns))
    return filtered.join(tiles.select(*keys), keys, "left_semi")


def smooth5(pixels: DataFrame, by: tuple[str, ...] = ("image_id",), v: str = "v", out: str = "smooth") -> DataFrame:
    """Separable 5 x 5 Gaussian (1, 4, 6, 4, 1) / 16; pixels outside count as 0."""
    kernel = ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))
    tap = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(k / 16).alias("k")) for d, k in kernel)))
    rows = pixels.select(*by, "x", "y", F.col(v).alias("__v"))
    for axis in ("x", "y"):
        rows = rows.withColumn("__t", tap).withColumn(axis, F.col(axis) + F.col("__t.d")).withColumn("__v", F.col("__v") * F.col("__t.k"))
        rows = rows.groupBy(*by, "x", "y").agg(F.sum("__v").alias("__v"))
    return pixels.join(rows.withColumnRenamed("__v", out), [*by, "x", "y"])


def local_maxima(pixels: DataFrame, v: str, threshold: Column, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Pixels at ``threshold`` or more that exceed the neighbours before them and are not under those after."""
    around = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]
    tap = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around)))
    nb = pixels.select(*by, "x", "y", F.col(v).alias("__n")).withColumn("__t", tap)
    nb = nb.select(*by, (F.col("x") - F.col("__t.i")).alias("x"), (F.col("y") - F.col("__t.j")).alias("y"), (((F.col("__t.j") < 0) | ((F.col("__t.j") == 0) & (F.col("__t.i") < 0)))).alias("__before"), "__n")
    most = nb.groupBy(*by, "x", "y").agg(F.max(F.when(F.col("__before"), F.col("__n"))).alias("__b"), F.max(F.when(~F.col("__before"), F.col("__n"))).alias("__a"))
    hot = pixels.where(F.col(v) >= threshold).join(most, [*by, "x", "y"], "left")
    return hot.where((F.col("__b").isNull() | (F.col(v) > F.col("__b"))) & (F.col("__a").isNull() | (F.col(v) >= F.col("__a")))).drop("__a", "__b")


def binned(pixels: DataFrame, b: int, width: int, height: int, by: tuple[str, ...] = ("image_id",), v: str = "v") -> DataFrame:
    """Sums of b x b blocks; rows and columns that fill no block are dropped."""
    whole = pixels.where((F.col("x") < width // b * b) & (F.col("y") < height // b * b))
    return whole.groupBy(*by, F.floor(F.col("x") / b).cast("int").alias("x"), F.floor(F.col("y") / b).cast("int").alias("y")).agg(F.sum(v).alias(v))


def binning_for(width: int, height: int, bayer: bool, most: int = 20_000_000) -> int:
    """The least binning to at most 20 megapixels; 2 or more for bayer images."""
    b = 2 if bayer else 1
    while (width // b) * (height // b) > most:
        b += 1
    return b


def reduced(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int, by: tuple[str, ...] = ("image_id",), v: str = "v") -> DataFrame:
    """Mean of the pixels under each pixel of a smaller image."""
    return pixels.groupBy(*by, F.floor(F.col("x") * to_width / width).cast("int").alias("x"), F.floor(F.col("y") * to_height / height).cast("int").alias("y")).agg(F.avg(v).alias(v))


def stretch(pixels: DataFrame, every: int, by: tuple[str, ...] = ("image_id",), v: str = "v") -> DataFrame:
    """``median, mad, white`` (99.95 %) of every ``every``-th pixel in order of y, x."""
    w = Window.partitionBy(*by).orderBy("y", "x")
    some = pixels.withColumn("__n", F.row_number().over(w) - 1).where(F.col("__n") % every == 0)
    m = some.groupBy(*by).agg(upper_median(v).alias("median"), order_statistic(v, 0.9995).alias("white"))
    dev = some.join(m, list(by)).groupBy(*by).agg(upper_median(F.abs(F.col(v) - F.col("median"))).alias("mad"))
    return m.join(dev, list(by))


def midtones(value: Column, m: Column) -> Column:
    """Midtones transfer function."""
    return (m - 1) * value / ((2 * m - 1) * value - m)


def midtones_for(value: Column, target: float) -> Column:
    """The midtones balance that maps ``value`` to ``target``."""
    return value * (1 - target) / (value - 2 * target * value + target)


def kept_or_all(stars: DataFrame, keep: Column, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Stars that ``keep`` accepts; all of them where fewer than 4 would stay."""
    w = Window.partitionBy(*by)
    marked = stars.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    return marked.withColumn("__n", F.sum(F.col("__keep").cast("int")).over(w)).where(F.col("__keep") | (F.col("__n") < 4)).drop("__keep", "__n")


def with_median_fwhm(stars: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Add ``median_fwhm`` of each image (upper median)."""
    return stars.join(stars.groupBy(*by).agg(upper_median("fwhm").alias("median_fwhm")), list(by))


def compact(stars: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Stars not much wider than the image's median, or concentrated."""
    return kept_or_all(with_median_fwhm(stars, by), (F.col("fwhm") <= 4 * F.col("median_fwhm")) | (F.col("concentration") >= 0.9), by).drop("median_fwhm")


def concentrated(stars: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return kept_or_all(stars, F.col("concentration") >= 0.6, by)


def point_sources(stars: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Narrow, concentrated stars with their ``peak``, to be taken by decreasing peak."""
    narrow = stars.where("concentration >= 0.9").groupBy(*by).agg(order_statistic("fwhm", 0.1).alias("__w"))
    found = stars.where("concentration >= 0.9").join(narrow, list(by)).where(F.col("fwhm") <= 1.5 * F.col("__w")).drop("__w")
    return found.withColumn("peak", F.col("concentration") * F.col("flux") / (F.col("fwhm") * F.col("fwhm")))


def ranked(stars: DataFrame, order: str, most: int, by: tuple[str, ...] = ("image_id",), tie: str = "star") -> DataFrame:
    """The ``most`` first of each image by decreasing ``order``, with ``rank`` from 0."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), tie)
    # filtered as a row number, so that Spark prunes before the shuffle
    return stars.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).withColumn("rank", F.col("__rn") - 1).drop("__rn")


def even_sample(stars: DataFrame, count: int, order: str = "rank", by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """At most ``count`` stars of each image, evenly spaced: places ``k * n // count``."""
    w = Window.partitionBy(*by)
    placed = stars.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    first = F.ceil(F.col("__i") * count / F.col("__n"))
    return placed.where((F.col("__n") <= count) | (F.floor(first * F.col("__n") / count) == F.col("__i"))).drop("__i", "__n")


def rms(pairs: DataFrame, by: tuple[str, ...] = ("image_id",), r2: str = "d2") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(r2)).alias("rms"))


def sigma_clip(pairs: DataFrame, by: tuple[str, ...] = ("image_id",), r2: str = "d2") -> DataFrame:
    """One round: residuals over 3 sigma (0.2 at least) go; sigma is the Rayleigh one of the median.
    Images of under 8 pairs stay as they are."""
    m = pairs.groupBy(*by).agg(upper_median(F.sqrt(r2)).alias("__m"), F.count(F.lit(1)).alias("__n"))
    limit = F.greatest(3 * F.col("__m") / 1.1774, F.lit(0.2))
    return pairs.join(m, list(by)).where((F.col("__n") < 8) | (F.sqrt(r2) <= limit)).drop("__m", "__n")


def simplest_model(models: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The lowest ``sip_order`` whose rms is within 3 % of the best."""
    best = models.groupBy(*by).agg(F.min("rms").alias("__b"))
    return models.join(best, list(by)).where(F.col("rms") <= 1.03 * F.col("__b")).groupBy(*by).agg(F.min("sip_order").alias("sip_order"))


def chance_pairs(refs: Column, stars: Column, radius: Column, width: Column, height: Column) -> Column:
    return refs * F.least(F.lit(1.0), stars * F.pi() * radius * radius / (width * height))


def doubtful(pairs: Column, refs: Column, rms_px: Column, log_odds: Column, chance: Column) -> Column:
    """Whether a solution matches hardly more than chance would, or too little of its field too badly."""
    return F.when(pairs < 5 * chance, True).when((pairs >= 30) & (pairs >= 20 * chance), False).otherwise((pairs < 0.2 * refs) & ((rms_px > 1.5) | (log_odds < 50)))


def verify(evidence: DataFrame, by: tuple[str, ...], order: tuple[str, ...], odds: str = "log_odds", accept: float = 20.72326583694641, bail: float = -13.815510557964274) -> DataFrame:
    """``accepted, best, used`` of each hypothesis from its ordered log-odds.

    A hypothesis is accepted once the running sum reaches ln 1e9 and abandoned
    when it falls under -ln 1e6 before that; terms after that don't count.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    run = evidence.withColumn("__s", F.sum(odds).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumns({"__best": F.greatest(F.lit(0.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))), "__i": F.row_number().over(w)})
    gone = run.where((F.col("__best") < accept) & (F.col("__s") < bail)).groupBy(*by).agg(F.min("__i").alias("__end"))
    used = run.join(gone, list(by), "left").where(F.col("__end").isNull() | (F.col("__i") <= F.col("__end")))
    return used.groupBy(*by).agg((F.max("__end").isNull() & (F.max("__best") >= accept)).alias("accepted"), F.max("__best").alias("best"), F.count(F.lit(1)).alias("used"))


def evidence(d2: Column, variance: Column, density: Column, miss: float = 0.25) -> Column:
    """Log-odds of a catalog star with (or, if ``d2`` is null, without) a counterpart."""
    foreground = F.exp(-d2 / (2 * variance)) / (2 * F.pi() * variance)
    return F.coalesce(F.log(miss + (1 - miss) * foreground / density), F.log(F.lit(miss)))


def normal_equations(pairs: DataFrame, basis: list[Column], target: Column, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Sums ``a_i_j`` and ``b_i`` of a linear least-squares problem for each group."""
    n = len(basis)
    sums = [F.sum(basis[i] * basis[j]).alias(f"a_{i}_{j}") for i in range(n) for j in range(i, n)]
    return pairs.groupBy(*by).agg(*sums, *(F.sum(basis[i] * target).alias(f"b_{i}") for i in range(n)))


def solve3(a: dict[str, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Cramer's rule for a symmetric 3 x 3 system; null if it is singular."""
    g = lambda i, j: a[f"a_{min(i, j)}_{max(i, j)}"]

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    base = [[g(i, j) for j in range(3)] for i in range(3)]
    d = det(base)
    return tuple(F.when(F.abs(d) > 1e-300, det([[b[i] if j == k else base[i][j] for j in range(3)] for i in range(3)]) / d) for k in range(3))
