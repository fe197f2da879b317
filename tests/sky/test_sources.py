import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.plans.sky import union_catalogs
from skyquilt.sinks import tables
from skyquilt.sinks import text as out
from skyquilt.operators.grid import RingGrid
from skyquilt.operators import pyramid
from skyquilt.sources import catalogs, pixels
from tests.sky import synthetic


def test_gaia_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("ra,dec,pmra,pmdec,phot_g_mean_mag\n10.5,-20.25,1.5,-2.5,12.25\n359.9,89.9,,,8.5\n1,2,3,4,\n5,6\n7,8,NaN,1,9\n")
    rows = sorted(catalogs.gaia_csv(spark, str(tmp_path / "g.csv")).collect(), key=lambda r: r.mag)
    assert [(round(math.degrees(r.ra), 6), r.pm_ra, r.pm_dec, r.mag) for r in rows] == [(359.9, 0, 0, 8.5), (7, 0, 1, 9), (10.5, 1.5, -2.5, 12.25)]


def line(fields, length):
    chars = [" "] * length
    for start, text in fields.items():
        chars[start - 1 : start - 1 + len(text)] = text
    return "".join(chars)


def test_tycho2(spark, tmp_path):
    main = [line({16: "  2.31750494", 29: "  2.23184345", 42: "  -16.3", 50: "   -9.0", 111: "12.146", 124: "12.146"}, 206), line({153: "  1.00000000", 166: " -2.00000000", 111: "10.500"}, 206), line({16: "  2.31750494", 29: "  2.23184345"}, 206)]
    (tmp_path / "m").write_text("\n".join(main) + "\n")
    rows = sorted(catalogs.tycho2(spark, str(tmp_path / "m")).collect(), key=lambda r: -r.mag)
    assert [(round(math.degrees(r.ra), 8), round(math.degrees(r.dec), 8), r.pm_ra, r.pm_dec, round(r.mag, 3)) for r in rows] == [(2.31750494, 2.23184345, -16.3, -9.0, 12.146), (1.0, -2.0, 0.0, 0.0, 10.5)]
    (tmp_path / "s").write_text(line({16: " 10.00000000", 29: "  0.00000000", 42: " 1000.0", 50: "-1000.0", 97: "11.000"}, 122) + "\n")
    r = catalogs.tycho2_supplement(spark, str(tmp_path / "s")).first()
    assert abs(math.degrees(r.ra) - 10 - 8.75 / 3600) < 1e-9 and abs(math.degrees(r.dec) + 8.75 / 3600) < 1e-9 and r.mag == 11.0
    both = catalogs.tycho2(spark, str(tmp_path / "m"))
    assert union_catalogs(both, catalogs.tycho2_supplement(spark, str(tmp_path / "s"))).count() == 3
    with pytest.raises(ValueError):
        union_catalogs(both, both.withColumn("epoch", F.lit(2016.0)))


def test_deep_sky_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Name;Type;RA;Dec;MajAx;MinAx;PosAng;B-Mag;V-Mag;M;Identifiers;Common names\nNGC0224;G;00:42:44.35;+41:16:08.6;177.83;69.66;35;4.29;3.44;031;;Andromeda Galaxy\nX1;Dup;1:0:0;1:0:0;;;;;;;;\nX2;G;;;;;;;;;;\nX3;OC;01:00:00.00;-00:30:00.0;;;;9.5;;;;\n")
    rows = sorted(catalogs.open_ngc(spark, str(tmp_path / "n.csv")).collect(), key=lambda r: r.designation)
    assert [r.designation for r in rows] == ["NGC0224", "X3"] and abs(math.degrees(rows[0].ra) - 10.68479) < 1e-4 and rows[0].messier == 31 and rows[0].mag == 3.44
    assert abs(math.degrees(rows[1].dec) + 0.5) < 1e-9 and rows[1].mag == 9.5 and rows[1].major is None
    (tmp_path / "v.tsv").write_text("#c\n\n_RAJ2000\t_DEJ2000\tSh2\tDiam\ndeg\tdeg\t \tarcmin\n-----\t----\t---\t---\n10.5\t-3.25\t  1\t 30\n11\t2\t2\t\n")
    got = sorted(catalogs.vizier_tsv(spark, str(tmp_path / "v.tsv"), ["_RAJ2000", "Sh2", "Diam"]).collect())
    assert [tuple(r) for r in got] == [("10.5", "1", "30"), ("11", "2", None)]
    (tmp_path / "b").write_text(line({1: "  15", 76: "00", 78: "08", 80: "23.3", 84: "+", 85: "29", 87: "05", 89: "26", 103: " 2.06"}, 197) + "\n" + line({1: "  92"}, 197) + "\n")
    r = catalogs.bright_stars(spark, str(tmp_path / "b")).collect()
    assert len(r) == 1 and r[0].hr == 15 and r[0].mag == 2.06 and abs(math.degrees(r[0].dec) - 29.090556) < 1e-5
    (tmp_path / "c").write_text("0.0 24.0 88.0 UMi Ursa Minor\n8.0 14.5 86.5 UMi Ursa Minor\n")
    assert [tuple(r) for r in catalogs.constellation_rows(spark, str(tmp_path / "c")).collect()] == [(0, 0.0, 24.0, 88.0, "UMi", "Ursa Minor"), (1, 8.0, 14.5, 86.5, "UMi", "Ursa Minor")]


def fits_file(a, cards=()):
    kind = {"uint8": 8, "int16": 16, "int32": 32, "float32": -32, "float64": -64}[a.dtype.name]
    head = ["SIMPLE  =                    T", f"BITPIX  = {kind:20d}", f"NAXIS   = {a.ndim:20d}", *(f"NAXIS{k + 1}  = {n:20d}" for k, n in enumerate(a.shape[::-1])), *cards, "END"]
    text = "".join(c.ljust(80) for c in head)
    data = a.astype(a.dtype.newbyteorder(">")).tobytes()
    return text.ljust(-(-len(text) // 2880) * 2880).encode() + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def png_file(a, depth, colour, palette=None, filters=(0,)):
    h, w, channels = a.shape
    if depth == 16:
        rows = a.astype(">u2").reshape(h, -1).view(np.uint8)
    elif depth == 8:
        rows = a.astype(np.uint8).reshape(h, -1)
    else:
        bits = ((a.reshape(h, -1)[:, :, None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8).reshape(h, -1)
        rows = np.packbits(bits, axis=1)
    step, raw, before = max(1, depth * channels // 8), b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows.astype(int)):
        f = filters[y % len(filters)]
        left = np.r_[np.zeros(step, int), row[:-step]]
        upleft = np.r_[np.zeros(step, int), before[:-step]]
        p = left + before - upleft
        pa, pb, pc = abs(p - left), abs(p - before), abs(p - upleft)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, before, upleft))
        raw += bytes([f]) + ((row - [0 * row, left, before, (left + before) // 2, paeth][f]) & 255).astype(np.uint8).tobytes()
        before = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoders():
    rng = np.random.default_rng(1)
    for kind in ("uint8", "int16", "int32", "float32", "float64"):
        a = (rng.random((3, 7, 11)) * 100).astype(kind)
        got, cards = pixels.decode_fits(fits_file(a, ["BZERO   =                 10.5", "OBJECT  = 'It is / M31'"]))
        assert np.allclose(got, (a.astype(float) + 10.5).sum(axis=0)) and cards["OBJECT"] == "It is / M31"
    for depth, colour, channels in ((8, 0, 1), (16, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (8, 6, 4), (16, 6, 4)):
        a = rng.integers(0, 1 << depth, (9, 13, channels))
        got = pixels.decode_png(png_file(a, depth, colour, filters=(0, 1, 2, 3, 4)))
        assert np.array_equal(got, a[:, :, : 3 if channels >= 3 else 1].sum(axis=2))
    palette = rng.integers(0, 256, (16, 3))
    a = rng.integers(0, 16, (5, 6, 1))
    assert np.array_equal(pixels.decode_png(png_file(a, 4, 3, palette)), palette[a[:, :, 0]].sum(axis=2))
    a = rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    rows = b"".join(r.tobytes().ljust(16, b"\0") for r in a[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 4, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.array_equal(pixels.decode_bmp(bmp), a.astype(int).sum(axis=2))
    assert np.array_equal(pixels.decode_buffer(np.arange(12, dtype=np.uint16).tobytes(), "u16", 3, 3, 4), [[0, 1, 2], [4, 5, 6], [8, 9, 10]])
    with pytest.raises(ValueError):
        pixels.decode_buffer(b"12", "u8", 3, 3)


def test_read_images_and_hints(spark, tmp_path):
    a = np.arange(48, dtype=np.int16).reshape(6, 8)
    cards = ["OBJCTRA = '05 35 12'", "OBJCTDEC= '-05 24 00'", "FOCALLEN=                500.0", "XPIXSZ  =                  3.8", "DATE-OBS= '2024-07-01T01:02:03'"]
    (tmp_path / "a.fits").write_bytes(fits_file(a, cards))
    (tmp_path / "b.png").write_bytes(b"\x89PNG broken")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff")
    got = {r.path.rsplit("/", 1)[-1]: r for r in pixels.read_images(spark, str(tmp_path), binning=2).collect()}
    assert got["b.png"].error and got["c.jpg"].error and got["a.fits"].error is None
    assert (got["a.fits"].width, got["a.fits"].height) == (4, 3)
    images = pixels.read_images(spark, str(tmp_path / "a.fits"))
    assert {(r.x, r.y): r.v for r in pixels.pixels_of(images).collect()} == {(x, y): float(a[y, x]) for x in range(8) for y in range(6)}
    h = images.select(*(c.alias(k) for k, c in pixels.hints(F.col("cards")).items())).first()
    assert abs(h.ra - 83.8) < 1e-9 and abs(h.dec + 5.4) < 1e-9 and abs(h.scale - 206.264806 * 3.8 / 500) < 1e-9 and abs(h.epoch - (2024 + 182 / 365.25)) < 1e-9 and h.bayer is False


def test_index_files(spark, tmp_path):
    stars, grids = pyramid.build_pyramid(spark.createDataFrame(synthetic.sky(500)), pyramid.PyramidOptions(min_cell_deg=8))
    quads = spark.createDataFrame([(1, 2, 3, 4)], "cx int, cy int, dx int, dy int")
    tables.write_index(str(tmp_path / "i"), stars, grids, quads)
    back, again, q = tables.read_index(spark, str(tmp_path / "i"))
    assert back.count() == 500 and [g.cells for g in again] == [g.cells for g in grids] and q.count() == 1
    plan = RingGrid(grids[0].cell_size).cone_filter(back.where("level = 0"), 1.0, 0.2, 0.1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    good = tables.manifest(files)
    assert tables.verified(files, good).count() == 0 and tables.verified(files, good.withColumn("size", F.lit(9).cast("long"))).count() == 1


def test_result_text(spark):
    c = spark.range(1).select(out.card(F.lit("CRVAL1"), F.lit("1.5")).alias("a"), out.card(F.lit("CTYPE1"), F.lit("RA---TAN"), True).alias("b"), out.header(F.array(F.lit("x" * 80))).alias("h")).first()
    assert c.a == "CRVAL1  =                  1.5".ljust(80) and c.b == "CTYPE1  = 'RA---TAN'".ljust(80) and len(c.h) == 2880 and c.h[80:83] == "END"
    r = spark.range(1).select(out.report(F.lit(83.8), F.lit(-5.4), F.lit(1.5), F.lit(1600), F.lit(1200), F.lit(42), F.array(*(F.lit(f"M {k}") for k in range(7)))).alias("r")).first().r
    assert r.splitlines() == ["Centre: 05:35:12.00 -05:24:00.0", "Scale: 1.500 arcsec/px", "Field: 0.67 x 0.50 deg", "Stars: 42", "Objects: M 0, M 1, M 2, M 3, M 4 and 2 more"]
    e = out.exit_code(spark.createDataFrame([(True,), (False,)], "solved boolean")).first()
    assert e.exit_code == 1


def test_fits_header_update(spark, tmp_path):
    from skyquilt.sinks import fitsfiles

    a = np.arange(12, dtype=np.int16).reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(fits_file(a, ["CRPIX1  =                  9.0", "CD1_2   =                  1.0", "OBJECT  = 'x'", "A_0_2   = 1"]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = files.first().path
    cards = spark.createDataFrame([(path, ["CRPIX1  =                  2.5", "CTYPE1  = 'RA---TAN'"])], "path string, cards array<string>")
    got = bytes(fitsfiles.with_solutions(files, cards).first().content)
    back, keys = pixels.decode_fits(got)
    assert np.array_equal(back, a) and keys["CRPIX1"] == "2.5" and keys["CTYPE1"] == "RA---TAN" and keys["OBJECT"] == "x" and "CD1_2" not in keys and "A_0_2" not in keys
    assert len(got) % 2880 == 0
    with pytest.raises(ValueError):
        fitsfiles.updated(b"SIMPLE", [])


def test_thumbnails(spark, tmp_path):
    from skyquilt.sinks import png

    rng = np.random.default_rng(2)
    a = (1000 + rng.normal(0, 10, (90, 130))).astype(np.float32)
    a[40:44, 60:64] = 30000
    (tmp_path / "a.fits").write_bytes(fits_file(a))
    row = png.thumbnails(pixels.read_images(spark, str(tmp_path)), 64).first()
    small = pixels.decode_png(bytes(row.png))
    assert small.shape == (30, 44) and small.max() == 255 and 20 < np.median(small) < 90
    assert not png.thumbnail(np.full((5, 5), 3.0)).any()


def test_listing_names_and_checks(spark):
    from skyquilt.operators import enrich, solve

    got = {r.name: r.json for r in out.catalog_listing(spark.createDataFrame([("a", 5), ("b", 6)], "name string, size long"), spark.createDataFrame([("b", 9), ("c", 1)], "name string, stars long")).collect()}
    assert got == {"a": '{"name":"a","installed":false,"size":5}', "b": '{"name":"b","installed":true,"size":6,"stars":9}', "c": '{"name":"c","installed":true,"stars":1}'}
    objects = spark.createDataFrame([("NGC 1", None), ("NGC 2", None)], "designation string, common_name string")
    assert sorted(str(r.common_name) for r in enrich.named(objects, spark.createDataFrame([("NGC 1", "One")], "designation string, common_name string")).collect()) == ["None", "One"]
    with pytest.raises(ValueError):
        enrich.named(objects, spark.createDataFrame([("NGC 3", "x")], "designation string, common_name string"))
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "image_id long, quad long")
    checks = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 50.0, 50.0), (1, 3, -5.0, 3.0)], "image_id long, quad long, kx double, ky double")
    det = spark.createDataFrame([(1, 12.0, 9.0), (2, 50.0, 50.0)], "image_id long, x double, y double")
    sizes = spark.createDataFrame([(1, 100, 100)], "image_id long, width int, height int")
    assert sorted(r.quad for r in solve.checks_present(found, checks, det, sizes).collect()) == [1, 3]


def test_objects_in_fields_of_any_size(spark):
    from skyquilt.operators import enrich

    rng = np.random.default_rng(4)
    objects = [(k, None, 0, 0, None, float(rng.uniform(0, 6.28)), float(np.arcsin(rng.uniform(-1, 1))), float(rng.choice([1, 100, 900, 3000])), 5.0) for k in range(300)]
    fields = [(k, float(rng.uniform(0, 6.28)), float(np.arcsin(rng.uniform(-1, 1))), float(rng.uniform(0, 0.6))) for k in range(20)]
    df = spark.createDataFrame(objects, "id long, designation string, catalog int, messier int, common_name string, ra double, dec double, major double, mag double")
    got = {(r.field, r.id) for r in enrich.in_fields(df, spark.createDataFrame(fields, "field long, field_ra double, field_dec double, field_radius double")).collect()}
    v = lambda a, d: np.array([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])
    want = {(f[0], o[0]) for f in fields for o in objects if np.arccos(np.clip(v(f[1], f[2]) @ v(o[5], o[6]), -1, 1)) <= f[3] + o[7] / 60 / 2 * np.pi / 180}
    assert got == want and len(want) > 100
