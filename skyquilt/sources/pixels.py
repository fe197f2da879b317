"""Image files to grey pixels: FITS, PNG, JPEG, TIFF, BMP, camera raw previews and raw buffers.

``read_images`` takes Spark's binary file source; every file is decoded in numpy
in the task that reads it.  Colour planes are summed (of YCbCr the luma is
taken).  A file that can't be decoded gives an ``error``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.text import julian_epoch, parse_angle
from skyquilt.sources.jpeg import decode_jpeg, decode_preview
from skyquilt.sources.tiff import decode_tiff

IMAGES = "path string, format string, width int, height int, binning int, data binary, cards map<string,string>, error string"
_RAW_TYPES = {"u8": np.uint8, "u16": np.uint16, "f32": np.float32}


def kind_of(name: str, head: bytes) -> str:
    """Format by extension, then by the first bytes."""
    ext = name.lower().rsplit(".", 1)[-1]
    by_name = {"fits": "fits", "fit": "fits", "fts": "fits", "png": "png", "bmp": "bmp", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "cr2": "raw", "nef": "raw", "arw": "raw", "dng": "raw"}
    magic = ((b"SIMPLE", "fits"), (b"\x89PNG", "png"), (b"BM", "bmp"), (b"\xff\xd8", "jpeg"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"))
    for m, kind in magic:
        if head.startswith(m):
            return "raw" if kind == "tiff" and by_name.get(ext) == "raw" else kind
    return by_name.get(ext, "unknown")


def bin_sum(a: np.ndarray, b: int) -> np.ndarray:
    """Sums of b x b blocks; what fills no block is dropped."""
    if b == 1:
        return a
    h, w = a.shape[0] // b, a.shape[1] // b
    return a[: h * b, : w * b].reshape(h, b, w, b).sum(axis=(1, 3))


def fits_cards(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Keywords of the header at ``at``, and where its data begin."""
    cards: dict[str, str] = {}
    while True:
        card = data[at : at + 80].decode("latin-1")
        at += 80
        if len(card) < 80 or card.startswith("END"):
            break
        key, eq, rest = card[:8].strip(), card[8:10], card[10:]
        if eq == "= " and key:
            rest = rest.strip()
            cards[key] = rest[1:].split("'")[0].rstrip() if rest.startswith("'") else rest.split("/")[0].strip()
    return cards, -(-at // 2880) * 2880


def decode_fits(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """The first image of two axes or more; planes summed, NaN as 0, scaled by BSCALE and BZERO."""
    at = 0
    while at < len(data):
        cards, at = fits_cards(data, at)
        axes = [int(cards.get(f"NAXIS{k + 1}", 0)) for k in range(int(cards.get("NAXIS", 0)))]
        bits = int(cards.get("BITPIX", 8))
        size = int(np.prod(axes)) * abs(bits) // 8 if axes else 0
        if len(axes) >= 2 and "ZIMAGE" not in cards and cards.get("XTENSION", "IMAGE").startswith("IMAGE"):
            kind = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[bits]
            a = np.frombuffer(data, kind, int(np.prod(axes)), at).astype(np.float64).reshape(-1, axes[1], axes[0])
            a = np.nan_to_num(a, nan=0.0) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
            return a.sum(axis=0), cards
        at += -(-size // 2880) * 2880 + int(cards.get("PCOUNT", 0) or 0) // 2880 * 2880
    raise ValueError("no image")


def _unfilter(raw: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Rows of bytes of a PNG image without their filters."""
    step, row = max(1, bits // 8), -(-width * bits // 8)
    out = np.zeros((height, row), np.uint8)
    before = np.zeros(row, np.int64)
    for y in range(height):
        f, line = raw[y * (row + 1)], np.frombuffer(raw, np.uint8, row, y * (row + 1) + 1).astype(np.int64)
        if f == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step]) & 255
        elif f == 2:
            line = (line + before) & 255
        elif f in (3, 4):
            done = line.tolist()
            up = before.tolist()
            for x in range(row):
                a, b = done[x - step] if x >= step else 0, up[x]
                if f == 3:
                    done[x] = (done[x] + (a + b) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    done[x] = (done[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            line = np.array(done)
        before = line
        out[y] = line
    return out


def _samples(rows: np.ndarray, width: int, depth: int) -> np.ndarray:
    if depth == 16:
        return rows.view(">u2").astype(np.int64)
    if depth == 8:
        return rows.astype(np.int64)
    bits = np.unpackbits(rows, axis=1).reshape(rows.shape[0], -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:, :width].astype(np.int64)


def decode_png(data: bytes) -> np.ndarray:
    """Sum of the colour channels; alpha is ignored, palettes are looked up, interlaced images are joined."""
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3).astype(np.int64).sum(axis=1)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    width, height, depth, colour, _, _, lace = head
    raw, channels = zlib.decompress(body), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if lace else [(0, 0, 1, 1)]
    out, used = np.zeros((height, width)), 0
    for x0, y0, dx, dy in passes:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        row = -(-w * depth * channels // 8)
        rows = _unfilter(raw[used:], w, h, depth * channels)
        used += (row + 1) * h
        s = _samples(rows, w * channels, depth).reshape(h, w, channels)
        grey = palette[s[:, :, 0]] if colour == 3 else s[:, :, : 3 if channels >= 3 else 1].sum(axis=2)
        out[y0::dy, x0::dx] = grey
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 1 to 32 bits a pixel, bottom-up or top-down."""
    start, head = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    width, height, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    if packing not in (0, 3):
        raise ValueError("compressed bitmap")
    row, rows = -(-width * bits // 32) * 4, abs(height)
    a = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    if bits <= 8:
        count = struct.unpack("<I", data[46:50])[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, count * 4, 14 + head).reshape(-1, 4)[:, :3].astype(np.int64).sum(axis=1)
        grey = palette[_samples(a, width, bits)[:, :width]] if bits < 8 else palette[a[:, :width].astype(np.int64)]
    elif bits == 16:
        v = a.view("<u2")[:, :width].astype(np.int64)
        grey = (v & 31) + (v >> 5 & 31) + (v >> 10 & 31)
    else:
        grey = a[:, : width * (bits // 8)].reshape(rows, width, bits // 8)[:, :, :3].astype(np.int64).sum(axis=2)
    return (grey if height < 0 else grey[::-1]).astype(np.float64)


def decode_buffer(data: bytes, kind: str, width: int, height: int, stride: int | None = None) -> np.ndarray:
    """Native samples of ``u8``, ``u16`` or ``f32`` with ``stride`` samples a row."""
    stride = stride or width
    if width <= 0 or height <= 0 or stride < width:
        raise ValueError("bad size")
    a = np.frombuffer(data, _RAW_TYPES[kind])
    if len(a) < stride * (height - 1) + width:
        raise ValueError("too few samples")
    return np.stack([a[y * stride : y * stride + width] for y in range(height)]).astype(np.float64)


def decode(name: str, data: bytes) -> tuple[str, np.ndarray, dict[str, str]]:
    kind = kind_of(name, data[:8])
    if kind == "fits":
        a, cards = decode_fits(data)
        return kind, a, cards
    kinds = {"png": decode_png, "bmp": decode_bmp, "jpeg": decode_jpeg, "tiff": decode_tiff, "raw": decode_preview}
    if kind in kinds:
        return kind, kinds[kind](data), {}
    raise ValueError(f"{kind} images are not decoded")


def read_images(spark: SparkSession, path: str | list[str], binning: int = 0, most: int = 20_000_000) -> DataFrame:
    """A row for each file with its pixels as little-endian floats, binned until at most ``most`` (or by ``binning``)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    kind, a, cards = decode(name, bytes(data))
                    b = binning or 1
                    while not binning and a.size // (b * b) > most:
                        b += 1
                    a = bin_sum(a, b)
                    out.append((name, kind, a.shape[1], a.shape[0], b, a.astype("<f4").tobytes(), cards, None))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    out.append((name, kind_of(name, bytes(data[:8])), 0, 0, 1, None, {}, str(e)))
            yield pd.DataFrame(out, columns=["path", "format", "width", "height", "binning", "data", "cards", "error"])

    return files.mapInPandas(load, IMAGES)


def pixels_of(images: DataFrame) -> DataFrame:
    """``path, x, y, v`` of every pixel of decoded images."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, w, h, data in zip(batch["path"], batch["width"], batch["height"], batch["data"]):
                if data is not None:
                    y, x = np.divmod(np.arange(w * h), w)
                    yield pd.DataFrame({"path": name, "x": x.astype("int32"), "y": y.astype("int32"), "v": np.frombuffer(data, "<f4")})

    return images.select("path", "width", "height", "data").mapInPandas(spread, "path string, x int, y int, v float")


def hints(cards: Column) -> dict[str, Column]:
    """What a header knows of the field: an earlier solution, else pointing keywords; the pixel scale
    from its keywords, else from focal length and pixel size; the date."""
    number = lambda *names: F.coalesce(*(cards[n].try_cast("double") for n in names))
    solved = cards["CTYPE1"].startswith("RA---TAN")
    size, focal = number("XPIXSZ", "PIXSIZE1"), number("FOCALLEN")
    cd = F.sqrt(F.abs(number("CD1_1") * number("CD2_2") - number("CD1_2") * number("CD2_1"))) * 3600
    return {
        "ra": F.coalesce(F.when(solved, number("CRVAL1")), parse_angle(cards["RA"], hours=True), parse_angle(cards["OBJCTRA"], hours=True)),
        "dec": F.coalesce(F.when(solved, number("CRVAL2")), parse_angle(cards["DEC"]), parse_angle(cards["OBJCTDEC"])),
        "scale": F.coalesce(F.when(solved, cd), number("PIXSCALE", "SCALE", "SECPIX"), F.when(focal > 0, 206.264806 * size / focal)),
        "epoch": julian_epoch(F.to_timestamp(F.substring(cards["DATE-OBS"], 1, 10), "yyyy-MM-dd")),
        "bayer": cards["BAYERPAT"].isNotNull() & (F.coalesce(number("NAXIS3"), F.lit(1.0)) == 1),
    }
