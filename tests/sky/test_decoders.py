import math
import struct
import zlib

import numpy as np
import pytest

from skyquilt.sources import jpeg, pixels, tiff

COS = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v, f"0{n}b") if n else ""

    def number(self, v):
        n = int(abs(v)).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def bytes(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def segment(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


#: every symbol has a code of 8 bits, its place in the list
DC, AC = list(range(12)), sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {r << 4 for r in range(16)})


def tables():
    one = lambda key, symbols: segment(0xC4, bytes([key]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    return one(0, DC) + one(16, AC)


def coefficients(plane, q):
    h, w = plane.shape
    a = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float) - 128
    blocks = a.reshape(a.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    f = np.einsum("ux,jkxy,vy->jkuv", COS, blocks, COS)
    return np.round(f.reshape(*f.shape[:2], 64)[:, :, jpeg.ZIGZAG] / q).astype(int)


def put_ac(w, block, low, high, shift=0):
    run = 0
    for k in range(low, high + 1):
        v = int(block[k])
        v = v >> shift if v >= 0 else -(-v >> shift)
        if not v:
            run += 1
            continue
        while run > 15:
            w.put(AC.index(0xF0), 8)
            run -= 16
        w.put(AC.index(run << 4 | int(abs(v)).bit_length()), 8)
        w.number(v)
        run = 0
    if run:
        w.put(AC.index(0), 8)


def put_refined(w, block, low, high, shift):
    """Correction bits of what is known, and new coefficients of one; no runs of blocks."""
    known = [abs(int(v)) >> (shift + 1) for v in block]
    new = [abs(int(v)) >> shift for v in block]
    last = max((k for k in range(low, high + 1) if new[k] == 1), default=-1)
    run, pending = 0, ""
    for k in range(low, high + 1):
        if known[k]:
            pending += str(new[k] & 1)
            continue
        if new[k] == 1 and k <= last:
            w.put(AC.index(run << 4 | 1), 8)
            w.put(int(block[k] > 0), 1)
            w.bits += pending
            run, pending = 0, ""
            continue
        run += 1
        if run == 16 and k < last:
            w.put(AC.index(0xF0), 8)
            w.bits += pending
            run, pending = 0, ""
    if run or pending:
        w.put(AC.index(0), 8)
        w.bits += pending


def encode(planes, q=2, progressive=False, restart=0, adobe=None):
    h, w = planes[0].shape
    c = [coefficients(p, q) for p in planes]
    n = len(planes)
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([q] * 64)) + tables()
    if adobe is not None:
        out += segment(0xEE, b"Adobe\0d\0\0\0\0" + bytes([adobe]))
    out += segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n)))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    rows, cols = c[0].shape[:2]
    scan = lambda keys, low, high, approx: segment(0xDA, bytes([len(keys)]) + b"".join(bytes([k + 1, 0]) for k in keys) + bytes([low, high, approx]))

    def write(keys, put):
        data, wr, before, count = b"", Writer(), [0] * n, 0
        for j in range(rows):
            for i in range(cols):
                if restart and count and count % restart == 0:
                    data += wr.bytes() + bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                    wr, before = Writer(), [0] * n
                for k in keys:
                    put(wr, c[k][j, i], k, before)
                count += 1
        return data + wr.bytes()

    def dc(shift):
        def put(wr, block, k, before):
            v = int(block[0]) >> shift
            d, before[k] = v - before[k], v
            wr.put(DC.index(int(abs(d)).bit_length()), 8)
            wr.number(d)

        return put

    if not progressive:
        def both(wr, block, k, before):
            dc(0)(wr, block, k, before)
            put_ac(wr, block, 1, 63)

        return out + scan(range(n), 0, 63, 0) + write(range(n), both) + b"\xff\xd9"
    out += scan(range(n), 0, 0, 0x01) + write(range(n), dc(1))
    for k in range(n):
        out += scan([k], 1, 5, 0x01) + write([k], lambda wr, b, *_: put_ac(wr, b, 1, 5, 1))
        out += scan([k], 6, 63, 0x01) + write([k], lambda wr, b, *_: put_ac(wr, b, 6, 63, 1))
    out += scan(range(n), 0, 0, 0x10) + write(range(n), lambda wr, b, *_: wr.put(int(b[0]) & 1, 1))
    for k in range(n):
        out += scan([k], 1, 63, 0x10) + write([k], lambda wr, b, *_: put_refined(wr, b, 1, 63, 0))
    return out + b"\xff\xd9"


def picture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:h, :w]
    return np.clip(120 + 60 * np.sin(xx / 5) + 40 * np.cos(yy / 3) + rng.normal(0, 12, (h, w)), 0, 255).round()


def test_zigzag():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg(progressive):
    a = picture(37, 53)
    got = jpeg.decode_jpeg(encode([a], progressive=progressive))
    assert got.shape == a.shape and np.abs(got - a).max() <= 6
    assert np.array_equal(got, jpeg.decode_jpeg(encode([a], progressive=not progressive)))
    three = [picture(24, 40, k) for k in range(3)]
    assert np.abs(jpeg.decode_jpeg(encode(three, progressive=progressive)) - three[0]).max() <= 6
    assert np.abs(jpeg.decode_jpeg(encode(three, progressive=progressive, adobe=0)) - sum(three)).max() <= 15
    assert np.array_equal(jpeg.decode_jpeg(encode([a], restart=3)), jpeg.decode_jpeg(encode([a])))


def test_camera_raw_preview():
    small, large = encode([picture(16, 16)]), encode([picture(48, 64)])
    raw = b"II*\0 maker notes " + small + b" more " + large + b" end"
    assert [p[0] for p in jpeg.previews(raw)] == [48 * 64, 256]
    assert np.array_equal(pixels.decode("a.cr2", raw)[1], jpeg.decode_jpeg(large))
    broken = large[:200] + b"\xff\xc3" + large[200:]
    assert jpeg.decode_preview(b"xx" + small + broken).shape in ((16, 16), (48, 64))
    with pytest.raises(ValueError):
        jpeg.decode_preview(b"nothing here")


def lzw(data):
    """Codes that never leave the first table: a clear code before each run of 200 bytes."""
    bits = ""
    for k in range(0, len(data), 200):
        bits += format(256, "09b") + "".join(format(b, "09b") for b in data[k : k + 200])
    bits += format(257, "09b")
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def tiff_file(parts, width, height, bits, channels=1, packing=1, form=1, meaning=1, predictor=1, rows=None, tile=None, order="<", extra=None):
    data, offsets = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0", []
    for p in parts:
        offsets.append(len(data))
        data += p
    tags = {256: width, 257: height, 258: [bits] * channels, 259: packing, 262: meaning, 277: channels, 317: predictor, 339: [form] * channels}
    if tile:
        tags |= {322: tile[0], 323: tile[1], 324: offsets, 325: [len(p) for p in parts]}
    else:
        tags |= {278: rows or height, 273: offsets, 279: [len(p) for p in parts]}
    tags |= extra or {}
    entries = b""
    for tag, v in sorted(tags.items()):
        v = v if isinstance(v, list) else [v]
        body = struct.pack(f"{order}{len(v)}I", *v)
        if len(body) > 4:
            place = len(data)
            data += body
            body = struct.pack(order + "I", place)
        entries += struct.pack(order + "HHI", tag, 4, len(v)) + body
    data[4:8] = struct.pack(order + "I", len(data))
    return bytes(data) + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"


def test_tiff():
    rng = np.random.default_rng(4)
    a8 = rng.integers(0, 256, (13, 20)).astype(np.uint8)
    strips = lambda a, n: [a[k : k + n].tobytes() for k in range(0, len(a), n)]
    assert np.array_equal(tiff.decode_tiff(tiff_file(strips(a8, 5), 20, 13, 8, rows=5)), a8)
    for packing, pack in ((8, zlib.compress), (5, lzw), (32773, lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100)))):
        assert np.array_equal(tiff.decode_tiff(tiff_file([pack(p) for p in strips(a8, 4)], 20, 13, 8, packing=packing, rows=4)), a8)
    for order in "<>":
        a16 = rng.integers(0, 65536, (6, 9)).astype(order + "u2")
        assert np.array_equal(tiff.decode_tiff(tiff_file([a16.tobytes()], 9, 6, 16, order=order)), a16)
        diff = np.diff(a16.astype(np.uint16), axis=1, prepend=np.uint16(0)).astype(order + "u2")
        assert np.array_equal(tiff.decode_tiff(tiff_file([diff.tobytes()], 9, 6, 16, predictor=2, order=order)), a16)
    f = rng.random((4, 6)).astype("<f4")
    assert np.array_equal(tiff.decode_tiff(tiff_file([f.tobytes()], 6, 4, 32, form=3)), f.astype(float))
    planes = f.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    assert np.array_equal(tiff.decode_tiff(tiff_file([np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()], 6, 4, 32, form=3, predictor=3)), f.astype(float))
    rgb = rng.integers(0, 256, (7, 10, 3)).astype(np.uint8)
    assert np.array_equal(tiff.decode_tiff(tiff_file([rgb.tobytes()], 10, 7, 8, 3, meaning=2)), rgb.sum(axis=2))
    padded = np.zeros((16, 32), np.uint8)
    padded[:13, :20] = a8
    tiles = [padded[:, k : k + 16].tobytes() for k in (0, 16)]
    assert np.array_equal(tiff.decode_tiff(tiff_file(tiles, 20, 13, 8, tile=(16, 16))), a8)
    bit = rng.integers(0, 2, (5, 12)).astype(np.uint8)
    assert np.array_equal(tiff.decode_tiff(tiff_file([np.packbits(bit, axis=1).tobytes()], 12, 5, 1, meaning=0)), 1 - bit)
    grey = picture(16, 24)
    got = tiff.decode_tiff(tiff_file([encode([grey])], 24, 16, 8, packing=7))
    assert np.abs(got - grey).max() <= 6
    with pytest.raises(ValueError):
        tiff.decode_tiff(tiff_file([b"1"], 20, 13, 8))


def test_lzw_with_growing_table():
    """Codes made the standard way, from a table that grows to ten bits."""
    data = bytes((k * k // 7) % 251 for k in range(3000))
    table, word, size, bits = {bytes([k]): k for k in range(256)}, b"", 9, format(256, "09b")
    nxt = 258
    for b in data:
        b = bytes([b])
        if word + b in table:
            word += b
            continue
        bits += format(table[word], f"0{size}b")
        table[word + b], nxt = nxt, nxt + 1
        if nxt == 4094:
            bits += format(256, f"0{size}b")
            table, nxt, size = {bytes([k]): k for k in range(256)}, 258, 9
        elif nxt >= 1 << size:
            size += 1
        word = b
    bits += format(table[word], f"0{size}b")
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.unpack_lzw(packed) == data
