"""TIFF to grey pixels: strips and tiles, of 1 to 64 bits, packed in the usual ways."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from skyquilt.sources.jpeg import decode_jpeg

#: Bytes of the field types, and their formats where they hold numbers.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8}
_FORMAT = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q"}


def unpack_bits(data: bytes) -> bytes:
    """PackBits."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first."""
    out, table, before, size, held, count = bytearray(), [bytes([k]) for k in range(256)] + [b"", b""], b"", 9, 0, 0
    for byte in data:
        held, count = held << 8 | byte, count + 8
        if count < size:
            continue
        count -= size
        code = held >> count
        held &= (1 << count) - 1
        if code == 257:
            break
        if code == 256:
            table, before, size = table[:258], b"", 9
            continue
        if not before:
            word = table[code]
        else:
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        out += word
        before = word
        if len(table) + 1 >= 1 << size and size < 12:
            size += 1
    return bytes(out)


class Directory:
    """The first image of a file."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None or struct.unpack(self.order + "H", data[2:4])[0] != 42:
            raise ValueError("no TIFF")
        at = struct.unpack(self.order + "I", data[4:8])[0]
        self.tags: dict[int, tuple] = {}
        for k in range(struct.unpack(self.order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, n = struct.unpack(self.order + "HHI", entry[:8])
            size = _SIZE.get(kind, 0) * n
            raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(self.order + "I", entry[8:])[0]) : p + size]
            self.tags[tag] = struct.unpack(f"{self.order}{n}{_FORMAT[kind]}", raw) if kind in _FORMAT else (raw,)

    def one(self, tag: int, default: int = 0) -> int:
        return self.tags.get(tag, (default,))[0]


def _differences(a: np.ndarray) -> np.ndarray:
    """Undo horizontal differences of rows x columns x channels of integers."""
    return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))


def _float_differences(a: np.ndarray, per: int, kind: np.dtype) -> np.ndarray:
    """Floats of rows whose bytes are sorted by significance and differenced; big-endian."""
    rows, size = len(a), kind.itemsize
    flat = np.cumsum(a.reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, size, -1)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, -1, per)


def decode_tiff(data: bytes) -> np.ndarray:
    d = Directory(data)
    width, height = d.one(256), d.one(257)
    bits, channels, packing, predictor = d.one(258, 1), d.one(277, 1), d.one(259, 1), d.one(317, 1)
    form, meaning, planes = d.one(339, 1), d.one(262, 1), d.one(284, 1)
    tiled = 322 in d.tags
    tile_w, tile_h = (d.one(322), d.one(323)) if tiled else (width, min(height, d.one(278, height) or height))
    offsets, sizes = d.tags[324 if tiled else 273], d.tags[325 if tiled else 279]
    across, down = -(-width // tile_w), -(-height // tile_h)
    per, sets = (1, channels) if planes == 2 else (channels, 1)
    kind = np.dtype(f"{d.order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{max(1, bits // 8)}".replace(" ", ""))
    tables = d.tags.get(347, (b"",))[0]
    tables = bytes(tables) if isinstance(tables, (bytes, bytearray)) else bytes(d.tags[347])
    out = np.zeros((height, width, channels))
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        plane, place = divmod(k, across * down)
        y, x = place // across * tile_h, place % across * tile_w
        rows = tile_h if tiled else min(tile_h, height - y)
        raw = data[offset : offset + size]
        if packing == 7:
            part = decode_jpeg(b"\xff\xd8" + tables[2:-2] + raw[2:] if len(tables) > 4 else raw)[:, :, None]
            out[y : y + rows, x : x + tile_w, plane : plane + 1] = part[: height - y, : width - x]
            continue
        raw = {1: lambda r: r, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}.get(packing, lambda r: b"")(raw)
        row = -(-tile_w * per * bits // 8)
        if len(raw) < row * rows:
            raise ValueError("this packing of TIFF is not decoded, or data are missing")
        a = np.frombuffer(raw, np.uint8, row * rows).reshape(rows, row)
        if bits < 8:
            s = np.unpackbits(a, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
            s = s[:, : tile_w * per].reshape(rows, tile_w, per)
        elif predictor == 3:
            s = _float_differences(a, per, kind)
        else:
            s = a.copy().view(kind).reshape(rows, tile_w, per)
            s = _differences(s) if predictor == 2 else s
        out[y : y + rows, x : x + tile_w, plane : plane + per] = s[: height - y, : width - x]
    if meaning == 3 and 320 in d.tags:
        colours = np.array(d.tags[320]).reshape(3, -1).sum(axis=0) // 256
        return colours[out[:, :, 0].astype(int)].astype(float)
    grey = out[:, :, : 3 if channels >= 3 else 1].sum(axis=2)
    return (1 << bits) - 1 - grey if meaning == 0 and form == 1 else grey
