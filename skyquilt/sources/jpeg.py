"""JPEG to grey pixels: baseline and progressive Huffman images of 8 bits.

Coefficients of all scans are gathered first; blocks are then transformed at
once as matrix products.  A YCbCr image gives its luma, so chroma blocks are
parsed but never transformed; an RGB image gives the sum of its channels.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed value: the order of coefficients in a block.
ZIGZAG = [int(v) for v in sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))]
_COSINES = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    blocks_x: int = 0
    blocks_y: int = 0
    grid_x: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


class Bits:
    """Bits of entropy-coded data without stuffing; zeros after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            self.held = (self.held << 32) | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")
            self.at += 4
            self.count += 32

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.count -= n
        out = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return out

    def symbol(self, table: list[int]) -> int:
        self.need(16)
        entry = table[(self.held >> (self.count - 16)) & 0xFFFF]
        self.count -= entry >> 8
        self.held &= (1 << self.count) - 1
        return entry & 255

    def signed(self, n: int) -> int:
        """A value of ``n`` bits, of which the lower half stands for negative ones."""
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For all 16 bits that may come next: length of the code times 256, and its symbol."""
    table, code, k = [1 << 8] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = [length << 8 | symbols[k]] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return table


class Decoder:
    def __init__(self, data: bytes):
        self.data = data
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, list[int]] = {}
        self.components: list[Component] = []
        self.restart, self.adobe, self.progressive = 0, None, False
        self.width = self.height = 0

    def decode(self) -> np.ndarray:
        at = 2
        while at + 4 <= len(self.data):
            if self.data[at] != 0xFF:
                at += 1
                continue
            kind = self.data[at + 1]
            if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
                continue
            if kind == 0xD9:
                break
            size = struct.unpack(">H", self.data[at + 2 : at + 4])[0]
            body, at = self.data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quantization(body)
            elif kind == 0xC4:
                self._tables(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("this kind of JPEG is not decoded")
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif kind == 0xDA:
                at = self._scan(body, at)
        if not self.components:
            raise ValueError("no image")
        return self._pixels()

    def _quantization(self, b: bytes) -> None:
        while b:
            n = 2 if b[0] >> 4 else 1
            values = np.frombuffer(b[1 : 1 + 64 * n], ">u2" if n == 2 else np.uint8).astype(np.int32)
            self.quant[b[0] & 15], b = values, b[1 + 64 * n :]

    def _tables(self, b: bytes) -> None:
        while b:
            n = sum(b[1:17])
            self.huffman[b[0]], b = _huffman(b[1:17], b[17 : 17 + n]), b[17 + n :]

    def _frame(self, b: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", b[:6])
        if bits != 8 or not self.width or not self.height:
            raise ValueError("only JPEG of 8 bits and known size are decoded")
        self.progressive = progressive
        self.components = [Component(b[6 + 3 * k], b[7 + 3 * k] >> 4, b[7 + 3 * k] & 15, b[8 + 3 * k]) for k in range(n)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.blocks_x, c.blocks_y = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.grid_x = self.mcus_x * c.h
            c.coefficients = np.zeros((c.grid_x * self.mcus_y * c.v, 64), np.int32)

    def _scan(self, b: bytes, at: int) -> int:
        chosen = [(next(c for c in self.components if c.key == b[1 + 2 * k]), b[2 + 2 * k] >> 4, b[2 + 2 * k] & 15) for k in range(b[0])]
        low, high, approx = b[1 + 2 * b[0] : 4 + 2 * b[0]]
        end, parts, begin = at, [], at
        while end + 1 < len(self.data):
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                end = len(self.data)
                break
            if self.data[end + 1] == 0:
                end += 2
            elif 0xD0 <= self.data[end + 1] <= 0xD7:
                parts.append(self.data[begin:end])
                begin = end = end + 2
            else:
                break
        parts.append(self.data[begin:end])
        if len(chosen) == 1:  # one component: its own blocks in rows
            c = chosen[0][0]
            order = [[(0, y * c.grid_x + x)] for y in range(c.blocks_y) for x in range(c.blocks_x)]
        else:
            order = [[(k, (my * c.v + y) * c.grid_x + mx * c.h + x) for k, (c, _, _) in enumerate(chosen) for y in range(c.v) for x in range(c.h)] for my in range(self.mcus_y) for mx in range(self.mcus_x)]
        step = self.restart or len(order)
        for k, part in enumerate(parts):
            self._entropy(Bits(part.replace(b"\xff\0", b"\xff")), order[k * step : (k + 1) * step], chosen, low, high, approx >> 4, approx & 15)
        return end

    def _entropy(self, bits: Bits, order: list, chosen: list, low: int, high: int, above: int, below: int) -> None:
        before, run = [0] * len(chosen), 0
        for mcu in order:
            for k, block in mcu:
                c, dc, ac = chosen[k]
                row = c.coefficients[block]
                if not self.progressive:
                    before[k] += bits.signed(bits.symbol(self.huffman[dc]))
                    row[0] = before[k]
                    self._run_lengths(bits, row, self.huffman[16 + ac], 1, 63, 0)
                elif low == 0:
                    if above:
                        row[0] |= bits.take(1) << below
                    else:
                        before[k] += bits.signed(bits.symbol(self.huffman[dc]))
                        row[0] = before[k] << below
                elif above:
                    run = self._refine(bits, row, self.huffman[16 + ac], low, high, 1 << below, run)
                elif run:
                    run -= 1
                else:
                    run = self._run_lengths(bits, row, self.huffman[16 + ac], low, high, below)

    @staticmethod
    def _run_lengths(bits: Bits, row: np.ndarray, table: list[int], k: int, high: int, below: int) -> int:
        """Coefficients up to the end of the block; gives how many more blocks have none."""
        while k <= high:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                row[k & 63] = bits.signed(size) * (1 << below)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) - 1 + bits.take(zeros)
        return 0

    @staticmethod
    def _refine(bits: Bits, row: np.ndarray, table: list[int], k: int, high: int, one: int, run: int) -> int:
        """One more bit of known coefficients, and new ones of that size."""

        def correct(i: int) -> None:
            if bits.take(1) and not abs(row[i]) & one:
                row[i] += one if row[i] > 0 else -one

        while not run and k <= high:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = (one if bits.take(1) else -one) if size else 0
            while k <= high:
                if row[k]:
                    correct(k)
                elif not zeros:
                    row[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for i in range(k, high + 1):
                if row[i]:
                    correct(i)
            run -= 1
        return run

    def _plane(self, c: Component) -> np.ndarray:
        natural = np.zeros((len(c.coefficients), 64))
        natural[:, ZIGZAG] = c.coefficients * self.quant[c.table]
        blocks = np.einsum("ux,nuv,vy->nxy", _COSINES, natural.reshape(-1, 8, 8), _COSINES, optimize=True)
        rows = blocks.reshape(-1, c.grid_x, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.grid_x * 8)
        a = np.clip(np.floor(rows + 128.5), 0, 255)
        if (c.h, c.v) != (self.h, self.v):
            a = a.repeat(self.v // c.v, axis=0).repeat(self.h // c.h, axis=1)
        return a[: self.height, : self.width]

    def _pixels(self) -> np.ndarray:
        n = len(self.components)
        rgb = n == 3 and (self.adobe == 0 or (self.adobe is None and [c.key for c in self.components] == [82, 71, 66]))
        if n == 1 or (n == 3 and not rgb):
            return self._plane(self.components[0])
        return sum(self._plane(c) for c in self.components[:3])


def decode_jpeg(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    return Decoder(data).decode()


def previews(data: bytes) -> list[tuple[int, int, int]]:
    """(area, start, end) of the JPEG images inside a camera raw file, largest first."""
    out, at = [], 0
    while (at := data.find(b"\xff\xd8\xff", at)) >= 0:
        end, area, k = data.find(b"\xff\xd9", at + 3), 0, at + 2
        while k + 9 < len(data) and data[k] == 0xFF and data[k + 1] != 0xDA:
            kind, size = data[k + 1], struct.unpack(">H", data[k + 2 : k + 4])[0]
            if kind in (0xC0, 0xC1, 0xC2):
                h, w = struct.unpack(">HH", data[k + 5 : k + 9])
                area = h * w
            k += 2 + size
        if k + 1 < len(data) and data[k : k + 2] == b"\xff\xda":  # to the end of the last scan
            while (end := data.find(b"\xff", k + 2)) >= 0 and end + 1 < len(data) and data[end + 1] != 0xD9:
                k = end
            if area:
                out.append((area, at, len(data) if end < 0 else end + 2))
        at = max(at + 2, end if end > 0 else at + 2)
    return sorted(out, key=lambda p: (-p[0], p[1]))


def decode_preview(data: bytes) -> np.ndarray:
    """The largest embedded JPEG that decodes."""
    for _, start, end in previews(data):
        try:
            return decode_jpeg(data[start:end])
        except (ValueError, KeyError, IndexError, struct.error):
            continue
    raise ValueError("no preview")
