"""FITS files with a new solution in their header: stale keywords go, new cards come before END."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Keywords that a new solution replaces.
STALE = re.compile(r"(CTYPE|CRPIX|CRVAL|CDELT|CROTA|CUNIT)[12]$|CD[12]_[12]$|PC[12]_[12]$|(A|B|AP|BP)_(ORDER|DMAX|\d+_\d+)$|(LONPOLE|LATPOLE|EQUINOX|RADESYS|PLTSOLVD)$")


def updated(data: bytes, cards: list[str]) -> bytes:
    """The file with ``cards`` (80 characters each) in its first header, padded to blocks of 2,880 bytes."""
    kept, at = [], 0
    while True:
        card = data[at : at + 80]
        at += 80
        if len(card) < 80:
            raise ValueError("no END of the header")
        if card[:8].rstrip() == b"END":
            break
        if not STALE.match(card[:8].decode("latin-1").rstrip()):
            kept.append(card)
    while kept and not kept[-1].strip():
        kept.pop()
    head = b"".join(kept) + b"".join(c.ljust(80)[:80].encode("ascii") for c in cards) + b"END".ljust(80)
    return head.ljust(-(-len(head) // 2880) * 2880) + data[-(-at // 2880) * 2880 :]


def with_solutions(files: DataFrame, solutions: DataFrame) -> DataFrame:
    """``path, content`` of files (binary source) with the ``cards`` of their solution (``path, cards``)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [updated(bytes(d), list(c)) for d, c in zip(b["content"], b["cards"])]})

    return files.select("path", "content").join(solutions.select("path", "cards"), "path").mapInPandas(write, "path string, content binary")
