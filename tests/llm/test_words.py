import random
import re

import numpy as np
import pyarrow as pa

from skyquilt.llm import words

TEXTS = ["a b", None, "", " é\tè\nx ", "aa", "\x0b\x0c\r", "b a", "x" * 50, "a b c d e f g", "\x1c\x85 \xa0z", "日本 語"]


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_words_of_any_slice():
    rng = random.Random(1)
    for _ in range(40):
        some = [rng.choice(TEXTS) for _ in range(rng.randint(0, 12))]
        whole = pa.array(["skip me", *some, "tail"], pa.string()).slice(1, len(some))
        w = words.Words(whole)
        got = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
        assert got == [x for t in some for x in split(t)] and list(w.counts) == [len(split(t)) for t in some]
        low = words.Words(whole, lower=True)
        assert [bytes(low.data[a:b]) for a, b in zip(low.start, low.end)] == [x.lower() for x in got]


def test_hashes_agree_between_slices(monkeypatch):
    text = " ".join(str(k % 700) + "w" * (k % 5) for k in range(30000))
    plain = words.Words(pa.array([text])).hashes()
    monkeypatch.setattr(words, "SLICE_BYTES", 1000)
    again = words.Words(pa.array(["x", text])).hashes()
    assert np.array_equal(plain, again[1:])
    table = dict(zip(split(text), plain))
    assert len(set(table.values())) == len(table)
    assert all(table[x] == h for x, h in zip(split(text), plain))


def test_windows():
    rng = np.random.default_rng(2)
    h = words.mix(rng.integers(0, 4, 400).astype(np.uint64))
    for n in (1, 2, 3, 5, 7, 8, 13, 26):
        got = words.windows(h, n)
        seen = {}
        for k in range(len(h) - n + 1):
            assert seen.setdefault(tuple(h[k : k + n]), got[k]) == got[k]
        assert len(set(seen.values())) == len(seen)
    assert len(words.windows(h[:3], 5)) == 0
    first = np.array([0, 3, 3, 10, 12])
    assert list(words.whole(first, 3)) == [0, 3, 4, 5, 6, 7]
    assert list(np.flatnonzero(words.covered(np.array([1, 5]), 2, 8))) == [1, 2, 5, 6]


def test_slices(monkeypatch):
    batch = pa.record_batch({"text": pa.array(["aaaa", None, "b" * 50, "c", "dd"])})
    parts = list(words.slices(batch, "text", 6))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(words.slices(batch.slice(0, 0))) == []
