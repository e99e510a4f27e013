"""What the review of round 4 found: disk of near texts, ties of means."""

import os
import random

import numpy as np
import pyarrow as pa

from vocalith.operators import dedup as D
from vocalith.plans import scratch


def texts(n, draw):
    """Rows of near copies, of other texts with the same letters, and of texts shorter and longer than a piece."""
    out = []
    for k in range(n):
        t = "".join(draw.choices("abcdefgh     ", k=draw.choice((4, 30, 90, 600)))).strip() or "a"
        at = draw.randrange(len(t))
        out += [t, t[:at] + draw.choice(("x", "yé", "日本")) + t[at + 1 :], "".join(draw.sample(t, len(t)))]
    return [(k, draw.choice("st"), t, float(len(t))) for k, t in enumerate(out)]


def bytes_below(*folders):
    return sum(os.path.getsize(os.path.join(d, x)) for f in folders for d, _, names in os.walk(f) for x in names)


def test_near_texts_leave_no_bands_on_disk(spark, monkeypatch):
    rows = spark.createDataFrame(texts(1_000, random.Random(1)), "id long, sp string, key string, dur double").repartition(4)
    folders = spark.sparkContext.getConf().get("spark.local.dir"), scratch.shared_dir(spark).removeprefix("file://")
    before = bytes_below(*folders)
    whole = {tuple(r) for r in D.near_texts(rows, "id", "sp", "key", "dur").collect()}
    assert bytes_below(*folders) - before < 500_000  # the bands of these rows, as they were written and shuffled, take 5 MB
    monkeypatch.setattr(D, "FEW_BANDS", 1)
    assert {tuple(r) for r in D.near_texts(rows, "id", "sp", "key", "dur").collect()} == whole and len(whole) > 100


def test_close_rows_of_batches_are_those_of_all_pairs():
    draw = random.Random(2)
    rows = sorted((draw.randrange(4), draw.choice((-1.0, 0.0, 1.0, 1.05, 1.2, 9.0, 9.9, 10.0, 11.0)), draw.randrange(20, 24), draw.getrandbits(2) + (draw.getrandbits(2) << 48)) for _ in range(120))
    key, dur, size, l0 = zip(*rows)
    t = pa.table({"key": pa.array(key), "dur": pa.array(dur), "size": pa.array(size, pa.int32()), "l0": pa.array(l0), "l1": pa.array([0] * len(rows)), "id": pa.array(range(len(rows)))})
    letters = lambda x: [x >> 8 * k & 255 for k in range(7)]
    like = lambda i, j: size[i] - sum(max(x - y, 0) for x, y in zip(letters(l0[i]), letters(l0[j]), strict=True))
    near = lambda i, j: key[i] == key[j] and abs(dur[i] - dur[j]) <= 0.1 * max(dur[i], dur[j])
    want = {(i, j) for j in range(len(rows)) for i in range(j) if near(i, j) and 2 * min(like(i, j), size[j]) >= 0.92 * (size[i] + size[j])}
    for step in (1, 7, 120):
        got = set()
        for w, new in D._windows(t.to_batches(max_chunksize=step), 0.1):
            ids = w["id"].to_pylist()
            got |= {(ids[a], ids[b]) for i, j in D._close(w, new, 0.92, 0.1) for a, b in zip(i, j, strict=True)}
        assert got == want and len(want) > 50


def test_hashes_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(11)
    mult, add = (rng.integers(1, 1 << 63, 15, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    some = [t for _, _, t, _ in texts(60, random.Random(3))] + ["", "\U0010ffff" * 3]
    grams, at = D._grams(np.array([ord(c) for t in some for c in f"  {t} "], np.uint32), np.array([len(t) + 3 for t in some]))
    low = D._lowest(grams[:, None] * mult + add, at, np.array([len(t) + 1 for t in some]))
    for row, t in zip(low, some, strict=True):
        c = np.array([ord(x) for x in f"  {t} "], np.uint64)
        one = c[:-2] * np.uint64(1 << 42) + c[1:-1] * np.uint64(1 << 21) + c[2:]
        assert (row == (one[:, None] * mult + add).min(axis=0)).all()
