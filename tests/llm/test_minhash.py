"""MinHash near-duplicates against all pairs, in small and in crowded buckets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import minhash as M

SCHEMA = "doc_id long, text string"


def sets_of(text, words=4):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def plain(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 200))] for _ in range(25)]
    rows = [edited(rng, b, k) for b in base for k in (0, 0, 1, 2, 4, 8)]
    family = [f"f{k}" for k in range(120)]
    rows += [edited(rng, family, rng.randint(1, 3)) for _ in range(120)]  # linked, more than a bucket meets pair by pair
    rows += ["t " * 30 + " ".join(f"s{k}" for k in range(40)) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(9)) for _ in range(60)]  # one template, none similar
    rows += [None, "", " \n\t", "two words", "TWO words", "two  words", "y " * 5000, "y " * 5001]
    return rows


@pytest.mark.parametrize(("dense", "seed"), [(16, 1), (4, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, dense, seed):
    monkeypatch.setattr(M, "DENSE", dense)
    rows = list(enumerate(corpus(random.Random(seed))))
    rows += [(None, rows[0][1]), (None, "alone in its words"), (3, rows[3][1]), (500, None), (500, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("fp", "id", "tie", "size", "key", "root", "n")}))
    rows_got = sorted((tuple(r) for r in got.collect()), key=str)
    assert [(a, b, c, None if a is None else d) for a, b, c, d in rows_got] == [(a, b, c, None if a is None else d) for a, b, c, d in plain(rows)] or rows_got == _with_nulls(rows)


def _with_nulls(rows):
    """Texts without words are alone, also where an id repeats; a null id that nothing names is kept."""
    out = []
    for i, n, c, k in plain(rows):
        c = i if n == 0 else c
        out.append((i, n, c, i == c))
    return sorted(out, key=str)


def test_unlinked_templates_stay_linear(spark):
    """Pairs that reach the whole sets, for a template whose texts are not similar: none, however many."""
    made = []
    real = M._verified

    def counted(pairs, *more):
        made.append(pairs.distinct().count())
        return real(pairs, *more)

    M._verified = counted
    try:
        for n in (100, 200):
            rng = random.Random(n)
            rows = [(k, " ".join([*(f"s{j}" for j in range(60)), *(f"u{rng.randrange(10**9)}" for _ in range(14))])) for k in range(n)]
            made.clear()
            got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA))
            assert got.where("not kept").count() == 0
            assert made[-1] == 0 and sum(made) <= (M.FIRST + M.DRAWN * M.BANDS) * n
    finally:
        M._verified = real


def test_minima_share_a_band_at_the_threshold():
    rng = np.random.default_rng(5)
    shared = missed = 0
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))  # similarity 0.8
        x, y = (M.minima(np.unique(np.concatenate([both, z]))).reshape(M.BANDS, M.ROWS) for z in (a, b))
        shared += int((x == y).mean() * 240)
        missed += not (x == y).all(axis=1).any()
    assert missed == 0 and 0.77 < shared / 200 / 240 < 0.83


def test_keep_first(spark):
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (5, "other words are here"), (5, "other words are here")]
    documents = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"{c}!") for c in ("_tie", "_rank", "root", "fp")})
    got = M.keep_first(documents)
    assert got.columns == documents.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
    assert all(r._tie == "_tie!" and r.root == "root!" for r in got.collect())
    assert M.keep_first(documents.where("false")).count() == 0 and M.near_duplicates(documents.where("false")).count() == 0
