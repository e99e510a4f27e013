"""Ranked search against scores of every document, over segments and blocks so small that lists are pruned."""

import math
import random
import re

import numpy as np
import pytest

from vocalith.llm import lexical_search as S

SCHEMA = "doc_id long, text string"


def plain(documents, items, k):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, found(t)) for i, t in documents]
    n, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in items:
        scored = []
        asked = set(found(text))
        df = {t: sum(t in set(w) for _, w in docs) for t in asked}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked}
        for i, w in docs:
            m = 100 - 50 + (50 * len(w) * n) // max(total, 1)
            score = sum(weight[t] * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in asked if t in w)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize(("segment", "block", "k"), [(40, 4, 3), (7, 2, 5), (4096, 128, 50)])
def test_ranks_equal_plain_scores(spark, segment, block, k):
    rng = random.Random(segment)
    words = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(4000)] + ["Ärger", "STRASSE", "x-y", "Two_Words"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)]
    documents = list(enumerate(texts)) + [(900, None), (901, ""), (902, "-- !"), (None, texts[3]), (7, texts[3]), (7, texts[3]), (903, "w1 " * 20_000)]
    items = [(j, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for j in range(20)] + [(30, None), (31, "nowhere"), (32, "w1 W1 w1"), (32, "w1 W1 w1")]
    postings = S.index(spark.createDataFrame(documents, SCHEMA).repartition(3), segment_docs=segment, block=block)
    got = S.search(postings, spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(documents, items[:-1], k), key=str)


def test_pruning_opens_fewer_blocks():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 60, 2000)
    code = np.concatenate([np.zeros(1990), np.ones(12)]).astype(np.int64)
    doc = np.concatenate([np.sort(rng.choice(2000, 1990, False)), np.sort(rng.choice(2000, 12, False))])
    rows = S.posting_rows(1, list(range(2000)), lengths, [b"often", b"rare"], code, doc, np.ones(2002, np.int64), 16).to_pylist()
    segment = S.Segment(lengths, np.arange(2000), 2000, int(lengths.sum()))
    for t, (weight, r) in enumerate(zip((3, 4000), rows[1:], strict=True)):
        segment.add(t, weight, r["lasts"], r["ends"], r["fronts"], r["impacts"], r["data"])
    best, score = segment.best([0, 1], 100_000_000)
    assert len(best) and {t for t, _ in segment.opened} == {0, 1} and len([1 for t, _ in segment.opened if t == 0]) <= 12
    full, every = S.Segment.best(segment, [0, 1], 0)
    keep = every >= 100_000_000
    assert full[keep].tolist() == best.tolist() and every[keep].tolist() == score.tolist()


def test_packed_integers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31 - 1])
    data, ends = S.packed(values)
    assert S.unpacked(data).tolist() == values.tolist() and ends[-1] == len(data)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b")], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(S.index(none), items).count() == 0
    assert S.search(S.index(some), items.where("false")).count() == 0


def test_terms_in_blocks_and_clashing_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    clash = {c: F.lit(1) for c in ("segment", "term", "n", "t", "q", "score", "rank", "item", "terms", "h")}
    documents = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c") for i in range(50)], SCHEMA).withColumns(clash)
    items = spark.createDataFrame([(j, f"a{j} b{j % 3}") for j in range(7)], "item_id long, text string").withColumns(clash)
    postings = S.index(documents)
    want = sorted(map(tuple, S.search(postings, items, 4).collect()))
    monkeypatch.setattr(S, "QUERY_TERMS", 3)
    assert sorted(map(tuple, S.search(postings, items, 4).collect())) == want and len(want) == 28
