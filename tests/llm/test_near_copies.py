"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
import pytest
from conftest import SMALL

from vocalith.llm import minhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_all_pairs(texts):
    sets, root = {k: grams(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in texts if find(k) == k}


@pytest.mark.parametrize("dense", [16, 2])
def test_stage_keeps_one_of_each_component_of_similar_texts(spark, monkeypatch, dense):
    monkeypatch.setattr(minhash, "DENSE", dense)
    random.seed(11)
    word = lambda: f"w{random.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], []
    for family in range(25):
        base = [word() for _ in range(random.randrange(3, 150))] + passage * (family % 3 == 0)
        for _ in range(40 if family < 2 else random.randrange(1, 6)):
            w = list(base)
            for _ in range(random.randrange(6)):
                k = random.randrange(len(w))
                w[k : k + random.randrange(2)] = random.choice([[], [word()], [word().upper()]])
            texts.append(" ".join(w))
    texts = dict(enumerate([*texts, *texts[:9], "", None, " \n"]))
    want = kept_by_all_pairs(texts)
    assert len(want) < len(texts) - 60
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, d, SMALL).collect()) == sorted(want)
