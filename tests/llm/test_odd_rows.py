"""Nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names, for every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vocalith.llm import decontamination, line_dedup, mixing, pii, quality_knn, quality_rules, sharding, simhash, token_files, toxicity
from vocalith.plans.scratch import new_path

LONG = "very long text of many words, line after line.\n" * 4_000
TEXTS = [(1, "one text of its own"), (1, "one text of its own"), (2, None), (None, "no id at all"), (None, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x" * 50_000), (7, "one text of its own")]
CLASH = {"fp": 1, "id": 2, "tie": 3, "_tie": 4, "_t": 5, "size": 6, "row_number": 7, "shard": 8, "slot": 9, "found": 10, "spans": 11, "score": 12, "toxicity": 13, "removed": 14, "n_words": 15, "root": 16, "bucket": 17, "start": 18, "line": 19}

#: Names that operators have used for columns of their own.
EXTRA = ["_copy", "_found", "_row", "_p", "_h", "_toxicity", "_bucket", "_rank", "_offset", "_digest", "_extra", "_parts", "_size", "_text", "_place", "_n", "_ids", "_spans", "_hit"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, "en", None if i == 5 else "s", 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def side(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def ops(spark):
    b, lab = side(spark, "benchmark"), side(spark, "labels")
    path = public_tokenizers.path("word_bpe_49k.json")
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(side(spark, "documents"), lab)), "toxicity_unlabelled": lambda d: toxicity.score(d, toxicity.fit(d, lab.where("false"))),
        "sharding": lambda d: sharding.shard(d, 3), "quality": lambda d: quality_knn.score(d, quality_knn.fit(side(spark, "documents"), lab)), "quality_unlabelled": lambda d: quality_knn.score(d, quality_knn.fit(d, lab.where("false"))),
        "mixing": lambda d: mixing.taken(mixing.mix(d)), "decontamination": lambda d: decontamination.find(d, b), "decontamination_nothing": lambda d: decontamination.find(d, b.where("false")), "decontamination_join": lambda d: decontamination.find(d, b, limit=1),
        "simhash": lambda d: simhash.near_duplicates(d), "tokens": lambda d: token_files.read(token_files.manifest(token_files.write(d, new_path(spark, "t"), path, 1))),
        "lines": lambda d: line_dedup.decide(d), "pii": lambda d: pii.spans(d), "rules": lambda d: quality_rules.verdicts(quality_rules.ledger(d)),
    }


NAMES = ["toxicity", "toxicity_unlabelled", "sharding", "quality", "quality_unlabelled", "mixing", "decontamination", "decontamination_nothing", "decontamination_join", "simhash", "tokens", "lines", "pii", "rules"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(spark, odd, none, name):
    op = ops(spark)[name]
    assert len(op(odd).collect()) == len(TEXTS)
    assert op(none).count() == 0


def test_results_of_odd_rows(spark, odd):
    parts = {r.doc_id: r for r in simhash.near_duplicates(odd).collect() if r.doc_id is not None}
    assert parts[2].component_id == parts[3].component_id == parts[4].component_id == 2 and parts[7].component_id == 1
    assert [r.n_tokens for r in ops(spark)["tokens"](odd).collect() if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert {r.doc_id: r.failed for r in quality_rules.ledger(odd).collect() if r.doc_id in (2, 3)} == {2: 1, 3: 1}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_none(spark, odd, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = odd.select(columns)
    out = stage(spark, plain, SMALL)
    assert out.columns[:5] == columns and (k == 4 or out.columns == columns)
    n = out.count()
    assert n == {0: 10, 1: 5, 2: 10, 4: 10}.get(k, n) and n > 0
    assert stage(spark, none.select(columns), SMALL).count() == 0
    clash = odd.withColumns({c: F.lit(f"{c}!") for c in EXTRA})
    out = stage(spark, clash, SMALL)
    rows = out.collect()
    assert len(rows) == n and [c for c in out.columns if c in clash.columns or k < 4] == [c for c in clash.columns if k < 4 or c not in ("row_number", "shard", "slot")] + ["row_number", "shard", "slot"] * (k == 4)
    for r in rows:
        assert all(r[c] == f"{c}!" for c in EXTRA) and all(r[c] == v for c, v in CLASH.items() if k < 4 or c not in ("row_number", "shard", "slot"))


@pytest.mark.parametrize("name", ["toxicity", "sharding", "quality", "decontamination", "decontamination_join"])
def test_other_columns_keep_their_values(spark, odd, name):
    clash = odd.withColumns({c: F.lit(f"{c}!") for c in EXTRA}).drop("row_number", "shard", "slot", "score", "toxicity", "found")
    for r in ops(spark)[name](clash).collect():
        assert all(r[c] == (CLASH.get(c) or f"{c}!") for c in clash.columns[5:])


def test_redact_keeps_clashing_columns(spark):
    rows = [(1, "mail a.b@example.org now"), (2, None), (3, ""), (1, "mail a.b@example.org now")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_spans": F.lit("keep"), "spans": F.lit("too")})
    got = pii.redact(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == sorted([(1, "mail <email> now", "keep", "too"), (2, None, "keep", "too"), (3, "", "keep", "too"), (1, "mail <email> now", "keep", "too")])
    assert pii.redact(d.where("false")).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    places = {(r.shard, r.slot) for r in rows}
    assert len(places) == len(rows) > 50 and {r.shard for r in rows} <= set(range(24))
    bad = {r.doc_id for r in side(spark, "labels").where("toxic = 1").collect()}
    assert len([r for r in rows if r.doc_id in bad]) < len(bad)
    left = decontamination.find(out, side(spark, "benchmark")).where("found.n_hit > 0").count()
    assert left == 0
