"""What the review of round 3 found on corpus-scale texts: passes over whole texts, rows for every word."""

import random

from test_findings_r03 import final_plan  # noqa: F401
from pyspark.sql import functions as F

from vocalith.operators import corpus as C, normalize as N

BITS = "the and of January Jan. May $ € km lakh cr % ( ) - -- ()- + h http https :// : a:b A B I Dr. Rs Rs. Wi-Fi डॉ. रु x.com y.in z.info. com कि.मी. _km (km) Mrs. no. No. AB aBC OTP 24/7 é 日本 \x01".split(" ")
DIGITS = "5 12 2020 1,000 3.5 5km 5GB 12:30 1/2 1/2/2020 2020-01-02 +91 98765 4321 10% 3rd 7th v1.2.3 A1 1B AB12 a@b.co https://x.y/z?q=1 100-200 $5 ₹7 012345".split()


def texts(n, seed=4, digits=0.25):
    draw = random.Random(seed)
    word = lambda: draw.choice(DIGITS) if draw.random() < digits else draw.choice(BITS)
    space = lambda: draw.choice(["", " ", " ", " ", " ", " ", "  ", "\n", "\t", " \n"])
    return ["".join(word() + space() for _ in range(draw.randrange(60))) for _ in range(n)] + ["", " ", "\n\n", "a b c d ", "a b c d"]


def test_regions_are_those_of_the_whole_pattern(spark):
    rows = spark.createDataFrame([(t.replace("\x01", ""),) for d in (0.02, 0.25) for t in texts(1_500, digits=d)], "t string")
    whole = F.regexp_replace("t", N.REGION, f"{N.CUT}$0{N.CUT}")
    got = rows.select("t", N.regions(F.col("t")).alias("x"), whole.alias("y")).collect()
    assert all(r.x == r.y for r in got) and sum(N.CUT in r.x for r in got) > 1_000 and sum(N.CUT not in r.x for r in got) > 20


def test_classes_are_counted_alike_without_prose(spark):
    rows = spark.createDataFrame([(t,) for d in (0.02, 0.1, 0.4) for t in texts(1_500, digits=d)], "t string")
    got = rows.select("t", C.nsw_counts(F.col("t")).alias("x"), C.nsw_counts(C.without_prose(F.col("t"))).alias("y")).collect()
    assert all(r.x == r.y for r in got) and all(sum(r.x[k] for r in got) for k in range(len(C.NSW)))


def test_prose_does_not_pass_through_the_classes(spark):
    prose = "And the 5 km " + "one by one they came home. " * 9_000 + "in January 5."
    short = spark.createDataFrame([(prose,)], "t string").select(C.without_prose(F.col("t"))).first()[0]
    assert short == "And the 5 km January 5."


def test_trigrams_are_counted_without_a_row_for_each(spark):
    import zlib

    from vocalith.operators import dedup as D

    rows = [(k, t.replace("\x01", "")) for k, t in enumerate(texts(400))] + [(1_001, None), (1_002, "é😀日" * 700), (1_003, "x"), (1_004, "a" * 3_000)]
    found = D.trigram_counts(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    want = {}
    for k, t in rows:
        counts = {}
        for g in D._trigrams(t) if t is not None else ():
            at = zlib.crc32(g.encode()) % 1024
            counts[at] = counts.get(at, 0) + 1
        want[k] = None if t is None else counts
    assert {r.id: r.vector for r in found.collect()} == want
    plan = final_plan(found)
    assert "Exchange" not in plan and "Generate" not in plan


def test_words_are_respelled_without_a_row_for_each(spark):
    words = sorted({w.lower() for w in BITS if w.isalpha()})
    lexicon = spark.createDataFrame([(w, w[::-1]) for w in words if len(w) % 2] + [("σας", "s"), ("mute", None)], "word string, say string")
    rows = spark.createDataFrame([*enumerate(texts(600)), (7_001, None), (7_002, ""), (7_003, "ΣΑΣ Mute THE")], "id int, t string")
    found = C.respell(rows, "t", lexicon, "id")
    far = C.respell(rows, "t", lexicon, "id", limit=2)
    assert sorted(found.collect()) == sorted(far.collect()) and found.where("hits > 0").count() > 100
    plan = final_plan(found)
    assert "Exchange" not in plan and "Generate" not in plan


def test_texts_are_looked_up_in_one_scan(spark):
    from vocalith.functions import text as T
    from vocalith.operators import dedup as D

    train = spark.createDataFrame([*enumerate(texts(300)), (7_001, None), (7_002, " \n,"), (7_003, "a b c d e f"), (7_004, "क़, x")], "line int, t string")
    words = train.select("line", "t", T.words(F.col("t")).alias("words"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.replace("t", F.lit("़"), F.lit("")), r"[\p{P}\p{S}]", " "), r"\s+", " "))
    plain = F.when(F.length(bare) > 0, F.split(bare, " ")).otherwise(F.expr("cast(array() as array<string>)"))
    assert words.where(~F.col("words").eqNullSafe(plain)).count() == 0
    evals = words.where("line % 7 = 0 or line > 7000").select(F.col("line").alias("id"), F.when(F.col("line") % 2 == 0, F.slice("words", 2, 9)).otherwise(F.col("words")).alias("words"))
    near, far = (D.overlap(evals, words.select("line", "words"), 5, limit) for limit in (10**6, 1))
    assert sorted(near.collect()) == sorted(far.collect()) and near.count() > 30
    assert "Scan ExistingRDD" in final_plan(near) and final_plan(near).count("regexp_replace") < final_plan(far).count("regexp_replace")


def test_medians_are_exact_without_a_task_that_holds_a_group(spark, monkeypatch):
    from vocalith.operators import dedup as D

    monkeypatch.setattr(D, "COUNTS_A_RANGE", 40)
    draw = random.Random(9)
    rows = [(k, draw.choice("abc") if k % 50 else None, None if k % 31 == 0 else round(draw.gauss(0, 9), draw.choice((0, 2))) * (40 if k % 97 == 0 else 1), float(k % 7)) for k in range(3_000)] + [(9_000 + k, "few", float(k), 1.0) for k in range(19)] + [(9_100 + k, "even", float(k // 10 * 900), 0.0) for k in range(20)]
    frame = spark.createDataFrame(rows, "id int, g string, x double, y double")
    found = D.condition_outliers(frame, ["g"], {"x": 1.0, "y": 0.001}, 2.0)
    long = frame.unpivot(["id", "g"], ["x", "y"], "feature", "value").where("value is not null")
    plain = long.join(long.groupBy("g", "feature").agg(F.median("value").alias("med"), F.count("*").alias("n")).where("n >= 20"), ["g", "feature"])
    mads = plain.groupBy("g", "feature").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    want = plain.join(mads, ["g", "feature"]).where("abs((value - med) / greatest(1.4826d * mad, if(feature = 'x', 1d, 0.001d))) > 2").select("id", F.concat(F.lit("condition_outlier_"), "feature"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 30
    assert "percentile" not in final_plan(found) and "median(" not in final_plan(found)
