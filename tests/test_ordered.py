"""Operators with the semantics of a loop, against the loop."""

import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.operators import corpus, dedup, evaluation, frames, gates, graph, service, splits
from vocalith.streaming import jobs


def test_components_of_chains_cycles_and_twins(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_keep_first_is_the_greedy_loop(spark):
    random.seed(2)
    pairs = {tuple(sorted(random.sample(range(30), 2))) for _ in range(50)}
    gone = set()
    for a, b in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(b)
    got = {r.id for r in dedup.keep_first(spark.createDataFrame(sorted(pairs), "a long, b long")).collect() if not r.kept}
    assert got == gone


def test_leak_groups_follow_both_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None), (5, "c", None), (6, "d", None)], "id long, key string, sha string")
    assert {r.id: r.grp for r in splits.leak_groups(rows, "key", "sha").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


@pytest.mark.parametrize("seed", range(3))
def test_rate_limit_replay(spark, seed):
    random.seed(seed)
    hits = sorted((random.choice("ab"), round(random.uniform(0, 300), 1)) for _ in range(80))
    rows = [(k, t, i) for i, (k, t) in enumerate(hits)]
    want, last = {}, {"a": [], "b": []}
    for k, t, i in rows:
        last[k] = [x for x in last[k] if t - x <= 60]
        want[i] = len(last[k]) < 3
        if want[i]:
            last[k].append(t)
    got = service.rate_limit(spark.createDataFrame(rows, "k string, t double, id long"), "k", "t", "id", 3, 60.0)
    assert {r.id: r.allowed for r in got.collect()} == want


def test_admission_replay(spark):
    random.seed(4)
    rows = [(1, i, a := round(random.uniform(0, 200), 2), a + round(random.uniform(1, 40), 2)) for i in range(60)]
    run, want = [], {}
    for _, i, a, b in sorted(rows, key=lambda r: (r[2], r[1])):
        run = [e for e in run if e > a]
        want[i] = len(run) < 4
        if want[i]:
            run.append(b)
    for step in (100_000, 7):  # a period in one step, and in many
        got = service.admission(spark.createDataFrame(rows, "g long, id long, a double, b double"), "g", "a", "b", "id", 4, step)
        assert {r.id: r.admitted for r in got.collect()} == want


def test_playback_clock(spark):
    random.seed(5)
    rows, t = [], 0.0
    for i in range(50):
        t += random.uniform(0, 2)
        rows.append((1, i, t, random.uniform(0.1, 2)))
    end, want = None, []
    for _, i, ready, dur in rows:
        silence = 0.0 if end is None or ready <= end else ready - end
        end = (ready if end is None or ready > end else end) + dur
        want.append((i, round(end, 6), round(silence, 6)))
    got = service.playback(spark.createDataFrame(rows, "s long, i long, ready double, dur double"), "s", "ready", "dur", ["i"])
    assert sorted((r.i, round(r.end, 6), round(r.silence, 6)) for r in got.collect()) == want


def test_speech_segments_merge_from_the_left(spark):
    flags = [int(c) for c in "1100111000000011110011000000000111111111111100001"]
    rows = spark.createDataFrame([(1, k, bool(f)) for k, f in enumerate(flags)], "clip long, frame long, speech boolean")
    runs, k = [], 0
    while k < len(flags):
        if flags[k]:
            j = k
            while j < len(flags) and flags[j]:
                j += 1
            runs.append((k, j))
            k = j
        k += 1
    pieces = []
    for a, b in runs:
        if pieces and b - pieces[-1][0] <= 10:
            pieces[-1][1] = b
        else:
            pieces.append([a, b])
    want = [(max(0, a - 1), b + 1) for a, b in pieces if b - a >= 2]
    assert sorted((r.start, r.end) for r in frames.segments(rows, 10, 2, 1).collect()) == want


def test_chunks_are_short_and_lose_nothing(spark):
    texts = ["One two. Three, four; five! " * 9, "x" * 95 + " y", "", "a, " * 60, "no end mark here but very many words in a row " * 4]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.chunks(F.col("t"), 40).alias("c")).collect()
    for r in rows:
        assert all(0 < len(c) <= 40 for c in r.c)
        assert "".join("".join(r.c).split()) == "".join(r.t.split())


def test_token_distance(spark):
    random.seed(6)
    rows = [([random.choice("abcd") for _ in range(random.randrange(8))], [random.choice("abcd") for _ in range(random.randrange(8))]) for _ in range(40)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", evaluation.token_distance(F.col("a"), F.col("b")).alias("n"), evaluation._long_distance(F.col("a"), F.col("b")).alias("m")).collect()

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    assert all(r.n == r.m == lev(r.a, r.b) for r in got)


def test_near_vectors_find_every_pair(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([base, base + rng.normal(scale=0.05, size=base.shape), rng.normal(size=(20, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x - x.mean(axis=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= 0.97}
    assert {(r.a, r.b) for r in dedup.near_vectors(rows, "id", "v").collect()} == want and len(want) >= 10


@pytest.mark.parametrize("size", [7, 1000])
def test_overlaps_by_ranges(spark, size):
    random.seed(size)
    rows = [(random.choice("aaab"), random.randrange(200), random.randrange(1, 60)) for _ in range(300)]
    got = service.active(spark.createDataFrame([(k, float(a), float(a + n)) for k, a, n in rows], "k string, a double, b double").repartition(3), "k", "a", "b", size)
    for r in got.collect():
        n = {t: sum(a <= t < a + m for k, a, m in rows if k == r.k) for t in range(260)}
        assert r.peak == max(n.values()) and r.first_at == min(t for t in n if n[t] == r.peak)
    empty = spark.createDataFrame([], "k string, a double, b double")
    assert service.active(empty, "k", "a", "b").count() == 0 and service.admission(empty.withColumn("id", F.lit(1)), "k", "a", "b", "id", 2).count() == 0


def test_near_texts_are_those_of_all_pairs(spark):
    import zlib
    from collections import Counter
    from difflib import SequenceMatcher

    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh    ", k=rng.randint(40, 150))).strip() for _ in range(60)]
    texts = base + [t[:k] + rng.choice(["x", "yy", ""]) + t[k + 1 :] for t in base for k in [rng.randrange(len(t))]] + [t + " end" for t in base[:20]]
    rows = [(i, "s" if i % 3 else "t", t, float(len(t))) for i, t in enumerate(texts)]
    gram = lambda t: Counter(zlib.crc32(f"  {t} "[k : k + 3].encode()) % 1024 for k in range(len(t) + 1))
    size = lambda u: sum(x * x for x in u.values()) ** 0.5
    want = set()
    for a, sa, ta, da in rows:
        for b, sb, tb, db in rows[a + 1 :]:
            if sa == sb and ta != tb and abs(da - db) <= 0.1 * max(da, db):
                u, v = gram(ta), gram(tb)
                if sum(u[k] * v[k] for k in u) >= 0.8 * size(u) * size(v) and SequenceMatcher(None, ta, tb).ratio() >= 0.92:
                    want.add((a, b))
    got = dedup.near_texts(spark.createDataFrame(rows, "id long, sp string, key string, dur double"), "id", "sp", "key", "dur").collect()
    assert {(r.a, r.b) for r in got} == want and len(want) > 20


def test_near_vectors_have_time_and_reason(spark):
    rows = [(1, [1.0, 0.0, 0.1], 10.0, "x"), (2, [1.0, 0.01, 0.1], 10.5, "x"), (3, [1.0, 0.0, 0.11], 10.2, "y"), (4, [1.0, 0.0, 0.1], 20.0, "x"), (5, [-1.0, 0.0, 0.5], 10.0, "x"), (6, None, 1.0, "x"), (7, [-1.0, 0.0, 0.5], None, "x")]
    d = spark.createDataFrame(rows, "id long, v array<double>, s double, who string")
    got = dedup.near_vectors(d, "id", "v", 0.97, "s", 0.1, "who").collect()
    assert {(r.a, r.b, r.reason) for r in got} == {(1, 2, "near_duplicate_audio"), (1, 3, "speaker_leak_audio"), (2, 3, "speaker_leak_audio")}
    assert dedup.near_vectors(d.where("false"), "id", "v", speaker="who").count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_overlap_by_hashes_or_by_shuffle(spark, limit):
    evals = spark.createDataFrame([(1, "a b c d e f".split()), (2, "q r s".split()), (3, "x y z w v u".split()), (4, [])], "id long, words array<string>")
    train = spark.createDataFrame([(10, "0 b c d e f 0".split()), (11, "b c d e f".split()), (12, "q r s".split()), (13, []), (14, "x y z w".split())], "line long, words array<string>")
    got = {tuple(r) for r in dedup.overlap(evals, train, 5, limit).select("id", "line", "kind").collect()}
    assert got == {(1, 10, "ngram"), (2, 12, "exact"), (4, 13, "exact")}


def test_near_texts_need_time_and_ratio(spark):
    long = "the quick brown fox jumps over the lazy dog again and again until night"
    rows = [(1, "s", long, 10.0), (2, "s", long.replace("night", "nights"), 10.5), (3, "s", long.replace("lazy", "lazi"), 30.0), (4, "t", long + "!", 10.0), (5, "s", "something else entirely was said here", 10.0)]
    got = dedup.near_texts(spark.createDataFrame(rows, "id long, sp string, key string, dur double"), "id", "sp", "key", "dur").collect()
    assert {(r.a, r.b) for r in got} == {(1, 2)}


def first_end(rest, said):
    """Characters of the first piece of a buffer, 0 if it waits; by character, independent of the streamed job."""
    for k, c in enumerate(rest):
        follows = rest[k + 1 : k + 2]
        spaced = follows.isspace()
        if c in "।?!" and (spaced or not follows) or c == "." and spaced:
            word = rest[: k + 1].strip()
            bare = c == "." and (word[:-1].isdigit() or (2 <= len(word) <= 4 and not any(x.isspace() for x in word)))
            if not bare and (said or k + 1 >= 12):
                return k + 1
        elif c == "," and spaced and k + 1 >= (40 if said else 12):
            return k + 1
    return rest.index(" ", 119) + 1 if " " in rest[119:] else 0


def bare(piece):
    lines = re.sub(r"^\s*(?:[-•]|[0-9]+[.)])\s+", "", piece, flags=re.MULTILINE)
    clean = " ".join("".join(c for c in lines if c not in "*#`" and not 0x1F000 <= ord(c) <= 0x1FAFF).split())
    return clean if any(c.isalnum() or c == "_" for c in clean) else ""


def pieces(*parts):
    """The pieces of a reply that comes in parts."""
    out, rest = [], ""
    for n, part in enumerate(parts, 1):
        rest += part
        while end := first_end(rest, bool(out)) or (len(rest) if n == len(parts) else 0):
            piece, rest = bare(rest[:end]), rest[end:]
            out += [piece] * bool(piece)
    return out


def test_streamed_segments(spark):
    rows = jobs.run(jobs.segmenter(jobs.deltas(spark, SMALL)), "append").orderBy("no").collect()
    got = {}
    for r in rows:
        got.setdefault((r.conv_id, r.turn), []).append(r.segment)
    text = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    want = {k: pieces(*(t[len(t) * j // 3 : len(t) * (j + 1) // 3] for j in range(3))) for k, t in text.items()}
    assert got == {k: v for k, v in want.items() if v} and any(len(v) > 1 for v in want.values())


def test_pieces_of_replies():
    fixed = ["this is a clause; and more", "**bold** point here. And so on, then", "This is the last reply", "1. one item\n2. another item of the list. Done! 😀", "Dr. Rao said, in a long and winding sentence, that 3.5 is not 1,000. Yes?", "word " * 60, "", "***", "नमस्ते दुनिया, यह एक वाक्य है। और दूसरा।", "wait... what?! yes", "-\nnext - x", "Dr . no"]
    rng = random.Random(9)
    made = ["".join(rng.choices(["a", "bc ", "def", ". ", ".", ", ", "? ", "!", " ", "12", "\n- ", "\n3) ", "* ", "।", "😀", "word " * 9], k=rng.randint(1, 40))) for _ in range(800)]
    for t in fixed + made:
        cuts = sorted(rng.randint(0, len(t)) for _ in range(2))
        for parts in ([t], [t[: cuts[0]], t[cuts[0] : cuts[1]], t[cuts[1] :]]):
            reply = jobs.Reply()
            got = [p for n, part in enumerate(parts, 1) for p in reply.take(part, n == len(parts))]
            assert got == pieces(*parts), parts
    assert jobs.Reply().take("**bold** point here. x", True) == ["bold point here.", "x"]
    assert jobs.Reply().take("this is a clause; and more", True) == ["this is a clause; and more"]


def test_composed_and_decomposed_texts_are_equal(spark):
    import unicodedata

    texts = ["\u0915\u093c\u0932", "\u0958\u0932", "caf\u00e9", "cafe\u0301", "\u0929", "\u0928\u093c", "\u0939\u0901\u0938", "\u0939\u0902\u0938", "\u1112\u1161\u11ab", "\ud55c", "\u00c5", "\u212b", "a\u0323\u0307", "a\u0307\u0323", "plain, text!", "", "\u091c\u094d\u093c", None]

    def clean(t, marks):
        t = unicodedata.normalize("NFC", t.lower()).replace("\u093c", "").replace("\u0901", "\u0902")
        return "".join(c for c in t if unicodedata.category(c)[0] in ("LMN" if marks else "LN"))

    def canon(t):
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).replace("\u093c", "")).replace("\u0901", "\u0902").lower()
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PSZC" else c for c in t).split())

    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", T.cer_clean(F.col("t")).alias("a"), T.cer_clean_legacy(F.col("t")).alias("b"), T.canon(F.col("t")).alias("c")).collect():
        assert (r.a, r.b, r.c) == ((None,) * 3 if r.t is None else (clean(r.t, True), clean(r.t, False), canon(r.t))), r.t


def test_streamed_rate_limit_equals_the_replay(spark):
    stream = jobs.run(jobs.rate_limit(jobs.events(spark, SMALL), "user_id", 3, 86_400.0), "append")
    rows = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    batch = service.rate_limit(rows, "user_id", "t", "event_id", 3, 86_400.0)
    assert {r.event_id: r.allowed for r in stream.collect()} == {r.event_id: r.allowed for r in batch.collect()}


def test_late_rows_are_kept_and_counted_over_a_restart(spark):
    from vocalith.plans.scratch import new_path

    rng = random.Random(12)
    batches = [[(k * 100 + i, rng.randrange(0, 40) + k * 5) for i in range(20)] for k in range(5)]
    source, state, out = (new_path(spark, x) for x in ("source", "state", "late"))
    schema = "id long, ts timestamp"
    ledger = jobs.LateLedger(spark, out, "15 minutes")
    assert ledger.counts().count() == 0
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, m int").selectExpr("id", "timestamp_seconds(m * 60) as ts").coalesce(1).write.mode("append").parquet(source)
        if k in (1, 4):
            jobs.run_late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), jobs.LateLedger(spark, out, "15 minutes"), state)
    until, want = None, {}
    for rows in batches:
        want |= {i: until is not None and m < until - 15 for i, m in rows}
        until = max([m for _, m in rows] + ([until] if until is not None else []))
    got = {r.id: r.late for r in ledger.rows(f"{schema}, late boolean, batch long").collect()}
    assert got == want and 0 < sum(want.values()) == sum(r.n_late for r in ledger.counts().collect())
    ledger(spark.read.schema(schema).parquet(source).where("id >= 400"), 4)  # a batch that is run again
    assert ledger.rows(f"{schema}, late boolean, batch long").count() == 100 and ledger.counts().count() == 5


def test_pair_cosines_by_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i, f"v{i % 3}", i % 4, rng.normal(size=5).tolist()) for i in range(30)] + [(90, "v0", 1, [0.0] * 5), (91, "v0", 1, None)]
    d = spark.createDataFrame(rows, "id long, v string, s int, e array<double>")
    u = [(v, s, np.array(e) / np.linalg.norm(e)) for _, v, s, e in rows[:30]]
    pairs = [(a, b) for k, a in enumerate(u) for b in u[:k]]
    for block in (4, 1024):
        got = {(r.kind, r.pair): r for r in evaluation.pair_cosines(d, "id", "v", "s", "e", block).collect()}
        for kind, ok in (("same", lambda a, b: a[0] == b[0] and a[1] != b[1]), ("different", lambda a, b: a[0] != b[0] and a[1] == b[1])):
            c = [float(a[2] @ b[2]) for a, b in pairs if ok(a, b)]
            r = got[kind, "all"]
            assert r.n == len(c) and abs(r.mean - sum(c) / len(c)) < 1e-9 and abs(r.lo - min(c)) < 1e-9 and abs(r.hi - max(c)) < 1e-9
        c = [float(a[2] @ b[2]) for a, b in pairs if {a[0], b[0]} == {"v0", "v2"} and a[1] == b[1]]
        assert got["pair", "v0|v2"].n == len(c) and abs(got["pair", "v0|v2"].mean - sum(c) / len(c)) < 1e-9 and len(got) == 5


def test_a_changed_corpus_is_refused(spark):
    from vocalith.sources import manifests

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    found = manifests.fingerprint(rows).first()
    assert manifests.pinned(rows, ["k", "t"], found.n, int(found.checksum)).count() == 2
    for other, columns in ((rows.where("k = 1"), ["k", "t"]), (rows.withColumn("t", F.upper("t")), ["k", "t"]), (rows.union(rows), ["k", "t"]), (rows, ["k"])):
        with pytest.raises(ValueError):
            manifests.pinned(other, columns, found.n, int(found.checksum))


def test_script_gate_and_text_keys(spark):
    row = spark.createDataFrame([("नमस्ते दुनिया ok",), ("abc",), (" ",), ("नमस्ते 5",)], "t string")
    got = row.select(gates.script_reasons(F.col("t"), r"\x{900}-\x{97F}", "A-Za-z", r"\x{900}-\x{97F}A-Za-z ", ("no_devanagari", "low_hindi_share")).alias("r")).collect()
    assert [r.r for r in got] == [[], ["no_devanagari"], ["empty_transcript"], ["bad_normalization"]]
    assert row.select(T.cer_clean(F.lit("क़ँ")).alias("x")).first().x == "कं"


def test_refuses_heldout(spark):
    from vocalith.sources.manifests import refuse_heldout

    with pytest.raises(ValueError):
        refuse_heldout(spark.createDataFrame([(1, "test")], "id long, split string"))


def test_reviews(spark):
    lines = ['{"id": "a", "quality": "approved", "noise": 3}', '{"id": "a", "quality": "approved"}', '{"id": 7, "quality": "approved"}', '{"id": "b", "quality": "fine"}', '{"id": "c", "quality": "review", "noise": 9}', '{"id": "d", "quality": "review", "x": 1}', '{"id": "e", "quality": "rejected"}']
    got = {(r.id, r.problems) for r in gates.review_problems(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("a", "duplicate id"), (None, "no id"), ("b", "bad quality"), ("c", "noise is no 1-5"), ("d", "unknown field")}
