"""Operators against plain versions on the smallest tables and on planted cases."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from compare import assert_same
from conftest import SMALL
from pyspark.sql import functions as F

from vocalith.llm import decontamination, labels, line_dedup, mixing, native, pii, quality_knn, quality_rules, registry, sharding, simhash, token_files, toxicity
from vocalith.plans.scratch import materialize, new_path


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name], SMALL)


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_by_definition():
    import xxhash

    text = "The the CAT sat on the mat the the cat"
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), seed=42) for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One two") & (2**64 - 1) == xxhash.xxh64_intdigest("one two", seed=42)


@pytest.mark.parametrize("dense", [256, 4])
def test_simhash_links_every_pair_within_two_bits(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    random.seed(7)
    prints = set()
    for _ in range(30):
        x = random.getrandbits(64)
        for _ in range(random.randrange(1, 14)):
            prints.add(x)
            x ^= sum(1 << b for b in random.sample(range(64), random.randrange(1, 4)))
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    want = groups(near, prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = groups([(r.src, r.dst) for r in simhash.links(rows).collect()], [signed(p) for p in prints])
    same = lambda g: {frozenset(k for k in g if g[k] == r) for r in g.values()}
    assert {frozenset(map(signed, s)) for s in same(want)} == same(got)


def test_simhash_query(spark, docs):
    got = {r.doc_id: r for r in simhash.query(spark, SMALL).collect()}
    fp = {k: simhash.fingerprint(t.encode()) & (2**64 - 1) for k, t in docs.items()}
    ids = sorted(fp)
    want = groups([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    assert all(got[k].component_id == want[k] and got[k].fingerprint == f"{fp[k]:016x}" for k in ids)


def test_permutation_walks_back():
    for n in (1, 2, 3, 100, 1000, 4097):
        p = sharding.Permutation(n, 5)
        x = np.arange(n)
        assert sorted(p.forward(x).tolist()) == x.tolist() and (p.back(p.forward(x)) == x).all()
    assert all(sharding.row_at(*sharding.place_of(k, 77, 5), 77, 5) == k for k in range(77))


def test_sharding_query(spark, docs):
    rows = sharding.query(spark, SMALL).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.query(spark, SMALL).collect()), key=str)


def test_numbers_of_a_repeated_key_have_no_gap(spark):
    rows = spark.createDataFrame([(None, "x")] * 300 + [(k, "y") for k in range(40)], "doc_id long, text string").repartition(5)
    out = sharding.shard(rows, 7).collect()
    assert sorted(r.row_number for r in out) == list(range(340)) and len({(r.shard, r.slot) for r in out}) == 340


@pytest.mark.parametrize("other", [None, "k % 5"])
def test_places_do_not_depend_on_how_the_table_lies(spark, other):
    rows = spark.range(2000).selectExpr("7L as doc_id", "'hot' as text", f"{other or 0} as k" if other is None else "id % 5 as k")
    rows = rows.union(spark.range(1000).selectExpr("id as doc_id", "concat('t', id) as text", "0 as k"))
    places = lambda d: collections.Counter((r.doc_id, r.text, r.k, r.shard, r.slot) for r in sharding.shard(d, 7).collect())
    first = places(rows.repartition(3))
    assert first == places(rows.orderBy(F.desc("text")).repartition(11, "k")) and max(first.values()) == 1


def test_a_model_is_fitted_as_scores_are_summed():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(200)]
    number = {w: k for k, w in enumerate(words)}
    counts = [toxicity.counts_of(t, number) for t in texts]
    x = np.array([[np.log1p(c.get(k, 0)) for k in range(40)] for c in counts])
    hidden = x @ rng.standard_normal(40) + rng.logistic(size=200)
    grades = np.digitize(hidden, np.quantile(hidden, [0.5, 0.8]))
    at, cols = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(at, cols, x[at, cols], grades, 40, steps=3000)
    share = np.where(grades > 0, (grades > 0).mean(), (grades == 0).mean())
    each = (0.5 / share) ** toxicity.BALANCE
    each /= each.sum()

    def loss(w, cuts):
        above = np.concatenate([np.ones((200, 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + cuts)), np.zeros((200, 1))], axis=1)
        return -(each * np.log(above[range(200), grades] - above[range(200), grades + 1])).sum() + 1e-4 * (w @ w)

    best = loss(w, cuts)
    for _ in range(300):  # no neighbour is better
        assert loss(w + 0.02 * rng.standard_normal(40), cuts + 0.02 * rng.standard_normal(2)) > best - 1e-6
    model = toxicity.Model(words, w, cuts)
    assert [model.linear(t) for t in texts[:20]] == pytest.approx((x @ w)[:20].tolist())
    s = model.severity(x @ w)
    assert s["expected_severity"].to_numpy() == pytest.approx((1 / (1 + np.exp(-(x @ w)[:, None] + cuts))).sum(axis=1))


def test_a_repeated_id_keeps_samples_within_their_rows(spark):
    d = spark.createDataFrame([(1, "same")] * 300 + [(1, f"t{k}") for k in range(300)] + [(2, "u")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert labels.sample(d, lab, "toxic", 10).count() == 10 and labels.sample(d.where("text = 't5'"), lab, "toxic", 10).count() == 1


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return out


def test_base_spans_by_definition(spark):
    random.seed(9)
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x..@a-b.co.uk.", "+1 (2) 3-4.5678 9", "4111 1111-1111 1111", "4111111111111111", "0" * 17, "001.002.003.255 256.1.1.1", "é+49 30 1234567é", "a" * 5000 + "@x.y", "1" * 5000, "+" * 50 + "1 2345678", "1.2.3.4@5.6"]
    odd += ["".join(random.choice("a1.@+-_ é(9") for _ in range(60)) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = pii.spans(rows).select("doc_id", F.expr("transform(filter(spans, s -> s.kind in ('email', 'ip', 'card', 'phone')), s -> concat_ws(':', s.kind, s.start, s.end))").alias("s")).collect()
    for r in got:
        assert r.s == base_spans(odd[r.doc_id]), odd[r.doc_id]


def test_pii_query_and_redaction(spark, docs):
    for r in pii.query(spark, SMALL).collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",") if r.spans else [])
    text = "iban DE89 3704 0044 0532 0130 00 or GB00WEST12345698765432; mail é@b a@b.de"
    assert pii.redact(spark.createDataFrame([(text,)], "text string")).first().text == "iban <iban> or GB00WEST12345698765432; mail é@b <email>"


def test_sums_before(spark):
    rows = spark.createDataFrame([([3] * n,) for n in (0, 1, 5, 511, 512, 513, 1500)], "a array<int>")
    for r in rows.select("a", native.sums_before(F.col("a")).alias("s")).collect():
        assert r.s == [3 * k for k in range(len(r.a))]


def test_repeated_windows(spark):
    random.seed(3)
    texts = [" ".join(random.choice("ab") for _ in range(n)) for n in (0, 7, 8, 9, 16, 30, 60)] + [" ".join(map(str, range(12))) * 2, "x " * 40]
    got = quality_rules.ledger(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))


def test_ablation(spark):
    found = materialize(quality_rules.ledger(spark.read.parquet(f"{SMALL}/documents.parquet")), "ledger")  # a ledger is stored once
    kept = quality_rules.verdicts(found).where("kept").count()
    for r in quality_rules.ablation(found).collect():
        mask = quality_rules.POLICIES["v1"] & ~quality_rules.BIT[r.rule]
        assert found.where(F.col("failed").bitwiseAND(F.lit(mask)) == 0).count() == kept + r.n_only_this


def test_large_benchmarks_take_the_join_with_equal_results(spark):
    d, b = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    b = b.union(spark.createDataFrame([(900, "the Of"), (901, ""), (902, None)], b.schema))
    rows = lambda df: sorted((r.doc_id, r.found.n_words, r.found.n_hit, tuple(r.found.item_ids), tuple(map(tuple, r.found.spans))) for r in df.select("doc_id", "found").collect())
    broadcast = rows(decontamination.find(d, b))
    assert broadcast == rows(decontamination.find(d, b, limit=1)) and any(r[2] for r in broadcast)


def test_clean_cuts_passages_and_leaves_the_rest(spark):
    passage = " ".join(f"word{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"Début, here it is: {passage}! and after. " + "filler text " * 10), (2, passage), (3, "nothing to see"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.clean(d, items).collect()}
    assert got == {r.doc_id: r.text for r in decontamination.clean(d, items, limit=1).collect()}
    assert got == {1: "Début, here it is: ! and after. " + "filler text " * 10, 3: "nothing to see", 4: None}


def test_edit_distance(spark):
    random.seed(5)
    rows = []
    for _ in range(1500):
        a = [random.choice("abé") for _ in range(random.randrange(13))]
        b = list(a)
        for _ in range(random.randrange(4)):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randrange(2)] = random.choice(["", "a", "b", "é"])
        rows.append(("".join(a), "".join(b)))
    d = spark.createDataFrame(rows, "a string, b string").select(line_dedup.edit_distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y"))
    assert d.where("least(x, 3) <> least(y, 3)").count() == 0


def test_line_decisions_and_cleaning(spark):
    near = "a line that is long enough to be compared by edits"
    d = spark.createDataFrame([(1, f"{near}\n\nshort\nshort"), (2, f" {near.replace('long', 'lomg')} \nown words only here in this line\nshort"), (None, near), (4, ""), (5, None)], "doc_id long, text string")
    decided = line_dedup.decide(d)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_near, r.removed) for r in decided.collect()} == {1: (3, 1, 0, [3]), 2: (3, 2, 1, [0, 2]), None: (1, 1, 0, [0]), 4: (0, 0, 0, []), 5: (0, 0, 0, [])}
    assert {r.doc_id: r.text for r in line_dedup.clean(d, decided).collect()} == {1: f"{near}\n\nshort", 2: "own words only here in this line", None: "", 4: "", 5: None}


def test_targets_fill_by_weight():
    assert mixing.targets([10, 10, 10], [1.0, 1.0, 1.0]) == [10, 10, 10]
    sizes, weights = [100, 1, 1000, 7], [5.0, 2.0, 1.0, 5.0]
    t = [sum(sizes) * w / sum(weights) for w in weights]
    fixed = set()
    while over := [k for k in range(4) if k not in fixed and t[k] > 3 * sizes[k]]:
        fixed |= set(over)
        rest = [k for k in range(4) if k not in fixed]
        left = sum(sizes) - sum(3 * sizes[k] for k in fixed)
        t = [3 * sizes[k] if k in fixed else left * weights[k] / sum(weights[j] for j in rest) for k in range(4)]
    assert mixing.targets(sizes, weights) == pytest.approx(t)
    assert sum(map(sum, mixing.draws([5, 0, 40, 3], 7, 1))) == 48 and [sum(c) for c in zip(*mixing.draws([5, 0, 40, 3], 7, 1), strict=True)] == [5, 0, 40, 3]


def test_mixing_meets_targets(spark, docs):
    found = mixing.query(spark, SMALL).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size = {k: len(re.findall(mixing.WORD, t)) for k, t in docs.items()}
    taken, target = collections.Counter(), {}
    for r in found:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and sum(target.values()) == pytest.approx(sum(size.values()))
    assert {r.doc_id: r.taken for r in found} == {r.doc_id: r.taken for r in mixing.query(spark, SMALL).collect()}


def test_mixed_documents_hold_what_was_taken(spark, docs):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = collections.Counter()
    for r in mixing.mixed_documents(d).collect():
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
        assert r.n_chars == len(r.text) and set(re.findall(mixing.WORD, r.text)) <= set(re.findall(mixing.WORD, docs[r.doc_id]))
    assert words == collections.Counter({r.doc_id: r.taken for r in mixing.query(spark, SMALL).collect() if r.taken})


def test_slots_and_blocks_are_permuted_once_a_pass():
    s = mixing.Stream(1, 1000, 2345.0, 64, 9)
    got = s.at(0, s.slots)
    length = lambda b: min(64, 1000 - 64 * b)
    assert sum(min(length(b), m) for b, m in zip(got["block"], got["most"], strict=True)) == 2345
    assert all(len(set(g)) == len(g) for _, g in got.groupby("turn")["block"])


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, t


def test_words_encode_as_whole_texts(tokenizer):
    path, t = tokenizer
    own = token_files.WordEncoder.of(path)
    random.seed(3)
    letters = "aAbB zZ'sS09 .,!?\t\n\x1c\x1f\xa0é²½Ñßª́​Σσς中　İ😀_LtdStart<|endoftext|>-\x00\x7f"
    for s in ["", " ", "<|endoftext|>", *("".join(random.choice(letters) for _ in range(random.randrange(30))) for _ in range(800))]:
        assert list(np.frombuffer(own.encode(s), "<u4")) == t.encode(s, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, tokenizer):
    import zstandard

    path, t = tokenizer
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in docs.items()}
    at = 0
    got = {r.doc_id: r for r in token_files.query(spark, SMALL).collect()}
    for k in sorted(want):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(want[k]), zlib.crc32(struct.pack(f"<{len(want[k])}I", *want[k])))
        at += len(want[k])
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    listed = token_files.manifest(token_files.write(d, new_path(spark, "t"), path, 1))
    some = token_files.fetch(listed, d.where("doc_id % 9 = 2").union(spark.createDataFrame([(10**9, "", "", "", 0)], d.schema)))
    assert {r.doc_id: r.tokens for r in some.collect()} == {k: v for k, v in want.items() if k % 9 == 2}
    uri = listed.first().uri
    reader = token_files.Reader(uri)
    raw = open(uri.removeprefix("file://"), "rb").read()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as whole:  # any reader skips the table
        assert whole.read() == b"".join(zstandard.ZstdDecompressor().decompress(raw[a : a + n]) for a, n in zip(reader.starts[:-1], reader.sizes[:-1], strict=True))
    broken = uri.removeprefix("file://") + ".bad"
    open(broken, "wb").write(raw[:40] + bytes([raw[40] ^ 255]) + raw[41:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader("file://" + broken).frame(0))


def test_toxicity_holds_out(spark):
    d, folder = "/root/testdata/sf0.01", "/root/testdata/sf0.01"
    found = toxicity.query(spark, folder).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(labels.held_out()).collect()
    clean = [r for r in found if not r.toxic]
    assert sum(r.rejected for r in clean) <= 0.03 * len(clean)
    assert sum(r.rejected for r in found if r.toxic) >= 0.6 * sum(r.toxic for r in found)
    assert all(0 <= r.expected_severity <= 2 and r.rejected == (r.p_toxic >= 0.5) for r in found)


def test_thresholds_stay_in_order_and_learn():
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, 600)
    grades = np.minimum(3, x)
    w, cuts = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x.astype(float), grades, 1)
    assert (np.diff(cuts) > 0).all() and ((x[:, None] * w[0] > cuts).sum(axis=1) == grades).mean() > 0.95


def test_quality_holds_out(spark):
    folder = "/root/testdata/sf0.01"
    found = quality_knn.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.9 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    counts, y = rng.random((60, quality_knn.TERMS + quality_knn.SHAPES), np.float32), rng.integers(0, 2, 60)
    space = quality_knn.Space(counts, y)
    v = space._unit((counts * space.rarity) @ space.project)
    cos = v @ space.vectors.T
    for k, got in enumerate(space.vote(counts)):
        near = np.argsort(-cos[k])[: quality_knn.NEIGHBOURS]
        assert got == pytest.approx((cos[k][near] * y[near]).sum() / cos[k][near].sum(), abs=1e-4)
