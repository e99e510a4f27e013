"""Near-duplicate lines against all pairs."""

import collections
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vocalith.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def edits(a, b, most):
    """Edit distance, or most + 1 if it is larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def brute_classes(lines, threshold=2):
    """The least line of each line's class, by all pairs; pairs whose counts of characters are too far apart are skipped."""
    lines = sorted(set(lines))
    root = {x: x for x in lines}
    counts = {x: collections.Counter(x) for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = collections.defaultdict(list)
    for x in lines:
        by_size[len(x)].append(x)
    for a in lines:
        for gap in range(threshold + 1):
            most = min(threshold, len(a) // 8)
            for b in by_size[len(a) + gap] if gap <= most else ():
                if (gap or a < b) and (counts[a] - counts[b]).total() <= most and (counts[b] - counts[a]).total() <= most and edits(a, b, most) <= most:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {x: find(x) for x in lines}


def own_classes(spark, lines, threshold=2):
    keys = spark.createDataFrame([(x,) for x in sorted(set(lines))], "line string").withColumn("key", F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")))
    found = line_dedup.classes(line_dedup.links(spark.createDataFrame([(x,) for x in lines], "line string"), threshold))
    members = collections.defaultdict(set)
    for r in keys.join(found, "key").collect():
        members[r.root].add(r.line)
    return {frozenset(m) for m in members.values()}


def several(root):
    out = collections.defaultdict(set)
    for x, r in root.items():
        out[r].add(x)
    return {frozenset(m) for m in out.values() if len(m) > 1}


def variants(letters, sizes, families, most, edits_each=4):
    lines = []
    for _ in range(families):
        base = "".join(random.choice(letters) for _ in range(random.randrange(*sizes))).strip()
        for _ in range(random.randrange(1, most)):
            t = list(base)
            for _ in range(random.randrange(edits_each)):
                k = random.randrange(len(t))
                t[k : k + random.randrange(2)] = random.choice(["", "x", "é"])
            lines.append("".join(t).strip())
    return lines


@pytest.mark.parametrize(("dense", "files", "threshold"), [(32, 10**6, 2), (2, 0, 2), (3, 10**6, 4), (2, 10**6, 1)])
def test_classes_are_those_of_all_links(spark, monkeypatch, dense, files, threshold):
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    monkeypatch.setattr(line_dedup, "BROADCAST_FILES", files)
    random.seed(8 + threshold)
    lines = variants("abcdefgh é", (1, 70), 60, 7) + variants("ab", (6, 40), 40, 12) + variants("abcdefghij ", (120, 260), 12, 9, 7)
    lines += [f"Dear {name}, your order has been sent out today" for name in ("Ann", "Anna", "Hannah", "Bob", "Rob", "Robert", "Christopher", "Kit", "Zoë", "Jo")]
    want = several(brute_classes(lines, threshold))
    assert own_classes(spark, lines, threshold) == want and len(want) > 20


def test_a_family_without_links_stays_apart_and_its_links_are_found(spark):
    random.seed(21)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(5, 9)))
    base = [word() for _ in range(25)]
    lines = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in [random.randrange(25) for _ in range(150)]]
    lines += [x.replace("a", "é", 1) for x in lines[:20]]
    assert own_classes(spark, lines) == several(brute_classes(lines))


def test_decisions_on_the_whole_table_equal_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    changed = table.where("doc_id % 3 = 0").select(F.col("doc_id") + 10_000, F.regexp_replace("text", "(?m)th(?=.*$)", "t"))
    table = table.union(changed)
    docs = {r.doc_id: r.text for r in table.collect()}
    lines = [(i, k, x.strip(BLANKS)) for i in sorted(docs) for k, x in enumerate((docs[i] or "").split("\n")) if x.strip(BLANKS)]
    root = brute_classes([x for _, _, x in lines])
    assert several(root)
    size, first = collections.Counter(root[x] for _, _, x in lines), {}
    for i, k, x in lines:
        first.setdefault(root[x], (i, k, x))
    want = {i: [0, 0, 0, 0, []] for i in docs}
    for i, k, x in lines:
        head, w = first[root[x]], want[i]
        w[0] += 1
        w[1] += size[root[x]] > 1
        if head[:2] != (i, k):
            w[2] += 1
            w[3] += head[2] != x
            w[4].append(k)
    got = {r.doc_id: [r.n_lines, r.n_linked, r.n_removed, r.n_near, r.removed] for r in line_dedup.decide(table).collect()}
    assert got == want


def sessions(n, seed=5):
    rng = random.Random(seed)
    return [f"2024-05-01 INFO gateway: session {rng.getrandbits(64):016x} was opened by the scheduler" for _ in range(n)]


@pytest.mark.parametrize("n", [1_000, 2_000])
def test_lines_of_one_template_meet_rarely(spark, n):
    """Alike but for a random number, so not linked: of all pairs next to none share a key."""
    lines = spark.createDataFrame([(1, x, 64, False) for x in sessions(n)], "file long, line string, least int, done boolean").withColumn("key", F.xxhash64("line"))
    keys = line_dedup._parted(lines, 2).dropDuplicates(["line", "part"]).groupBy("part").count()
    assert keys.select(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] < n / 10


def test_links_within_one_template_are_found(spark):
    """Two edits anywhere, in the template or in the number, and lines of few different grams."""
    random.seed(13)
    lines = sessions(120)
    for x in lines[:60]:
        t = list(x)
        for _ in range(2):
            k = random.randrange(len(t))
            t[k : k + random.randrange(2)] = random.choice(["", "q", "ü"])
        lines.append("".join(t))
    lines += ["ab" * 10 + "".join(random.choice("abc") for _ in range(6)) for _ in range(90)]
    want = several(brute_classes(lines))
    assert own_classes(spark, lines) == want and len(want) > 40


def reworded(families, n, seed=9):
    """Lines of templates, each with four of fifty words replaced by other words of one language."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "st", "he", "in", "ed", "wh", "ti", "en"]) for _ in range(rng.randrange(1, 5)))
    out = []
    for f in range(families):
        base = [word() for _ in range(50)]
        for _ in range(n):
            line = list(base)
            for k in rng.sample(range(50), 4):
                line[k] = word()
            out.append((f, " ".join(line)))
    return out


def test_lines_of_templates_in_one_language_meet_rarely(spark):
    """Words of the language that are rare in a template are common in others: rarity is told by file, repeats by number."""
    lines = sorted(set(reworded(8, 100)))
    table = spark.createDataFrame([(f, x, 256, False) for f, x in lines], "file long, line string, least int, done boolean").withColumn("key", F.xxhash64("line"))
    keys = line_dedup._parted(table, 2).dropDuplicates(["file", "line", "part"]).groupBy("file", "part").count()
    met, pairs = keys.select(F.sum(F.expr("count * (count - 1) div 2"))).first()[0], 8 * 100 * 99 // 2
    assert met < pairs / 5
    assert own_classes(spark, [x for _, x in lines]) == several(brute_classes([x for _, x in lines]))


@pytest.mark.parametrize("line", ["the cat sat on the mat by the door, the cat", "aaaaaaaaaaaaaaaa", "abcdefgh", "été, été, été, été!"])
def test_repeated_grams_are_numbered(spark, line):
    got = spark.createDataFrame([(line,)], "line string").select(line_dedup._grams(F.col("line")).alias("g")).first().g
    ends = len(line) - line_dedup.GRAM + 1
    assert len(set(got)) == len(got) and ends <= len(got) <= ends + 1
