"""Near-duplicate lines by a segment-partition edit join, in SQL functions only.

Two lines link if they are within ``allowed`` edits (insert, delete or replace a code point): an eighth of the shorter one's
length, at most ``threshold``. Lines of 16 code points or more take two edits, those of 8 to 15 one, and shorter ones link
only when equal, as one edit in seven makes another word.

Cut a line into one segment more than the edits allowed, and at least one is untouched; by the selection of Li et al.
(Pass-Join, 2011) some untouched one has also moved little: number k of p by at most min(k - 1, p - k) places. The index is
aware of length by classes: lines of a class, an eighth to a quarter wide, are cut alike, those near its upper end are filed
in the next one too, so that each line is filed under 5 keys (class, segment number, text) or little more for two edits, and
linked lines meet in a file. Files with a single distinct line go first, by a sum over hashes; texts are read for the rest.

Lines of a file compare counts of letters, then their texts, inside the join: what they have in common at both ends is cut off by
bisection, and the middles go through Hyyro's banded bit-parallel edit distance, one word of bits a column. Only links
leave the join. A file with more than ``DENSE`` lines (a family of near copies) does not meet pair by pair: each line is
held against two members that are drawn by hash. Lines that are then in one class with most of the file are done. The others
meet every line of other classes of that file that has two grams (``GRAM`` code points in a row) in common with it among the
rarest of both. Repeats of a gram are numbered, and an edit changes ``GRAM`` of these at most, so for e edits two of the rarest
``GRAM`` * e + 2 of each line are among those of the other, in any order of rarity that a file's lines share. What most of
``DRAWN`` lines of the file say comes last in that order, as a template's words can be rare elsewhere; the rest is ordered by a table
of hashed counts over the lines that are not done. So lines meet by what they don't have from their template: no link between classes
is lost, a linked family of n gives about n rows, and n lines alike but for sixteen random hexadecimal digits meet in some 4 of
100,000 pairs. Lines with fewer grams (eight code points) meet by two parts of their letters, of two more than the edits can change
(two each). Lines meet without their texts, which are joined to each pair once, however many keys it shares.

Lines are compared without the white space around them; blank lines are left alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.llm.native import BLANKS, let
from vocalith.operators.graph import connected_components
from vocalith.operators.skew import lookup
from vocalith.plans.scratch import materialize

THRESHOLD = 2
#: Code points of a line for each edit that is allowed.
EACH = 8
#: Lines of a file that meet pair by pair.
DENSE = 32
#: Files that are found by a broadcast (8 bytes each); more take a shuffle, with the same result.
BROADCAST_FILES = 2_000_000
#: Letters that are counted, modulo 256, to compare lines before their texts are.
LETTERS = "etnoairs"
#: Code points of a gram, and hashed counts of grams (a power of two): their table has this many bytes whatever the input.
GRAM, SLOTS = 4, 1 << 16
#: Lines of a file that show its template, and words (a power of two) of 64 hashed grams in a file's row; more grams only order worse.
DRAWN, WORDS = 16, 64


def _letters(line: Column) -> Column:
    size, out = F.octet_length(line), F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        count = size - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(255)).cast("long"), 8 * k))
    return out


def _alike(a: Column, b: Column, most: Column) -> Column:
    """Whether two lines' counts of letters differ by what ``most`` edits can do: two each."""
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        gap = F.abs(F.shiftrightunsigned(a, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(F.lit(255)))
        total = total + F.least(gap, 256 - gap)
    return total <= 2 * most


def allowed(size: Column, threshold: int = THRESHOLD) -> Column:
    """Edits that link a line of ``size`` code points to one that is not shorter."""
    return F.least(F.lit(threshold), (size / EACH).cast("int"))


def _class(size: Column) -> Column:
    """Least length of the class: the three highest bits of the length stay."""
    low = F.greatest(F.length(F.bin(size.cast("long"))) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def _filed(least: Column, size: Column, threshold: int) -> Column:
    """Files of a line in the class of lines of ``least`` code points or more, by the edits that this class allows."""
    out = F.expr("cast(array() as array<bigint>)")
    for edits in range(1, threshold + 1):
        parts = edits + 1
        width, files = (least / parts).cast("int"), []
        for k in range(1, parts + 1):
            before, after = k - 1, parts - k
            start = width * before + 1 if before <= after else size - width * (after + 1) + 1
            files += [F.xxhash64(least, F.lit(k), F.substr(F.col("line"), start + move, width)) for move in range(-min(before, after), min(before, after) + 1)]
        here = allowed(least, threshold)
        out = F.when(here >= edits if edits == threshold else here == edits, F.array(*files)).otherwise(out)
    return out


def _files(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines`` (line, size and more) by ``file``: those of their class, and of that of the shortest line they can link to."""
    own, lower = _class(F.col("size")), _class(F.col("size") - allowed(F.col("size"), threshold))
    by_class = lines.select("*", F.explode(F.when(own == lower, F.array(own)).otherwise(F.array(own, lower))).alias("least"))
    return by_class.select(*lines.columns, "least", F.explode(_filed(F.col("least"), F.col("size"), threshold)).alias("file"))


def _common(a: Column, b: Column, most: Column, take) -> Column:
    """Length of the longest common start (or end) of at most ``most`` code points, by bisection."""
    powers = F.expr("transform(sequence(20, 0, -1), x -> shiftleft(1, x))")

    def step(n: Column, p: Column) -> Column:
        longer = n + p
        return F.when((longer <= most) & (take(a, F.least(longer, most)) == take(b, F.least(longer, most))), longer).otherwise(n)

    return F.aggregate(powers, F.lit(0), step)


def _banded(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of arrays of characters, ``size(a) >= size(b) >= size(a) - threshold``, if it is at most ``threshold``;
    otherwise some larger number. Bit ``width - 1`` of a word is the row ``threshold`` below the diagonal."""
    width = 2 * threshold + 3
    ones, top = (1 << width) - 1, 1 << (width - 1)
    m, n = F.size(a), F.size(b)
    mask = lambda x: x.bitwiseAND(F.lit(ones))
    no = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(ones))

    def column(state: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        rows = [(k, j + threshold - (width - 1 - k)) for k in range(width)]
        match = F.lit(0)
        for k, row in rows:
            match = match + F.when((row >= 1) & (F.get(a, F.greatest(row, F.lit(1)) - 1) == c), F.lit(1 << k)).otherwise(0)

        def bits(eq: Column) -> Column:
            vp, vn = state["vp"], state["vn"]

            def rest(d0: Column) -> Column:
                hp, hn = vn.bitwiseOR(no(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                on_diagonal = j <= m - threshold
                flat = F.call_function("shiftright", F.lit(top), F.greatest(F.lit(0), j - (m - threshold)))  # row m
                step = F.when(on_diagonal, F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(
                    F.when(hp.bitwiseAND(flat) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(flat) != 0, 1).otherwise(0)
                )
                return F.struct(hn.bitwiseOR(no(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["far"] + step).alias("far"))

            d0 = mask((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn))
            return let(d0, rest)

        return F.when(state["far"] > 2 * threshold, state).otherwise(let(match, bits))

    start = F.struct(F.lit(ones & ~((1 << (width - 1 - threshold)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("far"))
    fold = F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["far"])
    return F.when(n == 0, m).otherwise(fold)


def edit_distance(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Edit distance of two strings in code points if it is at most ``threshold``, otherwise a larger number. Null for null."""

    def middles(s: Column) -> Column:
        x, y = s["x"], s["y"]

        def cut(head: Column) -> Column:
            tail_most = F.length(y) - head
            right = lambda t, k: F.when(k > 0, F.right(t, k)).otherwise("")

            def inner(tail: Column) -> Column:
                mid = lambda t: F.substr(t, head + 1, F.length(t) - head - tail)
                chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
                return let(F.struct(chars(mid(x)).alias("a"), chars(mid(y)).alias("b")), lambda z: _wide(z["a"], z["b"], threshold))

            return let(_common(x, y, tail_most, right), inner)

        return let(_common(x, y, F.length(y), F.left), cut)

    far = F.abs(F.length(a) - F.length(b)) > threshold
    longer = F.length(a) >= F.length(b)
    ordered = F.struct(F.when(longer, a).otherwise(b).alias("x"), F.when(longer, b).otherwise(a).alias("y"))
    return F.when(F.isnull(a) | F.isnull(b), F.lit(None).cast("int")).when(far, threshold + 1).otherwise(let(ordered, middles))


def _wide(a: Column, b: Column, threshold: int) -> Column:
    """The band needs a longer side of more than ``threshold`` rows; shorter ones are padded by what can't match."""
    pad = F.array_repeat(F.lit(" no letter "), threshold)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.greatest(F.size(a), F.size(b))).otherwise(
        let(F.struct(F.concat(pad, a).alias("a"), F.concat(pad, b).alias("b")), lambda z: _banded(z["a"], z["b"], threshold))
    )


def _near(a: str, b: str, threshold: int) -> Column:
    """Whether lengths and letters of two sides let them link."""
    c = lambda x, name: F.col(f"{x}.{name}")
    most = allowed(F.least(c(a, "size"), c(b, "size")), threshold)
    return (F.abs(c(a, "size") - c(b, "size")) <= most) & _alike(c(a, "letters"), c(b, "letters"), most)


def _linked(a: str, b: str, threshold: int) -> Column:
    """Whether lines of two sides link: the cheap conditions first."""
    most = allowed(F.least(F.col(f"{a}.size"), F.col(f"{b}.size")), threshold)
    return _near(a, b, threshold) & (edit_distance(F.col(f"{a}.line"), F.col(f"{b}.line"), threshold) <= most)


def _edges(met: DataFrame) -> DataFrame:
    return met.select(*[F.col(f"{x}.key.{y}").alias(f"{x}{y}") for x in "ab" for y in "hg"])


def _parts(line: Column, threshold: int) -> Column:
    """Keys that linked lines of a file share one of: each pair of parts of its letters."""
    chars, n = F.split(line, ""), 2 * threshold + 2
    part = lambda r: F.xxhash64(F.array_sort(F.filter(chars, lambda c: F.ascii(c) % n == r)))
    sums = F.array(*[part(r) for r in range(n)])
    return let(sums, lambda s: F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.get(s, F.lit(i)), F.get(s, F.lit(j))) for i, j in combinations(range(n), 2)]))


def _grams(line: Column) -> Column:
    """Hashes of the grams of a line; the repeats of one are numbered."""
    places = lambda c: F.sequence(F.lit(1), F.size(c) - GRAM + 1)
    powers = F.expr("transform(sequence(20, 0, -1), x -> shiftleft(1, x))")

    def numbered(s: Column) -> Column:
        before = lambda g, k: F.aggregate(powers, F.lit(0), lambda n, p: F.when(F.get(s, k - n - p) == g, n + p).otherwise(n))
        return F.transform(s, lambda g, k: F.when(F.get(s, k - 1) == g, F.xxhash64(g, before(g, k))).otherwise(g))

    return let(F.split(line, ""), lambda c: let(F.sort_array(F.transform(places(c), lambda k: F.xxhash64(F.slice(c, k, GRAM)))), numbered))


def _slot(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _bit(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(64 * WORDS - 1)).cast("int")


def _rare_pairs(line: Column, grams: Column, counts: Column, common: Column, edits: Column, threshold: int) -> Column:
    """Keys that linked lines of a file share one of: each pair of the rarest grams, and ``_parts`` where grams are too few."""
    enough = edits * GRAM + 2
    usual = lambda h: F.getbit(F.get(common, F.shiftright(_bit(h), 6)), h.bitwiseAND(F.lit(63)).cast("int")).cast("long")
    rank = lambda h: F.coalesce(128 * usual(h), F.lit(0).cast("long")) + F.get(counts, _slot(h))
    ranked = F.sort_array(F.transform(grams, lambda h: F.shiftleft(rank(h), 55).bitwiseOR(F.shiftrightunsigned(h, 9))))
    rarest = F.slice(ranked, F.lit(1), enough)
    after = lambda r, x, k: F.transform(F.slice(r, k + 2, F.size(r)), lambda y: F.xxhash64(x, y))
    pairs = lambda r: F.flatten(F.transform(r, lambda x, k: after(r, x, k)))
    return let(rarest, lambda r: F.when(F.size(r) < enough, F.concat(pairs(r), _parts(line, threshold))).otherwise(pairs(r)))


def _templates(named: DataFrame, grams: DataFrame) -> DataFrame:
    """``common`` by ``file``: bits of the hashed grams that half of ``DRAWN`` lines have."""
    drawn = named.select("file", "key", F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64("key"))).alias("no")).where(F.col("no") <= DRAWN)
    bits = drawn.join(grams, "key").repartition("file", "key").select("file", F.explode_outer(F.array_distinct(F.transform("grams", _bit))).alias("bit"))
    usual = bits.groupBy("file", "bit").count().where(2 * F.col("count") >= DRAWN)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))
    words = usual.groupBy("file", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("set"))
    table = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("sets"))
    return table.select("file", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.element_at("sets", k), F.lit(0).cast("long"))).alias("common"))


def _parted(named: DataFrame, threshold: int) -> DataFrame:
    """``named`` by ``part``: lines of a file that link, one of them not ``done``, have one in common.

    No array that is exploded is empty; without ``_outer``, Spark would compute each once more to filter by its size.
    """
    once = named.groupBy("key").agg(F.first("line").alias("line"), F.bool_and("done").alias("closed"))
    once = materialize(once.select("key", "closed", _grams(F.col("line")).alias("grams")), "grams")
    open_ = once.where("not closed").select(F.explode_outer("grams").alias("gram")).select(_slot(F.col("gram")).alias("slot"), F.lit(1).alias("one"))
    all_slots = named.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("one"))
    counts = open_.union(all_slots).groupBy("slot").agg(F.least(F.lit(127), 3 * F.log2(F.sum("one") + 1)).cast("byte").alias("n"))
    table = counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "n"))), lambda x: x["n"]).alias("counts"))
    grams = once.select("key", "grams")
    known = named.join(grams, "key").join(_templates(named, grams), "file", "left").repartition("file", "key")  # a file's lines in many tasks
    known = known.crossJoin(F.broadcast(table))  # a table of one row
    keys = _rare_pairs(F.col("line"), F.col("grams"), F.col("counts"), F.col("common"), allowed(F.col("least"), threshold), threshold)
    return known.select(*named.columns, F.explode_outer(keys).alias("part"))


def classes(edges: DataFrame) -> DataFrame:
    """``key`` (h, g) of every line of ``edges`` (ah, ag, bh, bg) and ``root``, a number of its class."""
    end = lambda x: F.struct(F.col(f"{x}h").alias("h"), F.col(f"{x}g").alias("g"))
    keys = edges.select(end("a").alias("key")).union(edges.select(end("b"))).distinct()
    numbers = materialize(keys.withColumn("no", F.monotonically_increasing_id()), "numbers")
    side = lambda x: numbers.select(F.col("key").alias(f"k{x}"), F.col("no").alias(x))
    both = edges.select(end("a").alias("ka"), end("b").alias("kb")).join(side("a"), "ka").join(side("b"), "kb")
    return materialize(numbers.join(connected_components(both, "a", "b").withColumnRenamed("node", "no"), "no").select("key", "root"), "roots")


def links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links among the column ``line`` as hashes of both lines: ah, ag, bh, bg. Not every link is named, but their classes are
    those of all links.

    Repeated lines count once; nulls, empty and very short lines have no link; of very long ones the whole text is compared.
    """
    if not 1 <= threshold <= EACH:
        raise ValueError(f"classes of length are laid out for 1 to {EACH} edits")
    key = F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")).alias("key")
    known = lines.select("line", F.length("line").alias("size")).where(F.col("size") >= EACH).select(key, "line", "size")
    filed = _files(known, threshold)
    shared = filed.groupBy("file").agg(F.min("key.h").alias("lo"), F.max("key.h").alias("hi")).where("lo <> hi").select("file")
    shared = materialize(shared, "files")
    if shared.count() <= BROADCAST_FILES:
        some = filed.join(F.broadcast(shared), "file")
    else:
        keys = filed.select("file", "key").join(shared, "file", "left_semi").select("key").distinct()
        some = _files(known.join(keys, "key"), threshold).join(shared, "file")
    some = materialize(some.select("file", "least", "key", "line", "size").distinct().withColumn("letters", _letters(F.col("line"))), "met")
    crowd = some.groupBy("file").agg(F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64(F.lit(k), "key").alias("at"), "key", "line", "size", "letters")).alias(f"p{k}") for k in (0, 1)])
    crowd = materialize(crowd.where("n > 1"), "crowd")
    few = some.join(crowd.where(F.col("n") <= DENSE).select("file"), "file")
    near = few.alias("a").join(few.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.key") < F.col("b.key")) & _linked("a", "b", threshold))
    dense = crowd.where(F.col("n") > DENSE)
    many = materialize(some.join(dense.select("file"), "file"), "many")
    heads = dense.select("file", F.explode(F.array("p0", "p1")).alias("p")).select("file", "p.*")
    star = many.alias("a").join(heads.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.key") != F.col("b.key")) & _linked("a", "b", threshold))
    first = materialize(_edges(near).union(_edges(star)), "links")
    if not many.limit(1).count():
        return first
    named = many.join(classes(first), "key", "left")
    main = named.where("root is not null").groupBy("file", "root").count().groupBy("file").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    named = named.join(main, "file", "left").withColumn("done", F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    open_ = named.where("not done").select("file").distinct()
    named = materialize(named.join(open_, "file"), "open")
    parted = materialize(_parted(named, threshold).select("file", "part", "key", "size", "letters", "root", "done"), "parts")
    a, b = parted.where("not done").alias("a"), parted.alias("b")
    other = (F.col("a.root").isNull() | F.col("b.root").isNull() | (F.col("a.root") != F.col("b.root"))) & (F.col("b.done") | (F.col("a.key") < F.col("b.key")))
    met = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.part") == F.col("b.part")) & other & _near("a", "b", threshold))
    pairs = met.select(F.col("a.key").alias("ka"), F.col("b.key").alias("kb")).distinct()  # texts are compared once a pair
    texts = materialize(named.groupBy("key").agg(F.first("line").alias("line"), F.first("size").alias("size"), F.first("letters").alias("letters")), "texts", named)
    rest = pairs.join(texts.alias("a"), F.col("ka") == F.col("a.key")).join(texts.alias("b"), (F.col("kb") == F.col("b.key")) & _linked("a", "b", threshold))
    return materialize(first.union(_edges(rest)), "links", first)


def decide(documents: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: id, ``tie`` (a hash of the text), ``n_lines`` that are not blank, ``n_linked`` of them that
    have an equal or linked line elsewhere, ``n_removed``, ``n_near`` (removed for a different text), and ``removed``, their numbers.

    Lines of a class (linked by equality or by edits, over any number of steps) are removed but for the first by id (null
    last), text hash and line number; numbers count all lines from 0. Null and empty texts have no lines. Rows that agree in
    id and text count as one document and get equal results. Very long texts and lines are taken whole. Other columns are not
    read, whatever their names; an empty table gives an empty one.
    """
    own = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = own.select("id", "tie", F.posexplode(F.split("text", "\n")).alias("no", "raw")).select("id", "tie", "no", F.trim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")
    where = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "no").alias("at")
    key = F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")).alias("key")
    seen = materialize(cut.select(key, where), "lines")
    named = classes(links(cut.select("line"), threshold))
    distinct = seen.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    several = distinct.join(named, "key", "left").where("n > 1 or root is not null")  # others are alone in their class
    own_class = F.struct(F.col("key.h").alias("h"), F.col("key.g").alias("g"))
    in_class = F.struct(F.col("root").alias("h"), F.lit(None).cast("long").alias("g"))
    classed = materialize(several.select("key", "first", "n", F.when(F.col("root").isNull(), own_class).otherwise(in_class).alias("class")), "classes")
    heads = classed.groupBy("class").agg(F.min("first").alias("head"), F.sum("n").alias("members"), F.min_by("key", "first").alias("head_key")).where("members > 1")
    table = classed.join(heads, "class").select("key", "head", (F.col("head_key") != F.col("key")).alias("near"), "n")
    found = lookup(seen, table, "key", "n")
    gone = F.col("head").isNotNull() & (F.col("head") != F.col("at"))
    by_doc = found.groupBy(F.col("at.id").alias("id"), F.col("at.tie").alias("tie")).agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("head").isNotNull()).alias("n_linked"), F.count_if(gone).alias("n_removed"),
        F.count_if(gone & F.col("near")).alias("n_near"), F.sort_array(F.collect_set(F.when(gone, F.col("at.no")))).alias("removed"),
    )
    rows = own.select("id", "tie")
    on = rows["id"].eqNullSafe(by_doc["id"]) & (rows["tie"] == by_doc["tie"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.join(by_doc, on, "left").select(rows["id"], rows["tie"], *[zero(c) for c in ("n_lines", "n_linked", "n_removed", "n_near")], F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))
    return out.withColumnRenamed("id", id_col)


def clean(documents: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without the lines that ``decided`` removes; other lines, and all other columns, stay as they are."""
    d = decided.where(F.size("removed") > 0).select(F.col(id_col).alias("_id"), F.col("tie").alias("_tie"), "removed").distinct()
    met = documents.alias("d").join(d, F.col(f"d.{id_col}").eqNullSafe(F.col("_id")) & (F.xxhash64(f"d.{text_col}") == F.col("_tie")), "left")
    kept = F.filter(F.transform(F.split(F.col(f"d.{text_col}"), "\n"), lambda x, k: F.when(~F.array_contains("removed", k), x)), lambda x: x.isNotNull())
    text = F.when(F.col("removed").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"d.{text_col}"))
    return met.select(*[text.alias(c) if c == text_col else F.col(f"d.{c}") for c in documents.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Lines of all documents, two edits."""
    found = decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_linked", "n_removed", "n_near", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))
