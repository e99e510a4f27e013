"""MinHash near-duplicates: many universal hash minima, bands, verified signatures and sets, and star-contracted components.

A text is its set of distinct four-word shingles, hashed to 64 bits. ``BANDS * ROWS`` universal hashes (odd multipliers and
offsets modulo 2^64, high halves) give as many minima. Sets whose minima agree in a whole band meet; at a similarity of 0.8 two
sets share none of the bands five times in a million, and less often above. Pairs that meet are held against each other's signature first:
``SKETCH`` bits, one a minimum, of which two similar sets differ in a tenth on average and in ``APART`` next to never. What is left is
verified on the whole sets. Sets that are equal meet once.

Only components are needed. A bucket of more than ``DENSE`` sets (a family of near copies) doesn't meet pair by pair at first: each set is held
against ``DRAWN`` members, drawn by hash, of each of its ``FIRST`` largest buckets. What is then in one component with a bucket's largest part
is done there. Sets elsewhere meet sets of other components, of sizes that leave room for the similarity: what a set has of its own (shingles in
no other set of such buckets) it shares with no partner, so texts of one template that are not similar don't meet, however many. A
bound comes before any row: the hash space has ``SEGMENTS`` segments, each of which holds an odd or an even number of the set's shingles; two sets
are at least as many shingles apart as these differ in. No bucket or set is capped or dropped. Links become components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.llm.simhash import LOWER, first_of, majority
from vocalith.operators.graph import connected_components
from vocalith.operators.skew import lookup
from vocalith.plans.scratch import materialize

WORDS, ROWS, BANDS = 4, 6, 40
#: Bits of a sketch, the low bit of each minimum, and of these how many may differ: 24 do on average at a similarity of 0.8,
#: and 50 are more than five deviations beyond.
SKETCH, APART = 256, 50
#: Sets of a bucket that meet pair by pair at once; members of a larger one that its other sets meet first, and in how many buckets.
DENSE, DRAWN, FIRST = 16, 4, 6
#: Segments of the hash space, a multiple of 64.
SEGMENTS = 1024
#: Ratio of neighbouring classes of sizes.
CLASS = 1.05
#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000
#: Shingles whose hashes are computed at once.
CHUNK = 512
_rng = np.random.default_rng(20)
_mult, _add = (_rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(x) for x in (1, 0))
_place = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


class _Words(dict):
    """Hashes of words, kept up to ``CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _Words()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one, a blank or null one has none."""
    w = text.translate(LOWER).split() if text else []
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    size = min(words, len(h))
    if not size:
        return h
    mixed = sum((h[k : len(h) - size + 1 + k] ^ (h[k : len(h) - size + 1 + k] >> np.uint64(29))) * _place[k] for k in range(size))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set that is not empty."""
    low = np.full(len(_mult), 2**64 - 1, np.uint64)
    for at in range(0, len(s), CHUNK):
        low = np.minimum(low, (s[at : at + CHUNK, None] * _mult + _add).min(axis=0))
    return low >> np.uint64(32)


def _whole(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts], dtype=object)

    return of(text.cast("binary"))


def signatures(documents: DataFrame, id_col: str, text_col: str, words: int = WORDS, prints: bool = False) -> DataFrame:
    """Per row: id, tie (a hash of the text), fp (a hash of the set, null for an empty one), size, sketch, a key a band, and print, the
    set's SimHash (null if not asked for by ``prints``)."""

    @F.pandas_udf("fp long, size long, sketch array<long>, bands array<long>, print long")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingles(t, words)
            if len(s):
                low = minima(s)
                bits = np.zeros(SKETCH, np.uint8)
                bits[: len(low)] = low & np.uint64(1)
                keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64)
                out.append((xxhash.xxh64_intdigest(s.tobytes()) - 2**63, len(s), np.packbits(bits).view(np.int64), keys.view(np.int64), majority(s) if prints else None))
            else:
                out.append((None, 0, [], [], None))
        return pd.DataFrame(out, columns=["fp", "size", "sketch", "bands", "print"]).astype({"fp": "Int64", "print": "Int64"})

    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), of(F.col(text_col).cast("binary")).alias("s"))
    return materialize(rows.select("id", "tie", "s.*"), "signatures")


def _alike(a: str, b: str) -> Column:
    """Whether sizes and sketches leave room for a similarity of 0.8."""
    size = lambda x: F.col(f"{x}.size")
    differ = sum(F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(SKETCH // 64))
    return (5 * size(a) >= 4 * size(b)) & (5 * size(b) >= 4 * size(a)) & (differ <= APART)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.fp", "b.fp").alias("src"), F.greatest("a.fp", "b.fp").alias("dst"))


def _sets(fps: DataFrame, rows: DataFrame, documents: DataFrame, text_col: str, words: int) -> DataFrame:
    """The whole sets (fp, s) of some fingerprints, made again from one text of each."""
    one = rows.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("tie").alias("tie"))
    texts = documents.select(F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")).join(one, "tie").dropDuplicates(["fp"])
    return materialize(texts.select("fp", _whole(F.col("text"), words).alias("s")), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, documents: DataFrame, text_col: str, words: int) -> DataFrame:
    """The pairs (src, dst) whose whole sets have a similarity of 0.8 or more."""
    pairs = materialize(pairs.distinct(), "pairs")
    sets = _sets(pairs.select(F.col("src").alias("fp")).union(pairs.select("dst")).distinct(), rows, documents, text_col, words)
    side = lambda fp, s: sets.select(F.col("fp").alias(fp), F.col("s").alias(s))
    both = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return materialize(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("src", "dst"), "links")


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    return materialize(rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def _open(members: DataFrame, rows: DataFrame, documents: DataFrame, text_col: str, words: int) -> DataFrame:
    """Per fingerprint of ``members``, how many of its shingles others of them ``share``, and the parity of each segment; only those that can
    have a partner."""

    @F.pandas_udf("array<long>")
    def parity(of: pd.Series) -> pd.Series:
        odd = (np.bincount(s.astype(np.int64) & (SEGMENTS - 1), minlength=SEGMENTS) & 1 for s in of)
        return pd.Series([np.packbits(o.astype(np.uint8)).view(np.int64) for o in odd], dtype=object)

    sets = _sets(members, rows, documents, text_col, words)
    alone = sets.select("fp", F.explode("s").alias("s")).groupBy("s").agg(F.min("fp").alias("fp"), F.max("fp").alias("hi")).where("fp = hi")
    own = alone.groupBy("fp").agg(F.count("*").alias("own"))
    left = sets.select("fp", F.size("s").alias("n"), parity("s").alias("parity")).join(own, "fp", "left").withColumn("share", F.col("n") - F.coalesce("own", F.lit(0)))
    return materialize(left.where(5 * F.col("share") >= 4 * F.col("n")).select("fp", "share", "parity"), "open")


def _apart(split: DataFrame) -> DataFrame:
    """Pairs (src, dst) of ``split`` (key, fp, size, sketch, root, main, share, parity): sets outside the main part of a bucket and those of other
    components in it, if sizes, shared shingles and sketches leave room. Similar sets have 4 / 9 of their sizes in common, so a partner's
    size is at most 9 / 4 of what is shared less the own size: sets meet by classes of sizes."""
    of = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")
    near = F.sequence(of(0.8 * F.col("size") - 0.001), of(2.25 * F.col("share") - F.col("size") + 0.001))
    a = split.where("root <> main").withColumn("class", F.explode(near)).alias("a")
    b = split.withColumn("class", of(F.col("size"))).alias("b")
    room = 9 * F.least("a.share", "b.share") >= 4 * (F.col("a.size") + F.col("b.size"))
    differ = sum(F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(SEGMENTS // 64))
    room &= 9 * differ <= F.col("a.size") + F.col("b.size")  # similar sets are a ninth of their sizes apart at most
    return _pairs(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.root") != F.col("b.root")) & room & _alike("a", "b")))


def links(rows: DataFrame, documents: DataFrame, text_col: str = "text", words: int = WORDS, also: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) of fingerprints whose components are those of all similar pairs that share a band or are in ``also`` (src, dst);
    ``rows`` comes from ``signatures`` of ``documents``. Every edge is a verified pair."""
    check = lambda pairs: _verified(pairs, rows, documents, text_col, words)
    keyed = rows.where("fp is not null").select("fp", "bands").dropDuplicates(["fp"]).select("fp", F.explode("bands").alias("key"))
    keyed = materialize(keyed, "keys")
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    some = materialize(keyed.join(crowd, "key"), "some")
    about = rows.join(some.select("fp").distinct(), "fp", "left_semi").select("fp", "size", "sketch").dropDuplicates(["fp"])
    met = materialize(some.join(about, "fp"), "met")
    same = (F.col("a.key") == F.col("b.key")) & _alike("a", "b")
    few, many = met.where(F.col("n") <= DENSE), met.where(F.col("n") > DENSE)
    near = _pairs(few.alias("a").join(few.alias("b"), same & (F.col("a.fp") < F.col("b.fp"))))
    place = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("n"), "key"))  # of at most BANDS rows
    member = F.struct("fp", "size", "sketch")
    drawn = many.groupBy("key").agg(F.array(*[F.min_by(member, F.xxhash64(F.lit(k), "key", "fp")) for k in range(DRAWN)]).alias("p"))
    drawn = drawn.select("key", F.explode("p").alias("p")).select("key", "p.*")
    largest = many.withColumn("place", place).where(F.col("place") <= FIRST)
    near = near if also is None else near.union(also)
    found = check(near.union(_pairs(largest.alias("a").join(drawn.alias("b"), same & (F.col("a.fp") != F.col("b.fp"))))))
    if not many.limit(1).count():
        return found
    named = _rooted(many, found)
    split = materialize(named.join(_mains(named), "key"), "split")
    if not split.limit(1).count():
        return found
    split = split.join(_open(split.select("fp").distinct(), rows, documents, text_col, words), "fp")
    return found.union(check(_apart(materialize(split, "split"))))


def _mains(named: DataFrame) -> DataFrame:
    """The largest component (``main``) of each bucket that has more than one."""
    parts = named.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts"))
    return parts.where("parts > 1").select("key", "main")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``documents``: its id, ``n_shingles`` (long), ``component_id``, the smallest id it is linked to (itself
    included), and ``kept``, whether that is its own id.

    Null, empty and blank texts have no shingles and link to nothing; a text of fewer than ``words`` words is one shingle.
    Equal texts link, whatever their ids, and repeated rows stay. Null ids name no component, unless all its ids are
    null (then all are kept). Long texts are taken whole. Other columns are not read, whatever their names. An empty table gives an
    empty one.
    """
    rows = signatures(documents, id_col, text_col, words)
    nodes = materialize(rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    linked = _components(rows, nodes, documents, text_col, words)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    found = lookup(rows.select("id", "fp", "size"), linked.join(least, "root").select("fp", "component_id", "n"), "fp", "n")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _components(rows: DataFrame, nodes: DataFrame, documents: DataFrame, text_col: str, words: int) -> DataFrame:
    roots = connected_components(links(rows, documents, text_col, words)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``documents`` with one row of each component, that of its smallest id; texts without words all stay, but for rows that are
    equal in id and text. Columns and texts are otherwise as they came; null ids come last in a component, long texts are compared
    whole, and an empty table gives an empty one."""
    rows = signatures(documents, id_col, text_col, words)
    nodes = materialize(rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    linked = _components(rows, nodes, documents, text_col, words)
    found = lookup(rows.select("id", "tie", "fp"), linked.select("fp", "root", "n"), "fp", "n")
    alone = F.struct(F.lit(None).cast("long").alias("root"), "id", "tie")
    found = found.withColumn("root", F.when(F.col("fp").isNull(), alone).otherwise(F.struct("root", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), F.lit(None).cast("long").alias("tie"))))
    return first_of(documents, found, rows, id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles and a similarity of 0.8, over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as materialized (select distinct doc_id, array_to_string(w[k:k + 3], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as k from w where len(w) > 0)),
 n as materialized (select doc_id, count(*) as n from s group by 1),
 c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (s) where a.doc_id < b.doc_id group by 1, 2),
 l as materialized (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
 e as materialized (select x, y from l union select y, x from l),
 r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x)
 select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents join (select x as doc_id, min(y) as component_id from r group by 1) using (doc_id) left join n using (doc_id)"""
