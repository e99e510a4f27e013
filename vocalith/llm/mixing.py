"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, permuted block indexes.

The documents of a source, in the order of a hash, are one stream of words, cut into blocks of ``block`` words. A source's
target is its share by weight, at most ``cap`` times its size, what is cut off going to the others by weight. Every output
shard draws from a multinomial how many of its slots each source gets, with what the sources still have to give as chances,
so that over all shards each source gives exactly its target. A source's slots go through a pseudorandom permutation of its
blocks, a new one for each pass over them; the last slot of a pass that isn't whole is cut to the words that are left.
Slots and documents meet in a join by block index: keys are many and even, whatever a source's share of the rows.

Only a row a source and a count for each shard and source reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vocalith.llm.native import unused
from vocalith.llm.sharding import Permutation
from vocalith.plans.scratch import materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP, BLOCK, SHARDS = 3, 256, 64
WORD = r"[^\x20\x09-\x0D]+"
#: Slots that one task row stands for.
CHUNK = 8_192
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Words each source should give: ``weight`` times one level, at most ``cap`` times its size, all sizes in sum."""
    order = sorted(range(len(sizes)), key=lambda k: cap * sizes[k] / weights[k])
    left, weight, level = float(sum(sizes)), float(sum(weights)), 0.0
    for k in order:
        level = left / weight
        if level * weights[k] <= cap * sizes[k]:
            break
        left, weight = left - cap * sizes[k], weight - weights[k]
    return [min(float(cap * n), level * w) for n, w in zip(sizes, weights, strict=True)]


def draws(slots: list[int], shards: int, seed: int) -> list[list[int]]:
    """Slots of each source in each shard; shards differ by one slot at most and together hold exactly ``slots``."""
    left, rng, out = np.array(slots, np.int64), np.random.default_rng(seed), []
    total = int(left.sum())
    for k in range(shards):
        need, got = total * (k + 1) // shards - total * k // shards, np.zeros_like(left)
        while need:
            rest = left - got
            step = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            got, need = got + step, need - int(step.sum())
        left = left - got
        out.append(got.tolist())
    return out


class Stream:
    """The slots of one source: slot j is pass j div blocks, and a place in that pass's permutation."""

    def __init__(self, index: int, size: int, target: float, block: int, seed: int):
        self.index, self.size, self.block, self.seed = index, size, block, seed
        self.blocks = -(-size // block)
        words = min(int(target + 0.5), CAP * size)
        self.passes, rest = divmod(words, size) if size else (0, 0)
        self.slots, self.cut = self.passes * self.blocks, block
        if rest:
            last = size - (self.blocks - 1) * block
            short = int(self.order(self.passes).back([self.blocks - 1])[0])  # the place of the one block that may be short
            before = short * block
            if rest <= before:
                more, base = -(-rest // block), 0
            elif rest <= before + last:
                more, base = short + 1, before - short * block
            else:
                more, base = short + 1 - (-(rest - before - last) // block), last - block
            self.slots, self.cut = self.slots + more, rest - base - (more - 1) * block

    def order(self, turn: int) -> Permutation:
        return Permutation(self.blocks, self.seed * 1_000_003 + self.index * 1_009 + turn)

    def at(self, first: int, last: int) -> pd.DataFrame:
        """Slots first .. last - 1: pass, block, and how many of the block's words are taken at most."""
        j = np.arange(first, last)
        turn, place = np.divmod(j, self.blocks)
        block = np.empty_like(j)
        for t in np.unique(turn):
            block[turn == t] = self.order(int(t)).forward(place[turn == t]).astype(np.int64)
        return pd.DataFrame({"turn": turn, "block": block, "most": np.where(j == self.slots - 1, self.cut, self.block)})


class Mix:
    """``documents``: id, source, size, source_size, target, source_index, start (in its source's stream), tie.
    ``pieces``: shard, slot, turn, source_index, block, start (of the document), word (in the document), n (words)."""

    def __init__(self, documents: DataFrame, pieces: DataFrame):
        self.documents, self.pieces = documents, pieces


def mix(documents: DataFrame, weights=WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan a mix of all ``documents``. Sources are ordered by code point, null last, and ``weights`` repeat over them.

    Null, empty and blank texts have no words and are never taken. Null sources are one source. Rows that agree in id and
    text are interchangeable. Other columns are not read; an empty table gives empty tables.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_col).alias("tie"))
    sized = materialize(narrow.withColumn("place", F.xxhash64("id", "tie", F.lit(seed))), "sized")
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in rows]
    wanted = targets(sizes, [float(weights[k % len(weights)]) for k in range(len(rows))]) if rows else []
    streams = [Stream(k, n, t, block, seed) for k, (n, t) in enumerate(zip(sizes, wanted, strict=True))]
    table = spark.createDataFrame([(r["source"], k, r["size"], t) for k, (r, t) in enumerate(zip(rows, wanted, strict=True))], "source string, source_index int, source_size long, target double")
    table = F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table
    known = sized.alias("d").join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_index", "source_size", "target")

    # where a document starts in its source's stream: bucket sums first, so that no task holds a source
    buckets = max(64, sum(r["n"] for r in rows) // 50_000)
    placed = known.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    inside = F.sum("size").over(Window.partitionBy("source_index", "bucket").orderBy("place", "id", "tie").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy("source_index", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("source_index", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    started = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(base, ["source_index", "bucket"])
    started = started.select("id", "source", "size", "tie", "source_index", "source_size", "target", (F.col("base") + F.col("inside")).alias("start"))
    started = materialize(started, "streams", sized)

    counts = draws([s.slots for s in streams], shards, seed) if streams else []
    ranges, given = [], [0] * len(streams)
    for shard, own in enumerate(counts):
        base_slot = 0
        for k, n in enumerate(own):
            if n:
                ranges.append((shard, k, given[k], given[k] + n, base_slot, sum(own)))
            given[k] += n
            base_slot += n
    held = spark.createDataFrame(ranges, "shard int, source_index int, first long, last long, base long, shard_slots long")
    chunk = F.explode(F.sequence("first", F.col("last") - 1, F.lit(CHUNK).cast("long"))).alias("a")
    chunks = held.select("*", chunk).withColumn("b", F.least("last", F.col("a") + CHUNK))
    own = {s.index: (s.index, s.size, t, block, seed) for s, t in zip(streams, wanted, strict=True)}
    shared = spark.sparkContext.broadcast(own)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, Stream] = {}
        for batch in batches:
            for r in batch.itertuples():
                k = int(r.source_index)
                known[k] = known.get(k) or Stream(*shared.value[k])
                out = known[k].at(int(r.a), int(r.b))
                at = r.base + np.arange(r.a, r.b) - r.first
                out["slot"] = Permutation(int(r.shard_slots), seed * 31 + int(r.shard)).forward(at).astype(np.int64)
                yield out.assign(shard=r.shard, source_index=k)

    deal = chunks.repartition(max(1, min(2_000, sum(s.slots for s in streams) // 50_000 + 1)))
    placed_slots = deal.mapInPandas(slots, "turn long, block long, most long, slot long, shard int, source_index int")

    block_of = lambda c: F.expr(f"{c} div {block}")
    parts = started.where("size > 0").select("source_index", "start", "size", F.explode(F.sequence(block_of("start"), block_of("(start + size - 1)"))).alias("block"))
    offset = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    word = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    parts = parts.select("source_index", "block", "start", word.alias("word"), offset.alias("offset"), F.least(F.col("size") - word, F.lit(block) - offset).alias("there"))
    # the slots come from a small table of ranges, so Spark takes them for small: a merge join, never a broadcast
    met = placed_slots.hint("merge").join(parts, ["source_index", "block"])
    pieces = met.select("shard", "slot", "turn", "source_index", "block", "start", "word", F.least("there", F.col("most") - F.col("offset")).alias("n")).where("n > 0")
    return Mix(started, pieces)


def taken(found: Mix) -> DataFrame:
    """The mix's documents with the number of words taken of each."""
    sums = found.pieces.groupBy("source_index", "start").agg(F.sum("n").alias("taken"))
    some, none = found.documents.where("size > 0"), found.documents.where("size = 0")
    return some.join(sums, ["source_index", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0))).unionByName(none.withColumn("taken", F.lit(0).cast("long")))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass over its source, a document's words that were taken, with its other columns.

    A document that is taken whole keeps its text; parts of one keep the text between their words, and parts that do not
    touch are joined by a line feed. ``n_chars``, if there, is counted again. Null, empty and blank texts have no words and
    are not in the mix. An empty table gives an empty one. Texts are cut whole, however long.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = mix(documents, **options)
    by_turn = found.pieces.groupBy("source_index", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("parts"))
    twin = Window.partitionBy("id", "tie").orderBy("start")
    keys = found.documents.where("size > 0").select("id", "tie", "source_index", "start", "size")
    planned = materialize(keys.join(by_turn, ["source_index", "start"]).select("id", "tie", "start", "size", "parts"), "planned")
    ranked = planned.withColumn("copy", F.dense_rank().over(twin))
    tie, copy, size, parts = (unused(x, documents.columns) for x in ("_tie", "_copy", "_size", "_parts"))
    whole_row = F.xxhash64(*[c for c, kind in documents.dtypes if not kind.startswith("map")])
    same = Window.partitionBy(id_col, tie).orderBy(text_col, whole_row)
    copies = documents.withColumn(tie, F.xxhash64(text_col)).withColumn(copy, F.row_number().over(same))
    on = F.col(f"d.{id_col}").eqNullSafe(F.col("p.id")) & (F.col(f"d.{tie}") == F.col("p.tie")) & (F.col(f"d.{copy}") - F.col("p.copy") == 0)
    met = copies.alias("d").join(ranked.alias("p"), on).select("d.*", F.col("p.size").alias(size), F.col("p.parts").alias(parts))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, [(p["word"], p["n"]) for p in own]) for t, own in zip(texts, parts, strict=True)])

    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["n"]) == F.col(size)
    out = met.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut(text_col, parts)))
    out = out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in documents.columns else out
    return out.select(*documents.columns)


def excerpt(text: str, parts: list[tuple[int, int]]) -> str:
    """The words of sorted ``parts`` (first word, number) with the text between them."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    runs: list[list[int]] = []
    for a, n in parts:
        if runs and runs[-1][1] == a:
            runs[-1][1] = a + n
        else:
            runs.append([a, a + n])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1."""
    found = taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
