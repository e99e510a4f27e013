"""Benchmark decontamination: a broadcast set of benchmark windows against every window of the training texts.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Executors hold
the benchmark's words and windows as numbers, turn each text into word numbers, find windows through a rolling hash over
whole batches and verify each hit word by word. The benchmark's words are counted first. Up to ``limit`` words they are
broadcast; beyond that, the documents' windows meet the items' windows in a shuffle join, with the same results.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vocalith.llm.native import unused
from vocalith.plans.scratch import materialize

#: Separators to a space and A-Z to a-z; digits, letters and every byte from 128 are word bytes.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words of a benchmark that are broadcast at most: about 100 bytes each in a worker.
BROADCAST_WORDS = 300_000
#: Texts that are searched at once.
BLOCK = 256
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FOUND = "n_words long, n_hit long, item_ids array<{}>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of a benchmark, by length, as tuples of word numbers."""

    def __init__(self, items: list[tuple], window: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple, set] = defaultdict(set)
        for key, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            for at in range(max(1, len(w) - window + 1) if w else 0):
                self.items[tuple(w[at : at + window])].add(key)
        self.hashes = {}
        for n in sorted({len(t) for t in self.items}):
            rows = np.array([t for t in self.items if len(t) == n], np.uint64)
            self.hashes[n] = np.unique(self._rolled(rows.ravel(), n)[::n])

    @staticmethod
    def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n numbers from each place on."""
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            out = out * BASE + ids[k : len(ids) - n + 1 + k]
        return out

    def search(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, set]]]]:
        """For each text its number of words, which are hit, and the windows found: (start, length, items)."""
        parts, sizes, gap = [], [], np.zeros(max(self.hashes, default=0), np.int32)
        for t in texts:
            w = words_of(t)
            parts += [np.fromiter(map(self.number.get, w, repeat(0)), np.int32, len(w)), gap]
            sizes.append(len(w))
        ids = np.concatenate(parts) if parts else gap
        starts = np.cumsum([0, *(n + len(gap) for n in sizes)])
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        hits = defaultdict(list)
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if len(at):
                rolled = np.zeros(len(at), np.uint64)
                for k in range(n):
                    rolled = rolled * BASE + ids[at + k].astype(np.uint64)
                for p in at[np.isin(rolled, hashes)].tolist():
                    if found := self.items.get(tuple(ids[p : p + n].tolist())):
                        hits[int(np.searchsorted(starts, p, "right")) - 1].append((p, n, found))
        for i, n in enumerate(sizes):
            mark = np.zeros(n, bool)
            own = [(p - int(starts[i]), length, found) for p, length, found in hits.get(i, ())]
            for p, length, _ in own:
                mark[p : p + length] = True
            yield n, mark, own


def runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def find(documents: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "found", limit: int = BROADCAST_WORDS) -> DataFrame:
    """``documents`` with a struct column ``out``: n_words, n_hit, item_ids (sorted) and spans of hit words (end exclusive).

    Null and empty texts have no words; null and wordless items have no window; equal windows of several items name all of
    them; repeated documents are judged each on its own. Long texts are searched whole; an empty table gives an empty one.
    Other columns pass through, whatever their names; ``out`` replaces a column of that name.
    """
    held = items.select(F.col(item_id).alias("k"), F.col(item_text).cast("binary").alias("t")).where("k is not null and t is not null")
    shared = _shared(held, limit)
    if shared is None:
        return _joined(documents, held, window, text_col, out)
    return documents.withColumn(out, _searching(shared, window, dict(held.dtypes)["k"])(F.col(text_col).cast("binary")))


def _shared(held: DataFrame, limit: int):
    """The items as a broadcast, if they have at most ``limit`` words; a word and its separator take two bytes at least."""
    if (held.select(F.sum(F.octet_length("t") / 2 + 1)).first()[0] or 0) > limit:
        return None
    return held.sparkSession.sparkContext.broadcast([(r.k, bytes(r.t)) for r in held.collect()])


def _searching(shared, window: int, kind: str):
    @F.pandas_udf(FOUND.format(kind))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = Windows(shared.value, window)
        for batch in batches:
            rows = []
            for n, mark, own in (x for at in range(0, len(batch), BLOCK) for x in windows.search(list(batch[at : at + BLOCK]))):
                ids = sorted({k for _, _, found in own for k in found})
                rows.append((n, int(mark.sum()), ids, [{"start": a, "end": b} for a, b in runs(mark)] if own else []))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    return search


def _joined(documents: DataFrame, held: DataFrame, window: int, text_col: str, out: str) -> DataFrame:
    """The same through a shuffle join of windows, for a benchmark that is too large to broadcast."""

    @F.pandas_udf("array<struct<at:long,n:int,h:binary>>")
    def windows(texts: pd.Series, short: pd.Series) -> pd.Series:
        def of(t, lengths):
            w = words_of(t)
            if lengths is None:
                return [(a, min(window, len(w)), hashlib.blake2b(b" ".join(w[a : a + window]), digest_size=16).digest()) for a in range(max(1, len(w) - window + 1) if w else 0)]
            return [(a, n, hashlib.blake2b(b" ".join(w[a : a + n]), digest_size=16).digest()) for n in lengths for a in range(len(w) - n + 1)]

        return pd.Series([[{"at": a, "n": n, "h": h} for a, n, h in of(t, s)] for t, s in zip(texts, short, strict=True)])

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    item = held.select("k", F.explode(windows("t", F.lit(None).cast("array<int>"))).alias("w")).select("k", "w.n", "w.h").distinct()
    lengths = [r.n for r in item.select("n").distinct().collect()]  # at most ``window`` values
    taken = [*documents.columns, out]
    row, n_col, ids_col, spans_col, hit_col, found_col = (unused(x, taken) for x in ("_row", "_n", "_ids", "_spans", "_hit", "_found"))
    own = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")  # three branches see the same numbers
    text = F.col(text_col).cast("binary")
    seen = own.select(F.col(row).alias("_row"), F.explode(windows(text, F.array(*[F.lit(int(n)) for n in lengths]))).alias("w")).select("_row", "w.at", "w.n", "w.h")
    hit = seen.join(item, ["n", "h"])
    names = hit.groupBy("_row").agg(F.sort_array(F.collect_set("k")).alias("item_ids"))
    word = hit.select("_row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("p")).distinct()
    island = word.withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy("_row").orderBy("p")))
    spans = island.groupBy("_row", "g").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("end"))
    spans = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    empty = f"cast(array() as array<{dict(held.dtypes)['k']}>)", "cast(array() as array<struct<start:long,end:long>>)"
    names = names.select(F.col("_row").alias(row), F.col("item_ids").alias(ids_col))
    spans = spans.select(F.col("_row").alias(row), F.col("spans").alias(spans_col), F.col("n_hit").alias(hit_col))
    joined = own.withColumn(n_col, count(text)).join(names, row, "left").join(spans, row, "left")
    found = F.struct(F.col(n_col).alias("n_words"), F.coalesce(hit_col, F.lit(0).cast("long")).alias("n_hit"), F.coalesce(ids_col, F.expr(empty[0])).alias("item_ids"), F.coalesce(spans_col, F.expr(empty[1])).alias("spans"))
    return joined.withColumn(found_col, found).select(*[c for c in documents.columns if c != out], F.col(found_col).alias(out))


def _cleaning(shared, window: int):
    @F.pandas_udf("n_words long, n_hit long, text string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = Windows(shared.value, window)
        for batch in batches:
            rows = []
            for part in (list(batch[at : at + BLOCK]) for at in range(0, len(batch), BLOCK)):
                rows += [(n, int(mark.sum()), remove(bytes(t).decode(), runs(mark)) if own else None) for t, (n, mark, own) in zip(part, windows.search(part), strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "text"])

    return cleaned


def clean(documents: DataFrame, items: DataFrame, drop_share: float = 0.5, window: int = 10, text_col: str = "text", limit: int = BROADCAST_WORDS) -> DataFrame:
    """``documents`` without benchmark passages: hit words are cut out of a text with what stands between them; a document
    with at least ``drop_share`` of its words hit is removed. Texts without a hit, and nulls, stay as they are. Long texts are
    searched whole; no documents give no rows, and no items leave all rows as they are."""
    own = unused("_found", documents.columns)
    held = items.select(F.col("item_id").alias("k"), F.col("text").cast("binary").alias("t")).where("k is not null and t is not null")
    shared = _shared(held, limit)
    if shared is None:
        found = _joined(documents, held, window, text_col, own)

        @F.pandas_udf("string")
        def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([remove(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(texts, spans, strict=True)])

        text = cut(text_col, f"{own}.spans")
    else:  # one worker a task searches and cuts
        found = documents.withColumn(own, _cleaning(shared, window)(F.col(text_col).cast("binary")))
        text = F.col(f"{own}.text")
    hit = F.col(f"{own}.n_hit") > 0
    kept = found.where(~(hit & (F.col(f"{own}.n_hit") >= drop_share * F.col(f"{own}.n_words"))))
    return kept.withColumn(text_col, F.when(hit, text).otherwise(F.col(text_col))).select(*documents.columns)


def remove(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans``."""
    if text is None or not spans:
        return text
    raw = text.encode()
    plain = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : first[a]])
        at = last[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def query(spark, sf_dir: str) -> DataFrame:
    """Ten-word windows of the whole benchmark in all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    f = find(documents, items).select("doc_id", "found.*")
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return f.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with d as (select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
item as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[a:a + least(10, len(w)) - 1], ' ') as t
         from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as a from b where len(w) > 0)),
lens as (select distinct n from item),
seen as (select doc_id, n, a, array_to_string(w[a:a + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as a from d, lens)),
hit as (select doc_id, a, seen.n, item_id from seen join item using (n, t)),
word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(a, a + n)) as p from hit) group by 1),
ids as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join ids using (doc_id)
"""
