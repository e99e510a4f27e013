"""Ranked lexical search: an index of block-compressed posting lists, searched by Block-Max MaxScore.

Index: each task cuts its documents into segments of bounded size (``SEGMENT_DOCS``, ``SEGMENT_BYTES``), with no shuffle of
texts. A segment has a row a term: its postings (place of the document, occurrences) in blocks of ``BLOCK``, each block
compressed on its own as variable-length gaps. Beside them, and readable without them, lie each block's last place, where it
ends, and its impacts: the pairs (occurrences, length of the document) of the block that no other pair of it beats, as a score
rises with occurrences and falls with length. They give the block's greatest score under any corpus statistics, so the index does
not depend on these. A segment has one more row, without a term, with the ids and lengths of its documents.

Search: a task goes through segments one after the other and keeps, for each query, the best ``k`` so far; the k-th of them is
the threshold. Each list's greatest block score is its global bound. Lists are put in the order of their bounds; as many of
the lowest as together stay below the threshold are non-essential: no document that is in these alone can enter. Essential lists
are added up; a candidate whose sum and the non-essential bounds stay below the threshold goes, then one whose sum and the
*block* maxima where it would lie stay below it goes, all before a non-essential block is decompressed. Lists are then added
from the highest bound down, only blocks with candidates left are decompressed, and candidates go as soon as they can't reach the
threshold any more. Only what is surely below it goes, so ties are whole. The heaps of tasks are merged by query.

Queries are taken in blocks of a bounded number of terms, each against all segments.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vocalith.plans.scratch import materialize

#: Bounds of a segment: documents, and bytes of text after which it ends.
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 16 << 20
#: Postings of a block.
BLOCK = 128
#: Terms of the queries that are searched at once, which bounds what reaches the driver and every task. A query has its terms
#: together, however many.
QUERY_TERMS = 100_000
#: Digits, small letters and bytes beyond ASCII stay, capitals become small, all else is a gap.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max
INDEX = "segment long, term string, n int, total long, lasts array<int>, ends array<int>, fronts array<int>, impacts array<long>, data binary, ids array<long>"


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, in order; only A-Z are folded."""
    return text.translate(FOLD).split() if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative integers, seven bits each, and where each ends."""
    width = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 6))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        more = width > k
        out[ends[more] - width[more] + k] = (values[more] >> (7 * k)) & 127 | np.where(width[more] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The integers of ``packed``."""
    stops = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], stops[:-1] + 1])
    at = np.arange(len(data)) - np.repeat(starts, stops - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), starts)


def posting_rows(segment: int, ids: list, lengths: np.ndarray, words: list[bytes], code: np.ndarray, doc: np.ndarray, tf: np.ndarray, size: int = BLOCK) -> pa.Table:
    """The index rows of a segment, from its postings in any order: number of the term in ``words``, document, occurrences."""
    order = np.lexsort((doc, code))
    code, doc, tf = code[order], doc[order], tf[order]
    n = len(code)
    head = np.flatnonzero(np.diff(code, prepend=-1)) if n else np.zeros(0, np.int64)  # of lists
    df = np.diff(head, append=n)
    inside = np.arange(n) - np.repeat(head, df)
    first = np.flatnonzero(inside % size == 0)  # of blocks
    in_block = np.diff(first, append=n)
    gaps = np.where(inside % size == 0, doc, np.diff(doc, prepend=0))
    data, ends = packed(np.stack([gaps, tf], axis=1).ravel())
    byte_end = ends[1::2][first + in_block - 1] if n else np.zeros(0, np.int64)
    block = np.repeat(np.arange(len(first)), in_block)
    by = np.lexsort((-tf, lengths[doc], block)) if n else np.zeros(0, np.int64)
    best = np.maximum.accumulate((block[by] << 32) | tf[by]) if n else by
    front = by[np.diff(best, prepend=-1) > 0]  # more occurrences than any shorter document of the block
    per_list = np.diff(np.searchsorted(first, np.append(head, n)))
    base = np.repeat(np.concatenate([[0], byte_end[np.cumsum(per_list) - 1]])[:-1], per_list) if n else byte_end
    offsets = np.concatenate([[0], np.cumsum(per_list)]).astype(np.int32)
    ints = lambda x, o=offsets: pa.ListArray.from_arrays(pa.array(o), pa.array(x.astype(np.int32)))
    fronts = np.bincount(block[front], minlength=len(first)) if n else first
    impact_at = np.concatenate([[0], np.cumsum(fronts)])[offsets].astype(np.int32)
    stop = np.concatenate([[0], byte_end[np.cumsum(per_list) - 1]]).astype(np.int32) if n else np.zeros(1, np.int32)
    columns = {
        "segment": pa.array(np.full(len(head), segment)), "term": pa.array([words[c] for c in code[head]], pa.binary()).cast(pa.string()), "n": pa.array(df.astype(np.int32)), "total": pa.nulls(len(head), pa.int64()),
        "lasts": ints(doc[first + in_block - 1]), "ends": ints(byte_end - base), "fronts": ints(fronts), "impacts": pa.ListArray.from_arrays(pa.array(impact_at), pa.array((tf[front] << 32) | lengths[doc[front]])),
        "data": pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(stop), pa.py_buffer(data)]), "ids": pa.nulls(len(head), pa.list_(pa.int64())),
    }
    lists = pa.table(columns)
    about = {"segment": [segment], "term": [None], "n": [int((lengths > 0).sum())], "total": [int(lengths.sum())], "lasts": [None], "ends": [None], "fronts": [None], "impacts": [None], "data": [lengths.astype(np.int64).tobytes()], "ids": [ids]}
    return pa.concat_tables([pa.table(about, schema=lists.schema), lists])


def index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = SEGMENT_DOCS, block: int = BLOCK) -> DataFrame:
    """The written index of all rows of ``documents``, null and empty texts included. Ids are integers. No documents: no rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        fresh = lambda: ([], [], defaultdict(count().__next__), [], [], [], 0)
        ids, lengths, vocabulary, code, doc, tf, size = fresh()

        def rows() -> Iterator[pa.RecordBatch]:
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield from posting_rows((task << 32) | next(number), ids, np.array(lengths, np.int64), list(vocabulary), join(code), join(doc), join(tf), block).to_batches(max_chunksize=1 << 14)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py())
                counts = Counter(found)
                code.append(np.fromiter(map(vocabulary.__getitem__, counts), np.int64, len(counts)))
                tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
                doc.append(np.full(len(counts), len(ids)))
                ids.append(key)
                lengths.append(len(found))
                size += len(text.as_py() or b"")
                if len(ids) >= segment_docs or size >= SEGMENT_BYTES:
                    yield from rows()
                    ids, lengths, vocabulary, code, doc, tf, size = fresh()
        if ids:
            yield from rows()

    return materialize(documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))), F.col(text_col).cast("binary")).mapInArrow(build, INDEX), "postings")


def part(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A term's share of a score, before its weight."""
    m = 50 + (50 * length * docs) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Segment:
    """The posting lists of a segment that queries ask for."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray, docs: int, total: int):
        self.lengths, self.ids, self.docs, self.total = lengths, ids, docs, total
        self.lists: dict[int, tuple] = {}
        self.bound: dict[int, int] = {}
        self.opened: dict[tuple, tuple] = {}  # blocks, and whole lists, that a query has asked for
        self.whole: dict[int, tuple] = {}

    def add(self, term: int, weight: int, lasts, ends, fronts, impacts, data: bytes) -> None:
        pairs = np.asarray(impacts, np.int64)
        starts = np.concatenate([[0], np.cumsum(fronts)[:-1]]).astype(np.int64)
        most = weight * np.maximum.reduceat(part(pairs >> 32, pairs & 0xFFFFFFFF, self.docs, self.total), starts)
        self.lists[term] = (weight, np.asarray(lasts, np.int64), np.concatenate([[0], ends]).astype(np.int64), most, data)
        self.bound[term] = int(most.max())

    def block(self, term: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term adds to their scores; opened once."""
        if (term, k) not in self.opened:
            weight, _, ends, _, data = self.lists[term]
            pairs = unpacked(np.frombuffer(data, np.uint8, ends[k + 1] - ends[k], ends[k])).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0])
            self.opened[term, k] = docs, weight * part(pairs[:, 1], self.lengths[docs], self.docs, self.total)
        return self.opened[term, k]

    def best(self, wanted: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the best and their scores: all of at least ``least`` (and above 0), and no wrong score."""
        lists = sorted((t for t in wanted if t in self.lists), key=self.bound.__getitem__)
        below = np.cumsum([0, *(self.bound[t] for t in lists)])
        split = int(np.searchsorted(below[1:], least, "left"))  # lists before it stay below the threshold together
        score = np.zeros(len(self.lengths), np.int64)
        for t in lists[split:]:
            if t not in self.whole:
                self.whole[t] = tuple(np.concatenate(x) for x in zip(*(self.block(t, k) for k in range(len(self.lists[t][1]))), strict=True))
            docs, adds = self.whole[t]
            score[docs] += adds
        found = np.flatnonzero((score > 0) & (score + below[split] >= least))
        score = score[found]
        rest = lists[:split]
        if rest and len(found):
            at = {t: np.searchsorted(self.lists[t][1], found) for t in rest}
            most = {t: np.append(self.lists[t][3], 0)[at[t]] for t in rest}
            left = sum(most.values())
            for t in reversed(rest):
                keep = score + left >= least
                found, score, left = found[keep], score[keep], left[keep]
                at, most = ({u: x[u][keep] for u in x} for x in (at, most))
                left = left - most[t]
                blocks = at[t]
                for k in np.unique(blocks[blocks < len(self.lists[t][1])]):
                    docs, adds = self.block(t, int(k))
                    here = np.flatnonzero(blocks == k)
                    place = np.minimum(np.searchsorted(docs, found[here]), len(docs) - 1)
                    score[here] += np.where(docs[place] == found[here], adds[place], 0)
        keep = score >= max(least, 1)
        return found[keep], score[keep]


def _searcher(queries: list[list[int]], weights: dict[int, int], docs: int, total: int, k: int):
    """The function that a task runs over its segments, sorted by segment and then the row without a term first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)

        def through(seg: Segment | None) -> None:
            for q, wanted in enumerate(queries if seg else []):
                scores, ids = top[q]
                found, fresh = seg.best(wanted, int(scores[-1]) if len(scores) == k else 0)
                if len(found):
                    scores, ids = np.concatenate([scores, fresh]), np.concatenate([ids, seg.ids[found]])
                    first = np.lexsort((ids, -scores))[:k]
                    top[q] = scores[first], ids[first]

        seg, now = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.segment != now:
                    through(seg)
                    ids = np.asarray(r.ids, np.int64)
                    seg, now = Segment(np.frombuffer(r.data, np.int64), ids, docs, total), r.segment
                else:
                    seg.add(int(r.t), weights[int(r.t)], r.lasts, r.ends, r.fronts, r.impacts, r.data)
        through(seg)
        rows = [(q, i, s) for q, (scores, ids) in enumerate(top) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["q", "id", "score"])

    return run


def search(postings: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", out_col: str = "doc_id") -> DataFrame:
    """Per item its ``k`` best documents of the index with a score above 0: the item's id, rank (from 1), document id, score.

    Ties go by ascending document id, null ids last. Texts without a term, null or empty, find nothing and are not found; an
    item of repeated terms counts each once, however long it is. Repeated items count once; items that share an id but not the text are ranked
    each on its own. Documents of one id are ranked each on its own. No items or no documents: no rows. Only the named columns
    are read, whatever the others are called.
    """
    spark = postings.sparkSession

    @F.pandas_udf("array<string>")
    def folded(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.decode() for w in terms(t)}) for t in texts], dtype=object)

    asked = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    asked = materialize(asked.select("item", folded(F.col("text").cast("binary")).alias("terms"), F.xxhash64("item", "text").alias("h")).where("size(terms) > 0"), "items")
    size = postings.where("term is null").agg(F.sum("n").alias("docs"), F.sum("total").alias("total")).first()
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / QUERY_TERMS))
    found = None
    for b in range(blocks):
        some = asked.where(F.pmod("h", F.lit(blocks)) == b).orderBy("item", "h").collect()  # QUERY_TERMS terms, about
        number = {w: t for t, w in enumerate(sorted({w for r in some for w in r.terms}))}
        named = spark.createDataFrame(list(number.items()) or [], "term string, t int")
        lists = postings.join(F.broadcast(named), "term")
        df = {r.t: r.df for r in lists.groupBy("t").agg(F.sum("n").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * size.docs + 2) / (2 * n + 1))) for t, n in df.items()}
        run = _searcher([[number[w] for w in r.terms] for r in some], weights, size.docs or 0, size.total or 0, k)
        columns = ["segment", "t", "lasts", "ends", "fronts", "impacts", "data", "ids"]
        rows = lists.select(*columns).union(postings.where("term is null").withColumn("t", F.lit(-1)).select(*columns))
        heaps = rows.repartition("segment").sortWithinPartitions("segment", "t").mapInPandas(run, "q int, id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item) for q, r in enumerate(some)], f"q int, item {dict(asked.dtypes)['item']}")
        out = best.join(F.broadcast(names), "q").select(F.col("item").alias(id_col), "rank", F.nullif("id", F.lit(int(NO_ID))).alias(out_col), "score")
        out = materialize(out, "found") if blocks > 1 else out
        found = out if found is None else found.unionAll(out)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(index(documents), items)


ORACLE = """with fold as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as t from documents),
 tf as (select doc_id, len(t) as n, unnest(t) as term from fold), p as (select doc_id, n, term, count(*) as tf from tf group by all),
 s as (select count(*) as docs, sum(len(t))::bigint as total from fold where len(t) > 0),
 q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) as term from benchmark),
 w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term, docs),
 r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint as score from q join p using (term) join w using (term), s group by 1, 2)
 select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0) where rank <= 50"""
