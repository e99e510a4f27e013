"""Hard-negative mining over an R-tree packed by sort-tile-recursive (STR).

Tree: the vectors are cut into slabs by quantiles of the coordinate of greatest variance, slabs into tiles by the next one, and
tiles, label by label, into runs of the third and fourth: leaves of ``LEAF`` vectors, ``FAN`` leaves a node. A tile of more than
``TILE`` vectors (many equal ones) is split by row number, so no group grows with the data. Each leaf and each node has a minimum
bounding box. A box and an anchor give an interval of inner products: each coordinate adds its own interval, from the lower or the
upper side of the box by the sign of the anchor's.

Search, in two passes over the nodes, for blocks of ``ANCHORS`` anchors: each task goes through its nodes for each anchor best
first, by the upper end of the interval, and keeps the best so far. The first pass finds the positives: nodes of other
labels are left, and it stops at a node strictly below the k-th score. The second has a window of scores for each positive:
boxes that lie outside all windows, or strictly below the k-th score of those that they reach, are pruned, first nodes and then leaves. Ties
are whole, as only what is strictly below goes. The best of the tasks are merged by anchor.

Vectors are integers here, and all scores and bounds are exact: sums are taken in doubles while they stay below 2^53, else in
64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.plans.scratch import materialize

LEAF, FAN, TILE = 64, 16, 4096
#: Tiles at most, which bounds the broadcast of their edges; larger tables have larger tiles, split by row number.
TILES = 1 << 16
ANCHORS = 2048
#: Components are held to this size, so that 64-bit sums are exact for up to 32,768 of them: beyond any embedding's.
MOST = 1 << 24
NO_ID = np.iinfo(np.int64).max
NODE = "label {label}, sizes array<int>, lo array<int>, hi array<int>, ids array<long>, rows array<long>, x binary"


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(scale * x.cast("double")), F.lit(-MOST)), F.lit(MOST)).cast("int"))


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def packed(rows: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame, int]:
    """The table of all vectors (row, id, label, v) that take part, the nodes of their tree, both written, and the longest vector's
    length."""
    fit = rows.where(F.col(label).isNotNull() & finite(F.col(vector)))
    v = materialize(fit.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), integers(F.col(vector)).alias("v")), "vectors")
    size = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    spread = v.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "k").limit(4)
    axes = [r.k for r in spread.collect()] or [0]
    tiles = min(TILES, max(1, math.ceil(size.n / TILE)))
    slabs = math.ceil(math.sqrt(tiles))
    at = lambda k: F.coalesce(F.get("v", F.lit(axes[k % len(axes)])), F.lit(0))
    cuts = lambda n: F.array(*[F.lit(k / n) for k in range(1, n)])
    place = lambda x, edges: F.size(F.filter(edges, lambda e: x >= e))
    tiled = v.withColumns({"slab": F.lit(0), "tile": F.lit(0)})
    if slabs > 1:
        edges = v.agg(F.percentile_approx(at(0), cuts(slabs), F.lit(10_000))).first()[0]
        tiled = tiled.withColumn("slab", place(at(0), F.array(*map(F.lit, edges))))
        inner = tiled.groupBy("slab").agg(F.percentile_approx(at(1), cuts(slabs), F.lit(10_000)).alias("edges"))
        tiled = tiled.join(F.broadcast(inner), "slab").withColumn("tile", place(at(1), F.col("edges"))).drop("edges")
    parts = tiled.groupBy("slab", "tile").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    tiled = tiled.join(F.broadcast(parts), ["slab", "tile"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    width, kind = size.d or 0, dict(v.dtypes)["label"]

    def runs(x: np.ndarray, picked: np.ndarray, by: list[int]) -> np.ndarray:
        """``picked`` rows in the order of tiles of ``LEAF`` of them."""
        leaves = math.ceil(len(picked) / LEAF)
        if leaves <= 1 or not by:
            return picked
        picked = picked[np.argsort(x[picked, by[0]], kind="stable")]
        step = LEAF * math.ceil(leaves / math.ceil(leaves ** (1 / len(by))))
        return np.concatenate([runs(x, picked[k : k + step], by[1:]) for k in range(0, len(picked), step)])

    def pack(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("row", ignore_index=True)
        x = np.zeros((len(tile), width), np.int32)
        for k, vec in enumerate(tile["v"]):
            x[k, : len(vec)] = vec
        ids, row, out = tile["id"].to_numpy(np.int64), tile["row"].to_numpy(np.int64), []
        for name, picked in tile.groupby("label", sort=True).indices.items():
            picked = runs(x, np.sort(picked), [a for a in axes[2:] if a < width])
            for k in range(0, len(picked), LEAF * FAN):
                some = picked[k : k + LEAF * FAN]
                heads = np.arange(0, len(some), LEAF)
                lo, hi = (f.reduceat(x[some], heads, axis=0).ravel() for f in (np.minimum, np.maximum)) if width else (x[0], x[0])
                out.append((name, np.diff(heads, append=len(some)), lo, hi, ids[some], row[some], x[some].tobytes()))
        return pd.DataFrame(out, columns=["label", "sizes", "lo", "hi", "ids", "rows", "x"])

    nodes = tiled.select("slab", "tile", "part", "row", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "label", "v").groupBy("slab", "tile", "part").applyInPandas(pack, NODE.format(label=kind))
    return v, materialize(nodes, "nodes"), width


class Best:
    """The ``k`` best (score, id, row) so far: higher scores first, then smaller ids, then rows."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score = self.id = self.row = np.zeros(0, np.int64)

    def least(self) -> int:
        """The lowest score that can still enter."""
        return self.low if len(self.score) < self.k else max(self.low, int(self.score[-1]))

    def take(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = (score >= self.least()) & (score <= self.high)
        if fit.any():
            s, i, r = (np.concatenate(x) for x in ((self.score, score[fit]), (self.id, ids[fit]), (self.row, rows[fit])))
            first = np.lexsort((r, i, -s))[: self.k]
            self.score, self.id, self.row = s[first], i[first], r[first]


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with what is in each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def _searcher(anchors: np.ndarray, labels: list, own: np.ndarray, windows: list[list[tuple[int, int]]], k: int, same: bool):
    """The function that a task runs over its nodes: per anchor and window of scores the ``k`` best rows of the anchor's label
    (``same``, without its own row) or of other labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = [[Best(k, *w) for w in ws] for ws in windows]
        width = anchors.shape[1]
        for batch in batches:
            x = [np.frombuffer(b, np.int32).reshape(-1, width) for b in batch["x"]]
            largest = max((int(np.abs(m).max(initial=0)) for m in x), default=0)
            kind = np.float64 if width * largest * int(np.abs(anchors).max(initial=0)) < 2**53 else np.int64
            a, x = anchors.astype(kind), [m.astype(kind) for m in x]
            boxes = [[np.array(b).reshape(-1, width).astype(kind) for b in batch[c]] for c in ("lo", "hi")]
            name, ids, rows, sizes = batch["label"].tolist(), list(batch["ids"]), list(batch["rows"]), list(batch["sizes"])
            low, high = bounds(a, np.array([b.min(axis=0) for b in boxes[0]]), np.array([b.max(axis=0) for b in boxes[1]]))
            order = np.argsort(-high, axis=1, kind="stable")
            code = {n: c for c, n in enumerate(dict.fromkeys([*name, *labels]))}
            theirs = np.array([code[n] for n in name])
            for q, held in enumerate(top):
                if not held:
                    continue
                queue = order[q][(theirs[order[q]] == code[labels[q]]) == same]
                least, most = np.array([b.least() for b in held]), np.array([b.high for b in held])
                for node in queue:
                    if high[q, node] < least.min():
                        break
                    if not ((high[q, node] >= least) & (low[q, node] <= most)).any():
                        continue
                    at, to = bounds(a[q : q + 1], boxes[0][node], boxes[1][node])
                    reach = ((to[0][:, None] >= least) & (at[0][:, None] <= most)).any(axis=1)
                    if not reach.any():
                        continue
                    inside = np.repeat(reach, sizes[node])
                    if same:
                        inside &= rows[node] != own[q]
                    score = (x[node][inside] @ a[q]).astype(np.int64)
                    hit = ((score[:, None] >= least) & (score[:, None] <= most)).any(axis=0)
                    for w in np.flatnonzero(hit):
                        held[w].take(score, ids[node][inside], rows[node][inside])
                        least[w] = held[w].least()
        found = [(q, w, s, i, r) for q, held in enumerate(top) for w, b in enumerate(held) for s, i, r in zip(b.score.tolist(), b.id.tolist(), b.row.tolist(), strict=True)]
        yield pd.DataFrame(found, columns=["q", "w", "score", "id", "row"])

    return run


def _best(nodes: DataFrame, run, k: int) -> DataFrame:
    """The ``k`` best of all tasks by anchor and window, with their rank."""
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id", "row")
    return nodes.mapInPandas(run, "q int, w int, score long, id long, row long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Per anchor (a row for which ``anchors``, a condition on the id column, holds) and each of its ``positives`` best other rows of the same
    label: the ``negatives`` best rows of other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``. Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of floor(256 x); ties go by ascending id, null ids last, then by row. Rows with a null label, a null vector or a null or
    non-finite component take no part. Vectors of different lengths are filled up with zeros; components are held to
    65,536 in size. Repeated rows are rows of their own, so one can be another's positive; an anchor without positives, and a positive without
    negatives in its window, give no row. No rows: an empty table. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    v, nodes, width = packed(rows, id_col, vector, label)
    chosen = v.withColumnRenamed("id", id_col).where(anchors).withColumnRenamed(id_col, "id")
    n = chosen.count()
    blocks = max(1, math.ceil(n / ANCHORS))
    found = None
    for b in range(blocks):
        some = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()  # ANCHORS rows, about
        a = np.zeros((len(some), width), np.int64)
        for k, r in enumerate(some):
            a[k, : len(r.v)] = r.v
        labels, own = [r.label for r in some], np.array([r.row for r in some], np.int64)
        every = [[(-(2**62), 2**62)] for _ in some]
        best = _best(nodes, _searcher(a, labels, own, every, positives, True), positives).collect() if some else []  # ANCHORS * positives rows
        pairs = sorted((r.q, r.rank, r.id, r.score) for r in best)
        windows: list[list[tuple[int, int]]] = [[] for _ in some]
        for q, _, _, s in pairs:
            windows[q].append((-((-low * s) // 100), (high * s) // 100))
        named = spark.createDataFrame([(q, k - 1, some[q].id, None if i == NO_ID else i, s) for q, k, i, s in pairs], "q int, w int, anchor_id long, positive_id long, positive_score long")
        hard = _best(nodes, _searcher(a, labels, own, windows, negatives, False), negatives)
        out = hard.join(F.broadcast(named), ["q", "w"]).select("anchor_id", "positive_id", "rank", F.nullif("id", F.lit(int(NO_ID))).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = materialize(out, "mined") if blocks > 1 else out
        found = out if found is None else found.unionAll(out)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    """Five positives and three negatives of every fiftieth row; labels of every seventh row are wrong on purpose."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 50 == 0)


ORACLE = """with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as materialized (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
 select p.a as anchor_id, p.b as positive_id, row_number() over w::int as rank, n.b as negative_id, p.s as positive_score, n.s as negative_score from p join s n on n.a = p.a and not n.same and 50 * p.s <= 100 * n.s and 100 * n.s <= 95 * p.s
 window w as (partition by p.a, p.b order by n.s desc, n.b) qualify row_number() over w <= 3"""
