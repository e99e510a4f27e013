"""Evaluation statistics: error rates, resampling, pairs, centroids, gates and queues."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.functions import text as T
from vocalith.plans.scratch import materialize

#: Letters that stand for distinct tokens of a pair; a pair with more goes through a Python function.
ALPHABET = 4_000


def token_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of token arrays: each distinct token of a pair becomes one letter, and the strings are compared."""
    letters = "".join(chr(0x4E00 + k) for k in range(ALPHABET))
    known = F.array_distinct(F.concat(ref, hyp))
    spelled = lambda arr, k: F.array_join(F.transform(arr, lambda t: F.substr(F.lit(letters), F.array_position(k, t).cast("int"), F.lit(1))), "")
    native = F.get(F.transform(F.array(known), lambda k: T.edit_distance(spelled(ref, k), spelled(hyp, k))), F.lit(0))
    return F.when(F.size(known) <= ALPHABET, native).otherwise(_long_distance(ref, hyp))


def _long_distance(ref: Column, hyp: Column) -> Column:
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            ids: dict = {}
            u, v = (np.array([ids.setdefault(t, len(ids)) for t in s]) for s in (x, y))
            row, place = np.arange(len(v) + 1), np.arange(len(v) + 1)
            for i, t in enumerate(u, 1):  # the best by deletion and substitution, then insertions as a running minimum
                best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (v != t))])
                row = np.minimum.accumulate(best - place) + place
            out.append(int(row[-1]))
        return pd.Series(out, dtype="int32")

    return of(ref, hyp)


def token_error_rate(ref: Column, hyp: Column) -> Column:
    """Token edit distance over the number of reference tokens; an empty reference is 0 against none, else 1."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(token_distance(ref, hyp) / F.size(ref))


def edits(a: str, b: str) -> int:
    """Levenshtein distance by bits: a column of the table is two numbers of as many bits as ``a`` has letters."""
    if a == b or not a or not b:
        return 0 if a == b else len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, found = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        steep, flat = same | down, ((same & up) + up) ^ up | same
        more, less = down | full & ~(flat | up), up & flat
        found += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = full & (less | ~(steep | more)), full & more & steep
    return found


def best_reference(rows: DataFrame, key: str, refs: str, hyps: str) -> DataFrame:
    """Per row the least bounded error over all references and hypothesis variants (arrays), and the first pair that has it."""
    @F.pandas_udf("struct<err:double,ref_pos:int,hyp_pos:int>")
    def best(us: pd.Series, vs: pd.Series) -> pd.DataFrame:
        out = []
        for u, v in zip(us, vs, strict=True):
            u, v = list(u), list(v)
            err = {(x, y): 1.0 if x is None or y is None else min(1.0, edits(x, y) / max(1, len(x))) for x in set(u) for y in set(v)}
            out.append(min((err[x, y], i, j) for i, x in enumerate(u) for j, y in enumerate(v)))
        return pd.DataFrame(out, columns=["err", "ref_pos", "hyp_pos"])

    bare = lambda c: F.transform(T.canon_all(F.col(c)), lambda t: F.replace(t, F.lit(" "), F.lit("")))
    each = rows.where((F.size(refs) > 0) & (F.size(hyps) > 0)).select(key, refs, hyps, best(bare(refs), bare(hyps)).alias("s"))
    texts = F.struct("s.err", F.get(refs, F.col("s.ref_pos")).alias("ref"), F.get(hyps, F.col("s.hyp_pos")).alias("hyp"))
    return each.groupBy(key).agg(F.min_by(texts, "s").alias("b")).select(key, "b.err", "b.ref", "b.hyp")


def keyword_hits(rows: DataFrame, key: str, text: str, wanted: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """Per row: share of wanted words that are whole words of the text, and those that are there only across spaces."""
    each = rows.select(key, T.canon(F.col(text)).alias("t"), F.explode(F.array_distinct(F.filter(wanted, lambda w: (F.length(w) > 2) & ~w.isin(*stop)) if stop else F.filter(wanted, lambda w: F.length(w) > 2))).alias("w"))
    w = T.canon(F.col("w"))
    hit = F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))
    split = ~hit & F.contains(F.replace("t", F.lit(" "), F.lit("")), w)
    return each.groupBy(key).agg((F.count_if(hit) / F.count("*")).alias("share"), F.array_sort(F.collect_list(F.when(split, F.col("w")))).alias("splits"))


def metric_table(rows: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Per metric, overall (category null) and by category: number, mean, median and p90 of what is not missing."""
    cats = rows.select(category).distinct().withColumn("all", F.lit(False))
    long = rows.unpivot([category], metrics, "metric", "value")
    level = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("c")), F.struct(F.col(category).cast("string").alias("c")))).alias("g")
    stats = long.where("value is not null").select("metric", "value", level).groupBy(F.col("g.c").alias(category), "metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    full = cats.select(F.col(category).cast("string").alias(category)).union(rows.sparkSession.range(1).select(F.lit(None).cast("string"))).select(category, F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    out = full.alias("f").join(stats.alias("s"), F.col(f"f.{category}").eqNullSafe(F.col(f"s.{category}")) & (F.col("f.metric") == F.col("s.metric")), "left")
    return out.select(f"f.{category}", "f.metric", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.get("p", F.lit(0)).alias("median"), F.get("p", F.lit(1)).alias("p90"))


def ordinals(rows: DataFrame, order: str, width: int = 10_000) -> DataFrame:
    """``rows`` with ``k``, their place from 0 by a unique long, and ``n``, their number: ranges are counted first."""
    ranged = rows.withColumn("_r", F.floor(F.col(order) / width))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_c"))
    sums = counts.select("_r", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_c").over(Window.partitionBy()).alias("n"))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy(order)) - 1
    return ranged.withColumn("_k", rank).join(F.broadcast(sums), "_r").withColumn("k", F.col("_b") + F.col("_k")).drop("_r", "_k", "_b")


def _drawn(seed: int, *parts: Column) -> Column:
    """A reproducible number from a seed and columns, from MD5."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), F.lit(1), F.lit(7)), 16, 10).cast("long")


#: Draws that one task makes.
DRAWS = 1_000_000


def draws(placed: DataFrame, b: int, seed: int, *by: str) -> DataFrame:
    """``b`` resamples of ``placed`` (k, n and ``by``), a written table: draw j of resample b takes row k = md5(seed|b|j) mod n."""
    each = placed.select(*by, F.col("k").alias("j"), "n").repartition(max(1, math.ceil(placed.count() * b / DRAWS)))
    many = each.select(*by, "j", "n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"))
    return many.select(*by, "b", "j", (_drawn(seed, F.col("b"), F.col("j")) % F.col("n")).alias("k"))


def met_draws(drawn: DataFrame, placed: DataFrame, *on: str) -> DataFrame:
    """``drawn`` with the row that each draw took. Spark takes the size of draws from before they are multiplied and would broadcast them;
    both sides are shuffled instead, and a task holds its share of ``placed``, a row a key."""
    return drawn.join(placed.hint("shuffle_hash"), list(on))


def resamples(rows: DataFrame, value: str, order: str, b: int, seed: int = 0) -> DataFrame:
    """Means of ``b`` resamples of rows with replacement: (b, mean). Draw j of resample b takes row md5(seed|b|j) mod n."""
    placed = materialize(ordinals(rows.select(order, value), order).select("k", "n", value), "placed")
    return met_draws(draws(placed, b, seed), placed.select("k", value), "k").groupBy("b").agg(F.avg(value).alias("mean"))


def poisson_resamples(rows: DataFrame, value: str, id_col: str, b: int, seed: int = 0) -> DataFrame:
    """Resampled means for many rows: each row counts a Poisson(1) number of times in each resample, decided by a hash of its id,
    so no draw has to meet a row. One partial sum a task and resample."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col(id_col)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cdf, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total, p = total + p, p / (k + 1)
        cdf.append(total)
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cdf), F.lit(0))
    each = rows.select(id_col, value, F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b")).withColumn("w", weight)
    return each.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def interval(means: DataFrame, mean: Column | None = None) -> DataFrame:
    """One row: the 2.5 % and 97.5 % points of resampled means."""
    p = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(p.alias("p")).select(F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))


def two_level(rows: DataFrame, sentence: str, repeat: str, value: str, b: int, seed: int = 0) -> DataFrame:
    """Means of resamples of sentences, then of one repeat inside each drawn sentence: (b, mean). Repeats are 0, 1, ..."""
    sizes = rows.groupBy(sentence).agg(F.count("*").alias("r"))
    placed = materialize(ordinals(sizes, sentence), "placed")
    inner = met_draws(draws(placed, b, seed), placed.select("k", sentence, "r"), "k").select("b", sentence, (_drawn(seed + 1, F.col("b"), F.col("j")) % F.col("r")).alias(repeat))
    return inner.hint("merge").join(rows.select(sentence, F.col(repeat).cast("long").alias(repeat), value), [sentence, repeat]).groupBy("b").agg(F.avg(value).alias("mean"))


def repeat_noise(rows: DataFrame, sentence: str, repeat: str, value: str) -> DataFrame:
    """One row: spread of the repeats' means, and median and p90 of the sentences' means."""
    by_repeat = rows.groupBy(repeat).agg(F.avg(value).alias("m")).agg(F.stddev_samp("m").alias("repeat_std"), F.count("*").alias("n_repeats"))
    by_sentence = rows.groupBy(sentence).agg(F.avg(value).alias("m")).agg(F.percentile("m", F.array(F.lit(0.5), F.lit(0.9))).alias("p"), F.count("*").alias("n_sentences"))
    return by_repeat.crossJoin(by_sentence).select("repeat_std", "n_repeats", "n_sentences", F.get("p", F.lit(0)).alias("median"), F.get("p", F.lit(1)).alias("p90"))


def paired_delta(rows: DataFrame, system: str, sentence: str, value: str, base: str, b: int, least: int = 5, seed: int = 0) -> DataFrame:
    """Per system other than the base: mean difference on common sentences, its interval, and whether that leaves out 0.
    Systems with fewer than ``least`` common sentences give no row; all share the draws of their number of sentences."""
    means = rows.groupBy(system, sentence).agg(F.avg(value).alias("v"))
    a = means.where(F.col(system) == base).select(sentence, F.col("v").alias("w"))
    diff = means.where(F.col(system) != base).join(a, sentence).select(system, sentence, (F.col("v") - F.col("w")).alias("d"))
    w = Window.partitionBy(system)
    placed = materialize(diff.withColumns({"k": F.row_number().over(w.orderBy(sentence)) - 1, "n": F.count("*").over(w)}).where(F.col("n") >= least), "placed")
    boot = met_draws(draws(placed, b, seed, system), placed.select(system, "k", "d"), system, "k").groupBy(system, "b").agg(F.avg("d").alias("mean"))
    ci = boot.groupBy(system).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    point = placed.groupBy(system).agg(F.count("*").alias("n"), F.avg("d").alias("delta"))
    lo, hi = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return point.join(ci, system).select(system, "n", "delta", lo.alias("lo"), hi.alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


def _long(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(vector).alias("dim", "v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(rows: DataFrame, group: str, vector: str, how: str = "avg") -> DataFrame:
    """Mean or sum of a group's vectors, dimension by dimension, with partial sums before the shuffle."""
    agg = (F.avg if how == "avg" else F.sum)(F.col("v").cast("double")).alias("v")
    each = _long(rows, vector, group).groupBy(group, "dim").agg(agg)
    return each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("centroid"))


def leave_one_out(rows: DataFrame, id_col: str, group: str, vector: str) -> DataFrame:
    """Per row of a group of three or more: cosine to the sum of the group's other vectors."""
    total = centroids(rows, group, vector, "sum").join(rows.groupBy(group).agg(F.count("*").alias("n")), group).where("n >= 3")
    rest = F.zip_with("centroid", vector, lambda t, x: t - x)
    return rows.join(F.broadcast(total), group).select(id_col, group, cosine(rest, F.col(vector)).alias("cosine"))


def _unit_sums(rows: DataFrame, *by: str) -> DataFrame:
    """Sum ``t`` of the vectors ``u``, and their number ``k``, by group: by place first, so no task holds a group."""
    each = rows.select(*by, F.posexplode("u").alias("p", "x")).groupBy(*by, "p").agg(F.sum("x").alias("x"), F.count("*").alias("k"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("t"), F.max("k").alias("k"))


def pair_cosines(rows: DataFrame, id_col: str, voice: str, sentence: str, vector: str, block: int = 1024) -> DataFrame:
    """Mean, least and greatest cosine of pairs of one voice (different sentences, ``same``) and of one sentence (different voices, ``different``), and for
    each two voices the mean over the sentences of both (``pair``, named ``a|b``; no extremes).

    Means come from sums of unit vectors; extremes from products of blocks of ``block`` rows, of which only the least and the greatest leave a
    task. No row stands for a pair. Null and zero vectors take no part.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    unit = F.transform(vector, lambda x: x.cast("double") / F.col("_n"))
    u = materialize(rows.withColumn("_n", norm).where("_n > 0").select(F.col(id_col).alias("id"), F.col(voice).alias("v"), F.col(sentence).alias("s"), unit.alias("u")), "units")
    cell = materialize(_unit_sums(u, "v", "s"), "cells")

    @F.pandas_udf("struct<lo:double,hi:double>")
    def extremes(x: pd.Series, y: pd.Series, kx: pd.Series, ky: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, p, q in zip(x, y, kx, ky, strict=True):
            c = np.stack(a) @ np.stack(b).T
            c = c[np.asarray(p, dtype=object)[:, None] != np.asarray(q, dtype=object)[None, :]]
            out.append((c.min(), c.max()) if c.size else (None, None))
        return pd.DataFrame(out, columns=["lo", "hi"], dtype=float)

    out = None
    for kind, by, other in (("same", "v", "s"), ("different", "s", "v")):
        total = cell.select(by, F.posexplode("t").alias("p", "x"), "k").groupBy(by, "p").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("nn"))
        sums = total.groupBy(by).agg(F.sum(F.col("x") * F.col("x") - F.col("own")).alias("c"), F.max(F.col("n") * F.col("n") - F.col("nn")).alias("n"))
        means = sums.agg((F.sum("n") / 2).cast("long").alias("n"), (F.sum("c") / F.sum("n")).alias("mean"))
        parts = u.groupBy(by).agg(F.ceil(F.count("*") / block).alias("parts"))
        dealt = u.join(parts, by).withColumn("b", F.pmod(F.xxhash64("id"), "parts"))
        blocks = materialize(dealt.groupBy(by, "b").agg(F.collect_list("u").alias("us"), F.collect_list(other).alias("ks")), "blocks")
        met = blocks.alias("a").join(blocks.alias("c"), (F.col(f"a.{by}") == F.col(f"c.{by}")) & (F.col("a.b") <= F.col("c.b")))
        ends = met.select(extremes("a.us", "c.us", "a.ks", "c.ks").alias("e")).agg(F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi"))
        line = means.crossJoin(ends).select(F.lit(kind).alias("kind"), F.lit("all").alias("pair"), "n", "mean", "lo", "hi")  # one row each
        out = line if out is None else out.union(line)
    a, b = cell.alias("a"), cell.alias("b")
    two = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.v") < F.col("b.v"))).select(F.concat_ws("|", "a.v", "b.v").alias("pair"), dot(F.col("a.t"), F.col("b.t")).alias("c"), (F.col("a.k") * F.col("b.k")).alias("n"))
    none = F.lit(None).cast("double")
    return out.union(two.groupBy("pair").agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("mean")).select(F.lit("pair"), "pair", "n", "mean", none, none))


def rank_by_value(rows: DataFrame, order: list[Column]) -> Column:
    return F.row_number().over(Window.orderBy(*order))


def grid_rank(rows: DataFrame, error: str, score: str, order: str) -> DataFrame:
    """Settings of a grid (few rows) with the sum of their ranks by error and by score (missing is 0), best first."""
    e = rank_by_value(rows, [F.col(error), F.col(order)])
    s = rank_by_value(rows, [F.coalesce(score, F.lit(0.0)).desc(), F.col(order)])
    return rows.withColumns({"rank_sum": e + s}).withColumn("place", rank_by_value(rows, [F.col("rank_sum"), F.col(error), F.col(order)]))


def change_gate(cases: DataFrame, rtf_old: float, rtf_new: float, target: str, gain: float = 0.05, critical: float = 0.05, category_drop: float = 0.01, rtf_rise: float = 0.1, rtf_delta: float = 0.02) -> DataFrame:
    """One row: whether a change may be accepted, why not, and the worst drop of a category's mean.

    ``cases``: case_id, category, priority, old_total, new_total (null if not run again), old_pron, new_pron. Category means go
    over cases with an old total; those not run again keep it.
    """
    now = F.coalesce("new_total", "old_total")
    touched = F.max(F.col("new_total").isNotNull()).alias("touched")
    drops = cases.where("old_total is not null").groupBy("category").agg((F.avg("old_total") - F.avg(now)).alias("drop"), touched).where("touched")
    worst = drops.agg(F.coalesce(F.greatest(F.lit(0.0), F.max("drop")), F.lit(0.0)).alias("worst"), F.count_if(F.col("drop") > category_drop).alias("n_cats"))
    one = cases.agg(
        F.max(F.when(F.col("case_id") == target, F.col("new_total") - F.col("old_total"))).alias("gain"),
        F.count_if((F.col("priority") == 1) & (F.col("old_pron") - F.col("new_pron") > critical)).alias("n_critical"))
    slow = (rtf_new - rtf_old) / rtf_old > rtf_rise and rtf_new - rtf_old > rtf_delta
    from vocalith.operators.gates import reasons

    why = reasons({"target": F.coalesce("gain", F.lit(0.0)) < gain, "critical": F.col("n_critical") > 0, "category": F.col("n_cats") > 0, "rtf": F.lit(slow)})
    return one.crossJoin(worst).select((F.size(why) == 0).alias("accepted"), F.array_join(why, ";").alias("why"), "n_critical", "n_cats", "worst")


def memoised(rows: DataFrame, key: str, cache: DataFrame, value: str, compute) -> DataFrame:
    """``rows`` with ``value``: taken from a cache by key, else computed once for each new key."""
    fresh = compute(rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")).select(key, value)
    return rows.join(cache.select(key, value).unionByName(fresh), key)


def candidate_rank(rows: DataFrame, case: str, total: str, pron: str, change: str, disagree: str) -> DataFrame:
    """Candidates of a case, best first by rounded total, pronunciation and shorter change; the first's confidence grows with its
    margin, is cut where two measures disagree, and is a half without a rival."""
    w = Window.partitionBy(case).orderBy(F.round(total, 3).desc(), F.col(pron).desc(), F.length(change), change)
    margin = F.col(total) - F.lead(total).over(w)
    sure = F.least(F.lit(1.0), 0.5 + 5 * margin) * F.when(F.col(disagree), 0.7).otherwise(1.0)
    return rows.withColumns({"place": F.row_number().over(w), "confidence": F.coalesce(sure, F.lit(0.5))})


def previous(rows: DataFrame, group: str, at: str, id_col: str) -> DataFrame:
    """Per row the id of the latest row of its group that is strictly earlier; of equally late ones the greatest id."""
    latest = rows.groupBy(group, at).agg(F.max(id_col).alias("_id"))
    before = F.lag("_id").over(Window.partitionBy(group).orderBy(at))
    return rows.join(latest.withColumn("previous", before).drop("_id"), [group, at])
