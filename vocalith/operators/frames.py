"""Frame tables (clip, frame number, level): activity, noise, pauses, segments, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CLIP, FRAME, DB = "clip", "frame", "db"


def activity(frames: DataFrame, floor_db: float = 10.0, rel_db: float = 30.0) -> DataFrame:
    """``frames`` with ``speech``: above both the 10 % level plus ``floor_db`` and the 95 % level minus ``rel_db`` of its clip."""
    p = F.percentile(DB, F.array(F.lit(0.10), F.lit(0.95)))
    cut = frames.groupBy(CLIP).agg(p.alias("p")).select(CLIP, F.greatest(F.get("p", F.lit(0)) + floor_db, F.get("p", F.lit(1)) - rel_db).alias("cut"))
    return frames.join(cut, CLIP).withColumn("speech", F.col(DB) > F.col("cut"))


def snr(frames: DataFrame) -> DataFrame:
    """Per clip: mean level of speech frames over that of the quietest tenth (one at least), 0 to 70; 0 without speech."""
    active = activity(frames)
    rank = F.row_number().over(Window.partitionBy(CLIP).orderBy(DB, FRAME))
    n = F.count("*").over(Window.partitionBy(CLIP))
    ranked = active.withColumns({"_r": rank, "_quiet": F.greatest(F.lit(1), F.floor(n / 10))})
    out = ranked.groupBy(CLIP).agg(F.avg(F.when(F.col("_r") <= F.col("_quiet"), F.col(DB))).alias("noise"), F.avg(F.when(F.col("speech"), F.col(DB))).alias("level"))
    return out.select(CLIP, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(70.0), F.col("level") - F.col("noise"))), F.lit(0.0)).alias("snr"))


def runs(rows: DataFrame, flag: str) -> DataFrame:
    """Islands of consecutive frames with the same flag: clip, flag, first and last frame, length."""
    w, v = Window.partitionBy(CLIP).orderBy(FRAME), Window.partitionBy(CLIP, flag).orderBy(FRAME)
    marked = rows.withColumn("_g", F.row_number().over(w) - F.row_number().over(v))
    return marked.groupBy(CLIP, flag, "_g").agg(F.min(FRAME).alias("first"), F.max(FRAME).alias("last"), F.count("*").alias("n")).drop("_g")


def longest_run(rows: DataFrame, flag: str) -> DataFrame:
    """Per clip the longest run of frames with the flag, 0 without any."""
    return runs(rows, flag).groupBy(CLIP).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias("longest"))


def pauses(rows: DataFrame, least: int, flag: str = "speech") -> DataFrame:
    """Per clip: silences between its first and last speech frame of ``least`` frames or more: number, total, longest, mean; and
    the silence before and after."""
    w = Window.partitionBy(CLIP)
    edge = rows.withColumns({"_a": F.min(F.when(F.col(flag), F.col(FRAME))).over(w), "_b": F.max(F.when(F.col(flag), F.col(FRAME))).over(w)})
    ends = edge.groupBy(CLIP).agg(F.count_if(F.col(FRAME) < F.col("_a")).alias("lead"), F.count_if(F.col(FRAME) > F.col("_b")).alias("trail"))
    inner = runs(edge.where(F.col(FRAME).between(F.col("_a"), F.col("_b"))).drop("_a", "_b"), flag).where(~F.col(flag) & (F.col("n") >= least))
    sums = inner.groupBy(CLIP).agg(F.count("*").alias("pauses"), F.sum("n").alias("total"), F.max("n").alias("longest"), F.avg("n").alias("mean"))
    return ends.join(sums, CLIP, "left").fillna(0, ["pauses", "total", "longest"]).fillna(0.0, ["mean"])


def segments(rows: DataFrame, most: int, least: int, pad: int, flag: str = "speech") -> DataFrame:
    """Speech runs of a clip merged from left to right while a piece stays within ``most`` frames; pieces under ``least`` frames go,
    the rest get ``pad`` frames on either side. The state of the fold is a clip's pieces, its input its runs, not its frames."""
    spans = runs(rows, flag).where(flag).groupBy(CLIP).agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("long").alias("a"), (F.col("last") + 1).cast("long").alias("b")))).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), x["b"].alias("b"))))
        return F.when((F.size(acc) > 0) & (x["b"] - F.try_element_at(acc, F.lit(-1))["a"] <= most), joined).otherwise(F.concat(acc, F.array(x)))

    pieces = F.aggregate("s", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), add)
    return spans.select(CLIP, F.explode(pieces).alias("p")).where(F.col("p.b") - F.col("p.a") >= least).select(CLIP, F.greatest(F.lit(0), F.col("p.a") - pad).alias("start"), (F.col("p.b") + pad).alias("end"))


def gated_level(blocks: DataFrame, absolute: float = -70.0, relative: float = 10.0, floor: float = -70.0) -> DataFrame:
    """Per clip the level of blocks above an absolute gate and above the mean of those minus a relative one; else the floor."""
    loud = lambda c: 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(c) / 10)))
    over = blocks.where(F.col(DB) > absolute)
    gate = over.groupBy(CLIP).agg((loud(DB) - relative).alias("gate"))
    level = over.join(gate, CLIP).where(F.col(DB) > F.col("gate")).groupBy(CLIP).agg(loud(DB).alias("level"))
    return blocks.select(CLIP).distinct().join(level, CLIP, "left").select(CLIP, F.coalesce("level", F.lit(floor)).alias("level"))


def level_stats(frames: DataFrame, clip_db: float) -> DataFrame:
    """Per clip: mean and spread of speech levels, peak, share of frames at the clipping level."""
    a = activity(frames)
    return a.groupBy(CLIP).agg(F.avg(F.when(F.col("speech"), F.col(DB))).alias("mean"), F.stddev_samp(F.when(F.col("speech"), F.col(DB))).alias("std"), F.max(DB).alias("peak"), F.avg(F.when(F.col(DB) >= clip_db, 1.0).otherwise(0.0)).alias("clip_frac"))


def self_similarity(frames: DataFrame, lags: tuple[int, int] = (20, 100), least: int = 150) -> DataFrame:
    """Per clip of more than ``least`` frames: the greatest mean product of its standardised envelope with itself, over lags up
    to half its length. A lag is an equality join on the moved frame number."""
    w = Window.partitionBy(CLIP)
    z = frames.withColumns({"n": F.count("*").over(w), "z": (F.col(DB) - F.avg(DB).over(w)) / F.stddev_pop(DB).over(w)}).where(F.col("n") > least)
    z = z.withColumn("i", F.row_number().over(Window.partitionBy(CLIP).orderBy(FRAME)) - 1).select(CLIP, "n", "z", "i")
    top = F.least(F.lit(lags[1]), F.floor(F.col("n") / 2).cast("int"))
    moved = z.select(CLIP, "z", "i", F.explode(F.sequence(F.lit(lags[0]), top - 1)).alias("lag")).select(CLIP, "lag", F.col("z").alias("z0"), (F.col("i") + F.col("lag")).alias("i"))
    met = moved.join(z.select(CLIP, "i", "z"), [CLIP, "i"])
    return met.groupBy(CLIP, "lag").agg(F.avg(F.col("z0") * F.col("z")).alias("r")).groupBy(CLIP).agg(F.max("r").alias("similarity"))


def jumps(frames: DataFrame, size: float) -> DataFrame:
    """Per clip the number of steps between neighbouring frames of more than ``size``."""
    step = F.abs(F.col(DB) - F.lag(DB).over(Window.partitionBy(CLIP).orderBy(FRAME)))
    return frames.withColumn("_s", step).groupBy(CLIP).agg(F.count_if(F.col("_s") > size).alias("jumps"))


def issues(checks: dict[str, Column]) -> tuple[Column, Column]:
    """Names of the checks that hold, and 1 less a quarter for each, 0 at least."""
    from vocalith.operators.gates import reasons

    named = reasons(checks)
    return named, F.greatest(F.lit(0.0), 1 - 0.25 * F.size(named))


def time_pool(frames: DataFrame, bins: int = 32) -> DataFrame:
    """Per clip and bin the mean level of its frames: bin k holds frames from int(k n / bins), one at least."""
    w = Window.partitionBy(CLIP).orderBy(FRAME)
    placed = frames.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(CLIP))})
    sizes = placed.select(CLIP, "n").distinct().select(CLIP, "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.floor(F.col("bin") * F.col("n") / bins)
    edges = sizes.select(CLIP, "bin", lo.alias("lo"), F.greatest(lo + 1, F.floor((F.col("bin") + 1) * F.col("n") / bins)).alias("hi"))
    each = edges.select(CLIP, "bin", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i"))
    return each.join(placed.select(CLIP, "i", DB), [CLIP, "i"]).groupBy(CLIP, "bin").agg(F.avg(DB).alias("level"))


def compare_conditions(rows: DataFrame, voice: str, condition: str, ok: str, vector: str, neutral: str = "neutral") -> DataFrame:
    """Per voice and condition: rows that worked and that did not, and the cosine of its mean vector to the neutral one's."""
    sums = rows.where(ok).select(voice, condition, F.posexplode(vector).alias("k", "v")).groupBy(voice, condition, "k").agg(F.avg("v").alias("v"))
    base = sums.where(F.col(condition) == neutral).select(voice, "k", F.col("v").alias("w"))
    cos = sums.join(base, [voice, "k"]).groupBy(voice, condition).agg((F.sum(F.col("v") * F.col("w")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("w") * F.col("w")))).alias("similarity"))
    counts = rows.groupBy(voice, condition).agg(F.count_if(ok).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_unsupported"))
    return counts.join(cos, [voice, condition], "left")
