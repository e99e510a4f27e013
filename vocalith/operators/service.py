"""Service logs: latency, playback, capacity, cancellation, admission and rate limits."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.operators.ranges import ranged, running
from vocalith.plans.scratch import materialize


def pct_index(rows: DataFrame, value: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """Percentiles by position: the sorted value number min(n - 1, int(q n)), from 0. Ranks come from counts by value, so no
    task sorts a group's rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value))
    n = F.sum("_c").over(Window.partitionBy(*by))
    ranked = counts.withColumns({"_upto": upto, "_n": n})
    at = lambda q: F.min(F.when(F.col("_upto") >= F.least(F.col("_n"), F.floor(F.lit(q) * F.col("_n")) + 1), F.col(value)))
    return ranked.groupBy(*by).agg(*[at(q).alias(f"p{round(q * 100)}") for q in qs])


def latency_summary(rows: DataFrame, level: str, ttfa: str, rtf: str, underrun: str, audio: str, error: str) -> DataFrame:
    """Per level: requests, errors, percentiles by position of latency and real-time factor, underruns and audio."""
    ok = rows.where(~F.col(error))
    a = pct_index(ok, ttfa, [0.5, 0.95, 0.99], [level]).select(level, *[F.col(p).alias(f"ttfa_{p}") for p in ("p50", "p95", "p99")])
    b = pct_index(ok, rtf, [0.5, 0.95], [level]).select(level, *[F.col(p).alias(f"rtf_{p}") for p in ("p50", "p95")])
    good = F.when(~F.col(error), F.col(underrun))
    sums = rows.groupBy(level).agg(F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.count_if(good > 0).alias("underruns"), F.max(good).alias("underrun_max"), F.sum(F.when(~F.col(error), F.col(audio))).alias("audio"))
    return sums.join(a, level, "left").join(b, level, "left")


def underruns(frames: DataFrame, request: str, at: str, size: str, rate: float, order: list[str]) -> DataFrame:
    """Per request the sum of lateness: a frame is due when what came before it has been played, from the first arrival on."""
    w = Window.partitionBy(request).orderBy(*order)
    due = F.min(at).over(Window.partitionBy(request)) + F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / 2 / rate
    return frames.withColumn("_late", F.greatest(F.lit(0.0), F.col(at) - due)).groupBy(request).agg(F.sum("_late").alias("late"))


def playback(rows: DataFrame, stream: str, ready: str, length: str, order: list[str], gap: float = 0.05) -> DataFrame:
    """``rows`` with the time each unit ends playing and the silence before it; an ``underrun`` is a silence beyond ``gap``.

    The clock's closed form: end_k = S_k + max over j <= k of (ready_j - S_{j-1}), with S the running length.
    """
    w = Window.partitionBy(stream).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = rows.withColumn("_s", F.sum(length).over(upto)).withColumn("_m", F.max(F.col(ready) - (F.col("_s") - F.col(length))).over(upto))
    out = s.withColumn("end", F.col("_s") + F.col("_m"))
    silence = F.greatest(F.lit(0.0), F.col(ready) - F.lag("end").over(w))
    return out.withColumn("silence", F.coalesce(silence, F.lit(0.0))).withColumn("underrun", F.col("silence") > gap).drop("_s", "_m")


def seams(rows: DataFrame, stream: str, lead: str, trail: str, arrival: str, length: str, level: str, order: list[str]) -> DataFrame:
    """Per stream: silence at the seams of its chunks, greatest stall against what has been played, spread of levels."""
    w = Window.partitionBy(stream).orderBy(*order)
    played = F.min(arrival).over(Window.partitionBy(stream)) + F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = rows.withColumns({"_gap": F.lag(trail).over(w) + F.col(lead), "_stall": F.greatest(F.lit(0.0), F.col(arrival) - played)})
    return each.groupBy(stream).agg(F.max("_gap").alias("max_gap"), F.avg("_gap").alias("mean_gap"), F.coalesce(F.max("_stall"), F.lit(0.0)).alias("max_stall"), (F.max(level) - F.min(level)).alias("spread"))


def capacity(rows: DataFrame, engine: str, level: str, compute: str, e2e: str, wait: str, audio: str, failed: str, order: str) -> DataFrame:
    """Per engine and number of streams: real-time factors, waits, throughput and whether it is real time; the ladder ends at
    the first saturated rung (a failure, or a factor above 3).

    A factor is a mean of doubles that is held to bounds, so the order of its sum decides those that equal one: it is summed by ``order``, one row
    after the other, in a window that may spill, whatever the partitions.
    """
    upto = Window.partitionBy(engine, level).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rows.withColumn("_mean", F.avg(e2e).over(upto)).groupBy(engine, level).agg(
        (F.sum(compute) / F.sum(audio)).alias("compute_rtf"), F.max_by("_mean", order).alias("mean_rtf"), F.percentile(wait, F.lit(0.95)).alias("wait_p95"), F.sum(audio).alias("audio"), F.count_if(failed).alias("failures"))
    full = (F.col("failures") > 0) | (F.col("mean_rtf") > 3)
    before = F.max(full).over(Window.partitionBy(engine).orderBy(level).rowsBetween(Window.unboundedPreceding, -1))
    out = each.withColumn("_past", F.coalesce(before, F.lit(False))).where(~F.col("_past")).drop("_past")
    return out.withColumn("realtime", (F.col("mean_rtf") < 0.8) & (F.col("failures") == 0))


def drift(rows: DataFrame, by: str, at: str, value: str, seconds: float, q: float = 0.95) -> DataFrame:
    """Per group the percentile by position in its first and its last seconds (bounds excluded)."""
    ends = rows.groupBy(by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    met = rows.join(ends, by)
    first, last = met.where(F.col(at) < F.col("_a") + seconds), met.where(F.col(at) > F.col("_b") - seconds)
    p = f"p{round(q * 100)}"
    return pct_index(first, value, [q], [by]).withColumnRenamed(p, "first").join(pct_index(last, value, [q], [by]).withColumnRenamed(p, "last"), by, "full")


def cancel_latency(rows: DataFrame, conn: str, at: str, kind: str, size: str, order: list[str]) -> DataFrame:
    """Per cancel: time to the connection's next acknowledgement, and bytes that came in between. One window from the end
    carries the next acknowledgement back; running sums give the bytes, with no join."""
    w = Window.partitionBy(conn).orderBy(*order)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    upto = F.sum(F.when(F.col(kind) == "frame", F.col(size)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = rows.withColumn("_sum", upto)
    ack = F.first(F.when(F.col(kind) == "ack", F.struct(F.col(at).alias("at"), F.col("_sum").alias("sum"))), True).over(after)
    return each.withColumn("_ack", ack).where((F.col(kind) == "cancel") & F.col("_ack").isNotNull()).select(conn, F.col(at).alias("cancelled"), (F.col("_ack.at") - F.col(at)).alias("wait"), (F.col("_ack.sum") - F.col("_sum")).alias("leaked"))


def outcomes(requests: DataFrame, cancels: DataFrame) -> DataFrame:
    """``requests`` (conn, id, start, end, code) with how they ended: the first of their own end and a cancel in between, of that
    id or of all (null id). Cancels of unknown or finished requests do nothing."""
    r, c = requests.alias("r"), cancels.alias("c")
    on = (F.col("r.conn") == F.col("c.conn")) & (F.col("c.id").isNull() | (F.col("c.id") == F.col("r.id"))) & (F.col("c.at") > F.col("r.start")) & (F.col("c.at") < F.col("r.end"))
    first = r.join(c, on).groupBy("r.conn", "r.id").agg(F.min("c.at").alias("cancelled_at"))
    out = requests.join(first, ["conn", "id"], "left")
    return out.select("conn", "id", "start", F.coalesce("cancelled_at", "end").alias("end"), F.col("cancelled_at").isNotNull().alias("cancelled"), F.when(F.col("cancelled_at").isNull(), F.col("code")).alias("code"))


def active(intervals: DataFrame, by: str, start: str, end: str, rows: int = 100_000) -> DataFrame:
    """Per group the greatest number of intervals that overlap, and when it is first reached; an end frees its place first. Running sums are taken
    by ranges of about ``rows`` steps, so a group may be of any size."""
    steps = intervals.select(by, F.col(start).alias("at"), F.lit(1).alias("d")).union(intervals.select(by, end, F.lit(-1)))
    counted = running(ranged(steps, by, ["at", "d"], rows), by, ["at", "d"], {"n": F.col("d")})
    return counted.groupBy(by).agg(F.max("n").alias("peak"), F.min_by("at", F.struct(-F.col("n"), "at")).alias("first_at"))


def admission(intervals: DataFrame, by: str, start: str, end: str, id_col: str, most: int, rows: int = 100_000) -> DataFrame:
    """``intervals`` with ``admitted``: a start is refused while ``most`` admitted ones run; refused ones hold no place.

    Periods in which offered intervals overlap are independent of each other and replayed side by side, many short ones in one task. They are found
    by running maxima over ranges of about ``rows`` starts, so no task holds a whole key. A period of more than ``rows`` starts is replayed in as
    many steps; what a step hands on is the ends of those that run, ``most`` at the most, in a written table. Ids order starts of the same time. No
    rows: an empty table.
    """
    plain = intervals.select(by, F.col(id_col).alias("id"), F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b"))
    order = ["a", "id"]
    offered = running(ranged(plain, by, order, rows), by, order, {"pos": F.lit(1)}, {"busy": F.col("b")})
    fresh = F.when(F.col("a") < F.col("busy"), F.lit(None)).otherwise(F.col("pos"))
    offered = materialize(offered.withColumn("fresh", fresh), "offered")
    offered = running(offered, by, order, {}, {"period": F.col("fresh")}).withColumn("period", F.coalesce("fresh", "period"))
    known = materialize(offered.select(by, "id", "a", "b", "period", F.floor((F.col("pos") - F.col("period")) / rows).alias("step"), F.floor(F.col("period") / rows).alias("task")), "periods")
    kinds = dict(known.dtypes)

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["period", "a", "id"])
        last, run, out, held = None, [], [], []
        for period, a, b, was in zip(part["period"], part["a"], part["b"], part["run"], strict=True):
            if period != last:
                if held:
                    held[-1] = run
                last, run = period, list(was) if was is not None else []
                heapify(run)
            while run and run[0] <= a:
                heappop(run)
            out.append(len(run) < most)
            if out[-1]:
                heappush(run, b)
            held.append(None)
        held[-1] = run
        return pd.DataFrame({by: part[by].to_numpy(), "period": part["period"].to_numpy(), "id": part["id"].to_numpy(), "admitted": out, "run": held})

    found, left = None, known.select(by, "period").where("false").withColumn("run", F.expr("cast(null as array<double>)"))
    for k in range((known.agg(F.max("step")).first()[0] or 0) + 1):
        now = known.where(F.col("step") == k).join(left, [by, "period"], "left")
        done = materialize(now.groupBy(by, "task").applyInPandas(replay, f"{by} {kinds[by]}, period long, id {kinds['id']}, admitted boolean, run array<double>"), "admitted")
        left = done.where("run is not null").select(by, "period", "run")
        found = done if found is None else found.union(done)
    return found.select(by, F.col("id").alias(id_col), "admitted")


def rate_limit(hits: DataFrame, key: str, at: str, id_col: str, limit: int, window: float) -> DataFrame:
    """``hits`` with ``allowed``: at most ``limit`` allowed hits in any ``window`` seconds, both ends included; refused ones don't count.

    A pause longer than the window empties it, so each key's sessions are replayed on their own; the state is the last
    ``limit`` allowed times.
    """
    w = Window.partitionBy(key).orderBy(at, id_col)
    fresh = F.sum(F.when(F.col(at) - F.lag(at).over(w) <= window, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sessions = hits.withColumn("_s", fresh).groupBy(key, "_s").agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(id_col).alias("id")))).alias("s"))
    id_type = dict(hits.dtypes)[id_col]
    zero = F.struct(F.expr("cast(array() as array<double>)").alias("last"), F.expr(f"cast(array() as array<struct<id:{id_type},ok:boolean>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        live = F.filter(acc["last"], lambda t: x["t"] - t <= window)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.concat(live, F.array(x["t"]))).otherwise(live).alias("last"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), ok.alias("ok")))).alias("out"))

    each = sessions.select(key, F.explode(F.aggregate("s", zero, add, lambda acc: acc["out"])).alias("o"))
    return each.select(key, F.col("o.id").alias(id_col), F.col("o.ok").alias("allowed"))


def parse_log(rows: DataFrame, line: str, fields: str) -> DataFrame:
    """``rows`` with ``log`` (the named fields), ``extra`` (all fields as text) and ``corrupt`` for what is no JSON object."""
    extra = F.from_json(line, "map<string,string>")
    return rows.withColumns({"log": F.from_json(line, fields), "extra": extra, "corrupt": extra.isNull() & F.col(line).isNotNull()})


def redact(text: Column) -> Column:
    """``api_key=...`` up to an ampersand, space or quote becomes asterisks."""
    return F.regexp_replace(text, r"""(api_key=)[^& "']+""", "$1***")


def heard(segments: DataFrame, by: list[str], order: str, text: str, length: str, heard_ms: str) -> DataFrame:
    """Per reply what was heard: segments that ended in time, with an ellipsis if some are missing; null if none was heard."""
    ends = F.sum(length).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = segments.withColumn("_in", ends <= F.col(heard_ms))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_in"), F.struct(F.col(order), F.col(text).alias("t"))))), lambda x: x["t"]), " ")
    out = each.groupBy(*by).agg(F.count_if("_in").alias("n_heard"), F.count("*").alias("n"), said.alias("said"))
    return out.withColumn("heard", F.when(F.col("n_heard") == 0, None).when(F.col("n_heard") < F.col("n"), F.concat("said", F.lit("…"))).otherwise(F.col("said"))).drop("said")
