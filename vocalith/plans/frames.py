"""Queries of frame tables; a user's events in the order of time are a clip's frames."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from vocalith.operators import frames as O
from vocalith.plans.base import Book, table

book = Book()
FRAMES_SQL = "(select user_id as clip, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value - 100 as db from events)"
ACTIVE_SQL = f"(select f.*, db > greatest(quantile_cont(db, 0.1) over w + 10, quantile_cont(db, 0.95) over w - 30) as speech from {FRAMES_SQL} f window w as (partition by clip))"
RUNS_SQL = f"(select clip, speech, min(frame) as first, max(frame) as last, count(*) as n from (select *, row_number() over (partition by clip order by frame) - row_number() over (partition by clip, speech order by frame) as g from {ACTIVE_SQL}) group by clip, speech, g)"


def frames(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("clip"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame"), (F.col("value") - 100).alias("db"))


@book.add("frame_vad", f"select clip, avg(case when speech then 1.0 else 0.0 end) as speech_ratio, count(*) filter (speech) * 0.01 as speech_s from {ACTIVE_SQL} group by 1")
def frame_vad(spark, d):
    return O.activity(frames(spark, d)).groupBy("clip").agg(F.avg(F.when(F.col("speech"), 1.0).otherwise(0.0)).alias("speech_ratio"), (F.count_if("speech") * 0.01).alias("speech_s"))


@book.add("frame_snr", f"""with r as (select *, row_number() over (partition by clip order by db, frame) as r, count(*) over (partition by clip) as n from {ACTIVE_SQL})
 select clip, coalesce(greatest(0, least(70, avg(db) filter (speech) - avg(db) filter (r <= greatest(1, n // 10)))), 0) as snr from r group by 1""")
def frame_snr(spark, d):
    return O.snr(frames(spark, d))


@book.add("longest_run", f"select clip, coalesce(max(n) filter (speech), 0) as longest from {RUNS_SQL} group by 1")
def longest_run(spark, d):
    return O.longest_run(O.activity(frames(spark, d)), "speech")


@book.add("pause_runs", f"""with a as {ACTIVE_SQL}, e as (select *, min(frame) filter (speech) over (partition by clip) as a, max(frame) filter (speech) over (partition by clip) as b from a),
 r as (select clip, n from {RUNS_SQL} r join (select distinct clip, a, b from e) using (clip) where not speech and n >= 3 and first > a and last < b), s as (select clip, count(*) as pauses, sum(n) as total, max(n) as longest, avg(n) as mean from r group by 1)
 select clip, count(*) filter (frame < a) as lead, count(*) filter (frame > b) as trail, coalesce(any_value(s.pauses), 0) as pauses, coalesce(any_value(s.total), 0)::bigint as total, coalesce(any_value(s.longest), 0) as longest, coalesce(any_value(s.mean), 0) as mean from e left join s using (clip) group by 1""")
def pause_runs(spark, d):
    return O.pauses(O.activity(frames(spark, d)), 3)


@book.add("speech_segments")
def speech_segments(spark, d):
    return O.segments(O.activity(frames(spark, d)), 30, 2, 1)


@book.add("gated_level", f"""with o as (select * from {FRAMES_SQL} where db > -70), g as (select clip, 10 * log10(avg(pow(10, db / 10))) - 10 as gate from o group by 1), l as (select clip, 10 * log10(avg(pow(10, db / 10))) as level from o join g using (clip) where db > gate group by 1)
 select distinct clip, coalesce(level, -70) as level from {FRAMES_SQL} left join l using (clip)""")
def gated_level(spark, d):
    return O.gated_level(frames(spark, d))


@book.add("level_stats", f"select clip, avg(db) filter (speech) as mean, stddev_samp(db) filter (speech) as std, max(db) as peak, avg(case when db >= -5 then 1.0 else 0.0 end) as clip_frac from {ACTIVE_SQL} group by 1")
def level_stats(spark, d):
    return O.level_stats(frames(spark, d), -5.0)


@book.add("self_similarity", f"""with z as (select clip, frame as i, count(*) over w as n, (db - avg(db) over w) / stddev_pop(db) over w as z from {FRAMES_SQL} window w as (partition by clip)),
 m as (select a.clip, b.i - a.i as lag, avg(a.z * b.z) as r from z a join z b on a.clip = b.clip and b.i - a.i >= 3 and b.i - a.i < least(20, a.n // 2) where a.n > 30 group by 1, 2) select clip, max(r) as similarity from m group by 1""")
def self_similarity(spark, d):
    return O.self_similarity(frames(spark, d), (3, 20), 30)


@book.add("discontinuities", f"select clip, count(*) filter (abs(db - p) > 50) as jumps from (select clip, db, lag(db) over (partition by clip order by frame) as p from {FRAMES_SQL}) group by 1")
def discontinuities(spark, d):
    return O.jumps(frames(spark, d), 50.0)


@book.add("signal_issues", f"""with s as (select clip, avg(case when speech then 1.0 else 0.0 end) as r, max(db) as peak, avg(db) as m, count(*) as n from {ACTIVE_SQL} group by 1),
 i as (select clip, list_filter([case when peak > -1 then 'clipping' end, case when r < 0.3 then 'abnormal_silence' end, case when m < -60 then 'too_quiet' end, case when n < 50 then 'short' end], lambda x: x is not null) as i from s)
 select clip, array_to_string(i, ';') as issues, greatest(0.0, 1 - 0.25 * len(i)) as quality from i""")
def signal_issues(spark, d):
    s = O.activity(frames(spark, d)).groupBy("clip").agg(F.avg(F.when(F.col("speech"), 1.0).otherwise(0.0)).alias("r"), F.max("db").alias("peak"), F.avg("db").alias("m"), F.count("*").alias("n"))
    named, quality = O.issues({"clipping": F.col("peak") > -1, "abnormal_silence": F.col("r") < 0.3, "too_quiet": F.col("m") < -60, "short": F.col("n") < 50})
    return s.select("clip", F.array_join(named, ";").alias("issues"), quality.alias("quality"))


@book.add("time_pool", f"""with f as (select *, count(*) over (partition by clip) as n from {FRAMES_SQL}), b as (select distinct clip, n, unnest(range(32)) as bin from f),
 e as (select clip, bin, bin * n // 32 as lo, greatest(bin * n // 32 + 1, (bin + 1) * n // 32) as hi from b) select e.clip, bin, avg(db) as level from e join f on e.clip = f.clip and frame >= lo and frame < hi group by 1, 2""")
def time_pool(spark, d):
    return O.time_pool(frames(spark, d))


@book.add("condition_compare", """with e as (select label as voice, case vec_id % 3 when 0 then 'neutral' when 1 then 'happy' else 'sad' end as cond, vec_id % 7 <> 0 as ok, embedding from embeddings),
 s as (select voice, cond, k, avg(v) as v from (select voice, cond, unnest(embedding)::double as v, unnest(range(len(embedding))) as k from e where ok) group by 1, 2, 3),
 c as (select s.voice, s.cond, sum(s.v * b.v) / sqrt(sum(s.v * s.v) * sum(b.v * b.v)) as similarity from s join s b on b.voice = s.voice and b.k = s.k and b.cond = 'neutral' group by 1, 2)
 select voice, cond, count(*) filter (ok) as n_ok, count(*) filter (not ok) as n_unsupported, any_value(similarity) as similarity from e left join c using (voice, cond) group by 1, 2""")
def condition_compare(spark, d):
    e = table(spark, d, "embeddings")
    cond = F.when(F.col("vec_id") % 3 == 0, "neutral").when(F.col("vec_id") % 3 == 1, "happy").otherwise("sad")
    rows = e.select(F.col("label").alias("voice"), cond.alias("cond"), (F.col("vec_id") % 7 != 0).alias("ok"), F.col("embedding").cast("array<double>").alias("v"))
    return O.compare_conditions(rows, "voice", "cond", "ok", "v")
