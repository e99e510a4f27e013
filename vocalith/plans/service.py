"""Queries of service logs, batch and streaming; a user is a connection, and a value is a measure."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.operators import corpus as C, service as S
from vocalith.plans.base import Book, table
from vocalith.sources import manifests as M
from vocalith.streaming import jobs as J

book = Book()
_LOG = "(select event_id, event_type as level, value as ttfa, value / 40 as rtf, case when value > 100 then value - 100 else 0 end as underrun, value / 10 as audio, event_id % 29 = 0 as err from events)"


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)


def log(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("level"), v.alias("ttfa"), (v / 40).alias("rtf"), F.when(v > 100, v - 100).otherwise(0.0).alias("underrun"), (v / 10).alias("audio"), (F.col("event_id") % 29 == 0).alias("err"))


def _pct(col: str, q: float) -> str:
    return f"(list_sort(list({col}) filter (not err)))[least(count(*) filter (not err), floor({q} * count(*) filter (not err))::bigint + 1)]"


@book.add("latency_summary", f"""select level, count(*) as requests, count(*) filter (err) as errors, {_pct('ttfa', 0.5)} as ttfa_p50, {_pct('ttfa', 0.95)} as ttfa_p95, {_pct('ttfa', 0.99)} as ttfa_p99, {_pct('rtf', 0.5)} as rtf_p50, {_pct('rtf', 0.95)} as rtf_p95,
 count(*) filter (not err and underrun > 0) as underruns, max(underrun) filter (not err) as underrun_max, sum(audio) filter (not err) as audio from {_LOG} group by 1""")
def latency_summary(spark, d):
    return S.latency_summary(log(spark, d), "level", "ttfa", "rtf", "underrun", "audio", "err")


@book.add("pct_index", "select user_id, v[least(n, floor(0.5 * n)::bigint + 1)] as p50, v[least(n, floor(0.9 * n)::bigint + 1)] as p90 from (select user_id, list_sort(list(value)) as v, count(*) as n from events group by 1)")
def pct_index(spark, d):
    return S.pct_index(table(spark, d, "events"), "value", [0.5, 0.9], ["user_id"])


@book.add("pct_linear", "select user_id, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1")
def pct_linear(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))


_T = "epoch_us(ts) / 1e6"


@book.add("underrun_ms", f"""with w as (select user_id, {_T} as t, min({_T}) over (partition by user_id) + coalesce(sum(value * 1000) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) / 2 / 10 as due from events)
 select user_id, sum(greatest(0, t - due)) as late from w group by 1""")
def underrun_ms(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", seconds().alias("t"), (F.col("value") * 1000).alias("size"))
    return S.underruns(e, "user_id", "t", "size", 10.0, ["t", "event_id"])


@book.add("playback_gaps", f"""with e as (select *, {_T} as t, value * 1000 as dur, sum(value * 1000) over w as s from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
 f as (select *, s + max(t - (s - dur)) over (partition by user_id order by ts, event_id rows unbounded preceding) as fin from e), g as (select *, coalesce(greatest(0, t - lag(fin) over (partition by user_id order by ts, event_id)), 0) as silence from f)
 select event_id, round(fin, 3) as fin, round(silence, 3) as silence, silence > 0.05 as underrun from g""")
def playback_gaps(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", seconds().alias("t"), (F.col("value") * 1000).alias("dur"))
    return S.playback(e, "user_id", "t", "dur", ["t", "event_id"]).select("event_id", F.round("end", 3).alias("fin"), F.round("silence", 3).alias("silence"), "underrun")


@book.add("seam_gaps", f"""with e as (select user_id, {_T} as t, value % 1 as lead, value % 2 as trail, value as level, value * 1000 as len, min({_T}) over (partition by user_id) as t0, sum(value * 1000) over w as before, lag(value % 2) over (partition by user_id order by ts, event_id) as pt
 from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
 select user_id, max(pt + lead) as max_gap, avg(pt + lead) as mean_gap, coalesce(max(greatest(0, t - (t0 + before))) filter (before is not null), 0) as max_stall, max(level) - min(level) as spread from e group by 1""")
def seam_gaps(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select("user_id", "event_id", seconds().alias("t"), (v % 1).alias("lead"), (v % 2).alias("trail"), (v * 1000).alias("len"), v.alias("level"))
    return S.seams(e, "user_id", "lead", "trail", "t", "len", "level", ["t", "event_id"])


_CAP = """(select engine, level, sum(compute) / sum(audio) as compute_rtf, avg(e2e) as mean_rtf, quantile_cont(wait, 0.95) as wait_p95, sum(audio) as audio, count(*) filter (failed) as failures from
 (select l_suppkey as engine, cast(l_quantity as int) as level, l_tax * 50 as compute, l_discount * 9 + l_quantity / 60 as e2e, l_extendedprice as wait, l_quantity + 1 as audio, l_partkey % 1999 = 0 as failed from lineitem) group by 1, 2)"""
_LADDER = f"(select *, mean_rtf < 0.8 and failures = 0 as realtime from (select *, coalesce(bool_or(failures > 0 or mean_rtf > 3) over (partition by engine order by level rows between unbounded preceding and 1 preceding), false) as past from {_CAP}) where not past)"


def ladder(spark, d):
    rows = M.numbered(spark, f"{d}/lineitem.parquet", "place").select("place", F.col("l_suppkey").alias("engine"), F.col("l_quantity").cast("int").alias("level"), (F.col("l_tax") * 50).alias("compute"), (F.col("l_discount") * 9 + F.col("l_quantity") / 60).alias("e2e"), F.col("l_extendedprice").alias("wait"), (F.col("l_quantity") + 1).alias("audio"), (F.col("l_partkey") % 1999 == 0).alias("failed"))
    return S.capacity(rows, "engine", "level", "compute", "e2e", "wait", "audio", "failed", "place")


@book.add("capacity_ladder", f"select engine, level, compute_rtf, mean_rtf, wait_p95, audio, failures, realtime from {_LADDER}")
def capacity_ladder(spark, d):
    return ladder(spark, d)


@book.add("max_realtime_level", f"select engine, max(level) filter (realtime) as most from {_LADDER} group by 1")
def max_realtime_level(spark, d):
    return ladder(spark, d).groupBy("engine").agg(F.max(F.when(F.col("realtime"), F.col("level"))).alias("most"))


@book.add("soak_drift", f"""with e as (select user_id, {_T} as t, value, min({_T}) over (partition by user_id) as a, max({_T}) over (partition by user_id) as b from events),
 f as (select user_id, list_sort(list(value)) as v, count(*) as n from e where t < a + 259200 group by 1), l as (select user_id, list_sort(list(value)) as v, count(*) as n from e where t > b - 259200 group by 1)
 select user_id, f.v[least(f.n, floor(0.95 * f.n)::bigint + 1)] as first, l.v[least(l.n, floor(0.95 * l.n)::bigint + 1)] as last from f full join l using (user_id)""")
def soak_drift(spark, d):
    return S.drift(table(spark, d, "events").select("user_id", seconds().alias("t"), "value"), "user_id", "t", "value", 259_200.0)


@book.add("cancel_latency", f"""with e as (select *, {_T} as t, case event_type when 'error' then 'cancel' when 'signup' then 'ack' else 'frame' end as kind from events),
 s as (select *, sum(case when kind = 'frame' then value else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s, row_number() over (partition by user_id order by ts, event_id) as r from e)
 select c.user_id, c.t as cancelled, min(a.t) - c.t as wait, min_by(a.s, a.r) - c.s as leaked from s c join s a on a.user_id = c.user_id and a.r > c.r and a.kind = 'ack' where c.kind = 'cancel' group by c.user_id, c.event_id, c.t, c.s""")
def cancel_latency(spark, d):
    kind = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "signup", "ack").otherwise("frame")
    e = table(spark, d, "events").select("user_id", "event_id", seconds().alias("t"), kind.alias("kind"), "value")
    return S.cancel_latency(e, "user_id", "t", "kind", "value", ["t", "event_id"])


@book.add("request_outcomes", f"""with r as (select user_id as conn, event_id as id, {_T} as start, {_T} + value * 3000 as fin, event_id % 10 as code from events where event_type <> 'error'),
 c as (select user_id as conn, case when event_id % 2 = 0 then event_id - 2 end as id, {_T} as tm from events where event_type = 'error'),
 f as (select r.conn, r.id, min(tm) as ca from r join c on r.conn = c.conn and (c.id is null or c.id = r.id) and tm > start and tm < fin group by 1, 2)
 select conn, id, start, coalesce(ca, fin) as fin, ca is not null as cancelled, case when ca is null then code end as code from r left join f using (conn, id)""")
def request_outcomes(spark, d):
    e = table(spark, d, "events").withColumn("t", seconds())
    r = e.where("event_type <> 'error'").select(F.col("user_id").alias("conn"), F.col("event_id").alias("id"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 3000).alias("end"), (F.col("event_id") % 10).alias("code"))
    c = e.where("event_type = 'error'").select(F.col("user_id").alias("conn"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") - 2).alias("id"), F.col("t").alias("at"))
    return S.outcomes(r, c).withColumnRenamed("end", "fin")


def spans(spark, d):
    return table(spark, d, "events").select("event_type", "event_id", seconds().alias("a"), (seconds() + F.col("value") * 600).alias("b"))


@book.add("concurrent_streams", f"""with s as (select event_type, {_T} as tm, 1 as d from events union all select event_type, {_T} + value * 600, -1 from events),
 n as (select event_type, tm, sum(d) over (partition by event_type order by tm, d rows unbounded preceding) as n from s) select event_type, max(n)::bigint as peak, min_by(tm, (-n, tm)) as first_at from n group by 1""")
def concurrent_streams(spark, d):
    return S.active(spans(spark, d), "event_type", "a", "b")


@book.add("admission_replay")
def admission_replay(spark, d):
    return S.admission(spans(spark, d), "event_type", "a", "b", "event_id", 8)


@book.add("rate_limit_replay")
def rate_limit_replay(spark, d):
    return S.rate_limit(table(spark, d, "events").select("user_id", "event_id", seconds().alias("t")), "user_id", "t", "event_id", 3, 86_400.0)


@book.add("rate_limit_offered", f"select event_id, count(*) over (partition by user_id order by {_T} range between 86400 preceding and current row) as offered from events")
def rate_limit_offered(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86_400, 0)
    return table(spark, d, "events").select("user_id", "event_id", seconds().alias("t")).select("event_id", F.count("*").over(w).alias("offered"))


@book.add("log_parse", "select event_id, cast(props->>'$.k' as int) as k, false as corrupt from events")
def log_parse(spark, d):
    return S.parse_log(table(spark, d, "events"), "props", "k int").select("event_id", "log.k", "corrupt")


@book.add("log_redact", r"select page_id, regexp_replace(replace(url, 'page=', 'api_key='), '(api_key=)[^& ]+', '\1***', 'g') as url from pages")
def log_redact(spark, d):
    return table(spark, d, "pages").select("page_id", S.redact(F.replace("url", F.lit("page="), F.lit("api_key="))).alias("url"))


@book.add("stream_counters", "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, sum(value) as total, max(value) as most from events group by 1, 2")
def stream_counters(spark, d):
    return J.run(J.counters(J.events(spark, d)), "complete")


@book.add("stream_ttfa_quantiles", "select date_trunc('day', ts)::timestamp as start, count(*) as n, v[ceil(0.5 * count(*))::bigint] as p50, v[ceil(0.95 * count(*))::bigint] as p95, v[ceil(0.99 * count(*))::bigint] as p99 from (select ts, value, null as v from events) group by 1".replace("v[", "list_sort(list(value))["))
def stream_ttfa_quantiles(spark, d):
    return J.quantiles(J.run(J.value_counts(J.events(spark, d)), "complete"))


@book.add("stream_last_values")
def stream_last_values(spark, d):
    return J.run_latest(J.last_values(J.events(spark, d), F.col("event_type")))


@book.add("stream_turn_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
 select user_id, min(ts) as start, count(*) as n from s group by user_id, s""")
def stream_turn_sessions(spark, d):
    return J.run(J.sessions(J.events(spark, d)), "complete")


@book.add("stream_segmenter")
def stream_segmenter(spark, d):
    return J.run(J.segmenter(J.deltas(spark, d)), "append")


@book.add("stream_rate_limit")
def stream_rate_limit(spark, d):
    return J.run(J.rate_limit(J.events(spark, d), "user_id", 3, 86_400.0), "append")


_PARTS = 6


def _part():
    return F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 4), 16, 10).cast("int") % _PARTS


@book.add("late_data_policy", f"""with p as (select *, cast('0x' || substr(md5(event_id::varchar), 1, 4) as int) % {_PARTS} as batch from events), m as (select batch, max(ts) as top from p group by 1),
 w as (select batch, max(top) over (order by batch rows between unbounded preceding and 1 preceding) as until from m) select event_id, user_id, value, batch::bigint as batch, coalesce(ts < until - interval 5 day, false) as late from p join w using (batch)""")
def late_data_policy(spark, d):
    """Events in an order that has nothing to do with their times, a file a batch; the query is stopped after three and started again."""
    from vocalith.plans.scratch import new_path

    source, out, state = (new_path(spark, x) for x in ("shuffled", "late", "progress"))
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = "event_id long, ts timestamp, user_id long, value double"
    ledger = J.LateLedger(spark, out, "5 days")
    for k in range(_PARTS):
        events.where(_part() == k).select("event_id", "ts", "user_id", "value").coalesce(1).write.mode("append").parquet(source)
        if k in (2, _PARTS - 1):
            J.run_late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ledger, state)
    return ledger.rows(f"{schema}, late boolean, batch long").select("event_id", "user_id", "value", "batch", "late")


_SEG = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@book.add("heard_truncation", rf"""with s as (select conv_id, turn, unnest({_SEG}) as s, unnest(range(len({_SEG}))) as pos from conversations where role = 'assistant'), e as (select *, sum(length(s) * 60) over (partition by conv_id, turn order by pos) as e from s),
 g as (select conv_id, turn, count(*) filter (e <= 10000) as n_heard, count(*) as n, string_agg(s, ' ' order by pos) filter (e <= 10000) as said from e group by 1, 2) select conv_id, turn, n_heard, n, case when n_heard = 0 then null when n_heard < n then said || '…' else said end as heard from g""")
def heard_truncation(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    s = c.select("conv_id", "turn", F.posexplode(C.sentences(F.col("text"))).alias("pos", "s")).withColumns({"ms": F.length("s") * 60, "limit": F.lit(10_000)})
    return S.heard(s, ["conv_id", "turn"], "pos", "s", "ms", "limit")
