"""Queries of row gates, rights and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.operators import gates as G
from vocalith.plans.base import Book, CLIP_SQL, clips, table

book = Book()

REASONS_SQL = """list_filter([case when duration_s < 1 then 'too_short' end, case when duration_s > 15 then 'too_long' end, case when rms_dbfs < -45 then 'rms_low' end,
 case when rms_dbfs > -6 then 'rms_high' end, case when lufs < -48 then 'loudness_low' end, case when lufs > -8 then 'loudness_high' end,
 case when clip_frac > 0.001e0 or clip_run >= 6 then 'clipping' end, case when snr_db < 15 then 'low_snr' end, case when silence_ratio > 0.6e0 then 'silence_ratio' end,
 case when speech_s < 0.5e0 then 'too_little_speech' end, case when n_chars = 0 then 'empty_transcript' end,
 case when n_chars > 0 and n_chars / greatest(speech_s, 1e-3) < 4 then 'speech_rate_low' end,
 case when n_chars > 0 and n_chars / greatest(speech_s, 1e-3) > 30 then 'speech_rate_high' end], lambda x: x is not null)"""
GATED_SQL = f"(select *, {REASONS_SQL} as reasons from ({CLIP_SQL}))"


@book.add("clip_reasons", f"select id, duration_s, array_to_string(reasons, ';') as reasons from {GATED_SQL}")
def clip_reasons(spark, d):
    return G.clip_reasons(clips(spark, d)).select("id", "duration_s", F.array_join("reasons", ";").alias("reasons"))


@book.add("gate_split", f"select id, round(duration_s, 2) as duration_s, array_to_string(reasons, ';') as reason from {GATED_SQL} where len(reasons) > 0")
def gate_split(spark, d):
    rejected = G.split_by_reasons(G.clip_reasons(clips(spark, d)))[1]
    return rejected.select("id", F.round("duration_s", 2).alias("duration_s"), "reason")


@book.add("asr_consistency_gate", """with p as (select conv_id, turn, lower(translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', 'ACEEEINOOUsaceeeinoou')) as t from conversations),
 c as (select conv_id, turn, regexp_replace(t, '[^a-z0-9]', '', 'g') as r, regexp_replace(replace(t, 'e', case when turn % 2 = 0 then '' else 'th th' end), '[^a-z0-9]', '', 'g') as h from p)
 select conv_id, turn, case when length(r) = 0 then (case when length(h) = 0 then 0.0 else 1.0 end) else levenshtein(r, h) / length(r) end > 0.35 as asr_mismatch from c""")
def asr_consistency_gate(spark, d):
    t = F.lower(F.translate("text", "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü", "ACEEEINOOUsaceeeinoou"))
    heard = F.replace("t", F.lit("e"), F.when(F.col("turn") % 2 == 0, "").otherwise("th th"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", F.regexp_replace("t", "[^a-z0-9]", "").alias("r"), F.regexp_replace(heard, "[^a-z0-9]", "").alias("h"))
    return rows.select("conv_id", "turn", (T.error_rate(F.col("r"), F.col("h")) > G.Thresholds().max_cer).alias("asr_mismatch"))


@book.add("ingest_reasons", """select doc_id, case when doc_id % 17 = 0 then 'unreadable' when trim(text) = '' or doc_id % 19 = 0 then 'no_transcript' end as reason, n_chars as duration from documents""")
def ingest_reasons(spark, d):
    why = F.when(F.col("doc_id") % 17 == 0, "unreadable").when((F.trim("text") == "") | (F.col("doc_id") % 19 == 0), "no_transcript")
    return table(spark, d, "documents").select("doc_id", why.alias("reason"), F.col("n_chars").alias("duration"))


@book.add("n_chars", r"select doc_id, length(regexp_replace(text, '[^\p{L}\p{N}\p{M}]', '', 'g')) as n from documents")
def n_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", T.n_chars(F.col("text")).cast("long").alias("n"))


@book.add("text_script_gate", r"""with c as (select doc_id, t, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as w, length(t) - length(regexp_replace(t, '[À-ÿ]', '', 'g')) as o
 from (select doc_id, text as t from documents)), b as (select *, trim(regexp_replace(t, '\s', '', 'g')) = '' as blank from c)
 select doc_id, array_to_string(list_filter([case when blank then 'empty_transcript' end, case when not blank and w = 0 then 'no_script' end, case when not blank and w > 0 and w / (w + o) < 0.5 then 'low_share' end,
 case when not blank and (regexp_matches(t, '\p{Nd}') or regexp_matches(t, '[^A-Za-zÀ-ÿ .,\n]')) then 'bad_normalization' end], lambda x: x is not null), ';') as reasons from b""")
def text_script_gate(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    found = G.script_reasons(F.col("t"), "A-Za-z", "À-ÿ", r"A-Za-zÀ-ÿ .,\n", ("no_script", "low_share"))
    return rows.select("doc_id", F.array_join(found, ";").alias("reasons"))


_KEY = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]', ' ', 'g'), '\s+', ' ', 'g'))"


@book.add("inline_gate_v8", f"""with c as (select doc_id, source, md5(text) as sha, {_KEY} as key, doc_id % 23 <> 0 as ok, list_filter([case when n_chars < 100 then 'too_short' end], lambda x: x is not null) as own from documents),
 r as (select *, row_number() over (partition by sha, ok order by doc_id) as a, row_number() over (partition by source, key, ok order by doc_id) as b from c)
 select doc_id, case when not ok then 'unreadable' else array_to_string(list_concat(own, list_filter([case when a > 1 then 'duplicate_audio' end, case when b > 1 then 'duplicate_text' end], lambda x: x is not null)), ';') end as reasons from r""")
def inline_gate_v8(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("sha"), T.text_key(F.col("text")).alias("key"), (F.col("doc_id") % 23 != 0).alias("ok"), G.reasons({"too_short": F.col("n_chars") < 100}).alias("own"))
    return G.inline_reasons(rows, ["doc_id"], "own", "sha", "source", "key", "ok").select("doc_id", F.array_join("all_reasons", ";").alias("reasons"))


@book.add("label_policy", "select doc_id, case when l.quality = 1 then lang end as style, case when l.quality = 1 then source end as role, case when l.quality = 1 then 0 else 2 end as n_dropped from documents left join labels l using (doc_id)")
def label_policy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.col("lang").alias("style"), F.col("source").alias("role"), F.when(F.col("quality") == 1, "human_verified").otherwise("model").alias("label_source"))
    return G.human_labels(rows, ["style", "role"]).select("doc_id", "style", "role", F.col("n_dropped").cast("long").alias("n_dropped"))


@book.add("rights_validate", """with e as (select case when s_suppkey % 10 = 0 then 'r0' else 'r' || s_suppkey end as rights_id, case when s_suppkey % 7 = 0 then '' else s_name end as source,
 case when s_suppkey % 5 = 0 then 'yes' else 'true' end as auth from supplier), t as (select *, count(*) over (partition by rights_id) as n from e)
 select rights_id, array_to_string(list_filter([case when source = '' then 'missing source' end, case when auth = 'yes' then 'speaker_authorization is no boolean' end, case when n > 1 then 'duplicate rights_id' end], lambda x: x is not null), ';') as problems
 from t where source = '' or auth = 'yes' or n > 1""")
def rights_validate(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        F.when(k % 10 == 0, "r0").otherwise(F.concat(F.lit("r"), k)).alias("rights_id"), F.when(k % 7 == 0, "").otherwise(F.col("s_name")).alias("source"), F.lit("cc").alias("licence"),
        F.array("s_name").alias("speaker_ids"), F.array(F.lit("tts_training")).alias("permitted_uses"), F.when(k % 5 == 0, "yes").otherwise("true").alias("speaker_authorization"), F.lit("false").alias("vendor_generated"),
    )
    return G.rights_problems(rows)


def rights_tables(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    covers = F.filter(F.array(F.concat(F.lit("s"), k), F.concat(F.lit("s"), (k + 1) % 25)), lambda x: x != "s13")
    entries = n.select(F.concat(F.lit("r"), k).alias("rights_id"), k.alias("pos"), covers.alias("speaker_ids"), (k % 5 != 0).alias("speaker_authorization"),
                       F.when(k % 7 == 3, F.array(F.lit("research"))).otherwise(F.array(F.lit("tts_training"))).alias("permitted_uses"), (k % 4 == 1).alias("vendor_generated"), (k % 8 == 1).alias("vendor_generation_permission"))
    s = table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey") % 26).alias("speaker_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("r"), F.col("s_nationkey") + F.col("s_suppkey") % 2 * 3)).alias("rights_id"))
    return rows, entries


@book.add("rights_check", """with e as (select 'r' || n_nationkey as rights_id, n_nationkey as pos, list_filter(['s' || n_nationkey, 's' || (n_nationkey + 1) % 25], lambda x: x <> 's13') as sp,
 case when n_nationkey % 5 = 0 then 'speaker not authorized' when n_nationkey % 7 = 3 then 'tts_training not a permitted use' when n_nationkey % 4 = 1 and n_nationkey % 8 <> 1 then 'vendor-generated audio without permission' else '' end as why from nation),
 r as (select s_suppkey as id, 's' || s_suppkey % 26 as speaker_id, case when s_suppkey % 3 = 0 then 'r' || (s_nationkey + s_suppkey % 2 * 3) end as rid from supplier),
 a as (select id, speaker_id, case when e.rights_id is null then 'no data-rights entry' when why <> '' then why when not list_contains(sp, speaker_id) then 'speaker not covered by rights entry' end as reason from r left join e on rid = e.rights_id where rid is not null),
 x as (select unnest(sp) as s, pos, why from e), v as (select s, count(distinct why) as n, min_by(why, pos) as why from x group by 1),
 b as (select id, speaker_id, case when why is null then 'no data-rights entry' when n > 1 then 'conflicting rights entries' else nullif(why, '') end as reason from r left join v on speaker_id = s where rid is null)
 select * from (select * from a union all select * from b) where reason is not null""")
def rights_check(spark, d):
    return G.rights_check(*rights_tables(spark, d))


@book.add("rights_enforce", "select s_suppkey as id from supplier where s_suppkey % 26 = 2 and s_suppkey % 3 <> 0")
def rights_enforce(spark, d):
    rows, entries = rights_tables(spark, d)
    mine = rows.where("rights_id is null and speaker_id = 's2'")
    G.rights_enforce(mine, entries)
    return mine.select("id")


@book.add("rights_upsert", """with a as (select n_nationkey as k, 'r' || n_nationkey as rights_id, ['s' || n_nationkey] as sp, ['v1'] as rv from nation where n_nationkey < 15),
 b as (select n_nationkey as k, 'r' || n_nationkey as rights_id, ['t' || n_nationkey] as sp, ['v2'] as rv from nation where n_nationkey >= 10)
 select coalesce(a.rights_id, b.rights_id) as rights_id, array_to_string(list_sort(list_concat(coalesce(a.sp, []), coalesce(b.sp, []))), ',') as speaker_ids,
 array_to_string(list_sort(list_concat(coalesce(a.rv, []), coalesce(b.rv, []))), ',') as revisions, case when b.k is not null then 14 + b.k else a.k end as pos from a full join b on a.rights_id = b.rights_id""")
def rights_upsert(spark, d):
    n = table(spark, d, "nation")
    made = lambda p, v: n.select(F.concat(F.lit("r"), "n_nationkey").alias("rights_id"), F.array(F.concat(F.lit(p), "n_nationkey")).alias("speaker_ids"), F.array(F.lit(v)).alias("revisions"), F.col("n_nationkey").alias("pos"))
    out = G.rights_upsert(made("s", "v1").where("pos < 15"), made("t", "v2").where("pos >= 10"))
    return out.select("rights_id", F.array_join("speaker_ids", ",").alias("speaker_ids"), F.array_join("revisions", ",").alias("revisions"), "pos")


@book.add("review_validate")
def review_validate(spark, d):
    k = F.col("doc_id")
    quality = F.when(k % 9 == 0, "good").when(k % 2 == 0, "approved").otherwise("review")
    line = F.concat(F.lit('{"id": "'), (k % 500).cast("string"), F.lit('", "quality": "'), quality, F.lit('", "noise": '), (k % 7).cast("string"), F.lit("}"))
    return G.review_problems(table(spark, d, "labels").select(line.alias("value")))


@book.add("review_gate", """with r as (select doc_id, case when toxic = 1 then 'rejected' when doc_id % 5 = 0 then 'review' else 'approved' end as q, 1 + doc_id % 5 as nat from labels),
 k as (select d.doc_id as id, coalesce(a.q, b.q) as q, case when a.q is not null then a.nat else b.nat end as nat from documents d left join r a on a.doc_id = d.doc_id left join r b on b.doc_id = d.doc_id // 2)
 select id, array_to_string(list_filter([case when q = 'rejected' then 'review_rejected' end, case when q = 'review' then 'review_pending' end, case when nat < 2 then 'review_low_naturalness' end], lambda x: x is not null), ';') as reasons from k""")
def review_gate(spark, d):
    quality = F.when(F.col("toxic") == 1, "rejected").when(F.col("doc_id") % 5 == 0, "review").otherwise("approved")
    reviews = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("review_id"), quality.alias("quality"), (1 + F.col("doc_id") % 5).alias("naturalness"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("array(cast(doc_id as string), cast(doc_id div 2 as string))").alias("keys"))
    return G.review_reasons(rows, "keys", reviews, {"naturalness": 2}).select("id", F.array_join("reasons", ";").alias("reasons"))


@book.add("review_unmatched", "select doc_id from labels where doc_id not in (select doc_id from documents where doc_id % 2 = 0)")
def review_unmatched(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_anti")


@book.add("consent_gate", """select c_custkey, case when c_custkey % 4 = 0 then 'consent not granted' when c_custkey % 9 = 0 then 'consent revoked' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'use not permitted' end as reason from customer""")
def consent_gate(spark, d):
    c = table(spark, d, "customer").withColumns({"granted": F.col("c_custkey") % 4 != 0, "revoked": F.col("c_custkey") % 9 == 0, "uses": F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("research"))).otherwise(F.array(F.lit("tts"), F.lit("clone")))})
    return c.select("c_custkey", G.consent_reason(F.lit("tts")).alias("reason"))


@book.add("retention_plan", """with r as (select event_id, user_id as speaker, ts, user_id % 11 = 0 as revoked, 5 + user_id % 20 as days, max(ts) over () as now from events),
 p as (select *, revoked or ts < now - to_days(days::int) as purge from r)
 select event_id, purge, case when bool_or(purge) over (partition by speaker) then not bool_and(purge) over (partition by speaker) end as clone_capable from p""")
def retention_plan(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("speaker"), F.col("ts").cast("timestamp").alias("created"), (F.col("user_id") % 11 == 0).alias("revoked"), (5 + F.col("user_id") % 20).cast("int").alias("days"))
    now = str(e.agg(F.max("created")).first()[0])
    return G.retention_plan(e, now).select("event_id", "purge", "clone_capable")


@book.add("reference_admit", """with f as (select event_id, user_id, ts, row_number() over (partition by user_id, floor(value) order by ts, event_id) = 1 as first from events)
 select event_id, first and row_number() over (partition by user_id, first order by ts, event_id) <= 10 as admitted from f""")
def reference_admit(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("speaker"), F.floor("value").alias("hash"), F.col("ts").alias("at"))
    return G.admit_references(e).select(F.col("id").alias("event_id"), "admitted")


@book.add("reference_screen", f"""with c as (select id, duration_s, rms_dbfs, clip_frac, 1 - silence_ratio as sr, case when id % 5 = 0 then 8000 else 22050 end as rate from ({CLIP_SQL})),
 w as (select *, case when duration_s < 3 then 'too short' when duration_s > 30 then 'too long' when rate < 16000 then 'sample rate' when clip_frac > 0.01 then 'clipped' when rms_dbfs < -45 then 'too quiet' when sr < 0.3e0 then 'mostly silence' end as reject from c)
 select id, reject, case when reject is null then (case when duration_s between 5 and 12 then 1e0 else greatest(0.3e0, least(duration_s / 5, 12 / duration_s)) end) * greatest(0.2e0, least(1e0, (rms_dbfs + 40) / 20)) * (0.5 + 0.5 * sr) * (1 - clip_frac * 20) end as quality from w""")
def reference_screen(spark, d):
    rows = clips(spark, d).withColumns({"speech_ratio": 1 - F.col("silence_ratio"), "sample_rate": F.when(F.col("id") % 5 == 0, 8000).otherwise(22050)})
    return G.screen_reference(rows).select("id", "reject", "quality")


@book.add("best_reference", "select l_orderkey, max_by(l_partkey, (l_quantity, l_extendedprice, l_partkey)) as best from lineitem group by 1")
def best_reference(spark, d):
    return G.best_reference(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@book.add("constraint_check", """with p as (select p_partkey, p_name, p_size, p_type, p_brand from part),
 n as (select p_partkey, unnest(list_distinct([p_name, p_brand || (p_partkey % 40)])) as v from p), t as (select p_partkey, count(*) over (partition by v) as n from n)
 select p_partkey, unnest(list_filter([case when p_size >= 45 then 'size needs evidence' end, case when not regexp_matches(p_brand, '^Brand#[1-4]') then 'brand id' end, case when p_type = 'PROMO' then 'type set' end], lambda x: x is not null)) as violation from p
 union all select distinct p_partkey, 'names and aliases are unique' from t where n > 1""")
def constraint_check(spark, d):
    p = table(spark, d, "part").withColumn("aliases", F.array(F.concat("p_brand", (F.col("p_partkey") % 40).cast("string"))))
    checks = {"size needs evidence": F.col("p_size") < 45, "brand id": F.col("p_brand").rlike("^Brand#[1-4]"), "type set": F.col("p_type") != "PROMO"}
    return G.constraints(p, checks, {"names and aliases are unique": ["p_name", "aliases"]}, "p_partkey")


@book.add("alias_resolve", """with e as (select p_partkey as k, 'v' || p_partkey as id, case when p_size > 40 then 'planned' else 'live' end as status, 'w' || p_partkey // 2 as alias from part where p_partkey % 3 <> 0),
 q as (select p_partkey, case when p_partkey % 2 = 0 then 'v' else 'w' end || p_partkey as voice from part), a as (select alias, min(id) as id from e where status <> 'planned' group by 1)
 select p_partkey, voice, coalesce(e.id, a.id) as resolved from q left join e on e.id = voice left join a on a.alias = voice""")
def alias_resolve(spark, d):
    p = table(spark, d, "part")
    e = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("v"), "p_partkey").alias("id"), F.when(F.col("p_size") > 40, "planned").otherwise("live").alias("status"), F.array(F.expr("'w' || (p_partkey div 2)")).alias("aliases"))
    q = p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "v").otherwise("w"), "p_partkey").alias("voice"))
    return G.resolve_alias(q, e).select("p_partkey", "voice", "resolved")


@book.add("capability_route", """with e as (select s_suppkey, 'e' || s_suppkey as engine, s_nationkey % 3 as tier, ['c' || s_suppkey % 4, 'c' || s_suppkey % 5, 'c' || s_suppkey % 7] as offered from supplier where s_suppkey <= 12),
 r as (select o_orderkey, list_sort(list_distinct(['c' || o_custkey % 5, 'c' || o_orderkey % 8])) as controls from orders), w as (select distinct controls from r),
 p as (select controls, engine, tier, list_filter(controls, lambda x: not list_contains(offered, x)) as lack from w, e),
 b as (select controls, min(case when len(lack) = 0 then (tier, engine) end) as able, min((tier, engine)) as whatever, array_to_string(list_sort(list_distinct(flatten(list(lack)))), ',') as missing from p group by 1)
 select o_orderkey, case when able is null then whatever[2] else able[2] end as engine, able is null as degraded, case when able is null then missing end as missing from r join b using (controls)""")
def capability_route(spark, d):
    k = F.col("s_suppkey")
    c = lambda n: F.concat(F.lit("c"), k % n)
    engines = table(spark, d, "supplier").where(k <= 12).select(F.concat(F.lit("e"), k).alias("engine"), (F.col("s_nationkey") % 3).alias("tier"), F.array(c(4), c(5), c(7)).alias("controls"))
    requests = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("c"), F.col("o_custkey") % 5), F.concat(F.lit("c"), F.col("o_orderkey") % 8)).alias("controls"))
    return G.route(requests, engines).drop("controls")
