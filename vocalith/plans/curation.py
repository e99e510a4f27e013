"""Queries of deduplication, leakage, splits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.operators import corpus as C, dedup as D, gates as G, reports as R, splits as S
from vocalith.plans.base import Book, clips, table
from vocalith.plans.gates import GATED_SQL
from vocalith.plans.scratch import drop, materialize

book = Book()
KEY_SQL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS_SQL = r"list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def keyed(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("speaker"), T.text_key(t).alias("key"), F.md5("text").alias("sha"), "n_chars", "lang")


@book.add("dedup_exact_payload", """select doc_id as id, case when row_number() over w > 1 then case when first_value(source) over w = source then 'duplicate_audio' else 'speaker_leak_audio' end end as dup from documents window w as (partition by md5(text) order by doc_id)""")
def dedup_exact_payload(spark, d):
    return D.exact_payload(keyed(spark, d), "sha", "speaker").select("id", "dup")


_LIVE = f"(select doc_id as id, source, {KEY_SQL} as key, row_number() over (partition by md5(text) order by doc_id) as p from documents qualify p = 1)"


@book.add("dedup_exact_text", f"select id, case when row_number() over (partition by source, key order by id) > 1 then 'duplicate_text' end as dup from {_LIVE}")
def dedup_exact_text(spark, d):
    live = D.exact_payload(keyed(spark, d), "sha", "speaker").where("dup is null")
    return D.exact_text(live, "speaker", "key").select("id", "dup")


@book.add("shared_text_count", f"select key, count(distinct source) as n from (select source, {KEY_SQL} as key from documents) group by 1 having n > 1")
def shared_text_count(spark, d):
    return D.shared_keys(keyed(spark, d), "key", "speaker")


@book.add("cross_speaker_text", f"select id, case when first_value(source) over (partition by key order by id) <> source then 'speaker_leak_text' end as dup from {_LIVE}")
def cross_speaker_text(spark, d):
    live = D.exact_payload(keyed(spark, d), "sha", "speaker").where("dup is null")
    return D.cross_speaker(live, "speaker", "key").select("id", "dup")


def said(spark, d):
    """Sentences of documents as clips, the speaker their source: transcripts are as short."""
    s = table(spark, d, "documents").select("doc_id", "source", F.posexplode(C.sentences(F.col("text"))).alias("pos", "text"))
    t = F.col("text")
    return s.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), F.col("source").alias("speaker"), T.text_key(t).alias("key"), F.md5("text").alias("sha"), F.length("text").alias("n_chars"))


@book.add("near_dup_text")
def near_dup_text(spark, d):
    rows = said(spark, d).withColumn("sha", F.unhex("sha"))
    once = materialize(D.exact_payload(rows, "sha", "speaker").where("dup is null").drop("dup", "sha"), "payloads", lean=True)
    live = materialize(D.exact_text(once, "speaker", "key").where("dup is null").drop("dup"), "live", once, lean=True)
    pairs = D.near_texts(live, "id", "speaker", "key", "n_chars")
    drop(live)
    return D.keep_first(pairs).where("not kept").select("id", F.lit("near_duplicate_text").alias("reason"))


def prints(spark, d):
    """Fingerprints of clips: all embeddings, and for every fifth a second take, a little off, of the same or another speaker."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("speaker"), (10 + F.col("vec_id") % 7).cast("double").alias("seconds"))
    off = F.transform("embedding", lambda x, i: x.cast("double") + (i % 3 - 1) * 0.02)
    again = e.where("vec_id % 5 = 0").select(F.col("vec_id") + 1_000_000, off, F.when(F.col("vec_id") % 2 == 0, F.col("speaker")).otherwise(F.col("speaker") + 1), F.when(F.col("vec_id") % 15 == 0, F.col("seconds") * 2).otherwise(F.col("seconds") + 0.5))
    return e.withColumn("embedding", F.col("embedding").cast("array<double>")).union(again)


_COS = """with e as (select vec_id, embedding::double[] as embedding, label as speaker, (10 + vec_id % 7)::double as seconds from embeddings union all
  select vec_id + 1000000, list_transform(embedding::double[], lambda x, i: x + ((i - 1) % 3 - 1) * 0.02), case when vec_id % 2 = 0 then label else label + 1 end, case when vec_id % 15 = 0 then (10 + vec_id % 7) * 2 else 10 + vec_id % 7 + 0.5 end from embeddings where vec_id % 5 = 0),
 m as (select i, avg(v) as m from (select unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i from e) group by 1),
 mm as (select list(m order by i) as mean from m), c as (select e.*, list_transform(list_zip(embedding, mean), lambda z: z[1] - z[2]) as c from e, mm),
 u as (select *, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-8)) as u from c)
 select a.vec_id as a, b.vec_id as b, list_dot_product(a.u, b.u) as cosine, case when a.speaker = b.speaker then 'near_duplicate_audio' else 'speaker_leak_audio' end as reason
 from u a join u b on a.vec_id < b.vec_id where abs(a.seconds - b.seconds) <= 0.1 * greatest(a.seconds, b.seconds) and list_dot_product(a.u, b.u) >= 0.97"""


@book.add("near_dup_vector", f"select a, b, round(cosine, 6) as cosine, reason from ({_COS})")
def near_dup_vector(spark, d):
    return D.near_vectors(prints(spark, d), "vec_id", "embedding", 0.97, "seconds", 0.1, "speaker").select("a", "b", F.round("cosine", 6).alias("cosine"), "reason")


@book.add("greedy_keep_first")
def greedy_keep_first(spark, d):
    return D.keep_first(D.near_vectors(prints(spark, d), "vec_id", "embedding", 0.97, "seconds"))


@book.add("condition_outlier", """with l as (select l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 as id, l_returnflag, unnest(['l_extendedprice', 'l_quantity', 'l_tax']) as feature, unnest([l_extendedprice, case when l_partkey % 50 = 0 then l_quantity * 9 else l_quantity end, l_tax]) as value from lineitem),
 m as (select l_returnflag, feature, median(value) as med, count(*) as n from l group by 1, 2 having n >= 20), a as (select l.l_returnflag, l.feature, median(abs(value - med)) as mad from l join m using (l_returnflag, feature) group by 1, 2)
 select id, 'condition_outlier_' || feature as reason from l join m using (l_returnflag, feature) join a using (l_returnflag, feature) where abs((value - med) / greatest(1.4826e0 * mad, case feature when 'l_tax' then 0.001e0 else 1e0 end)) > 4""")
def condition_outlier(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000").alias("id"), "l_returnflag", "l_extendedprice", F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") * 9).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_tax")
    return D.condition_outliers(rows, ["l_returnflag"], {"l_extendedprice": 1.0, "l_quantity": 1.0, "l_tax": 0.001})


@book.add("split_overlap", f"""with s as (select {KEY_SQL} as key, md5(text) as sha, case when doc_id % 10 = 0 then 'test' else 'train' end as split from documents)
 select (select count(*) from (select key from s group by 1 having count(distinct split) > 1)) as text, (select count(*) from (select sha from s group by 1 having count(distinct split) > 1)) as audio""")
def split_overlap(spark, d):
    rows = keyed(spark, d).withColumn("split", F.when(F.col("id") % 10 == 0, "test").otherwise("train"))
    n = lambda k: D.shared_keys(rows, k, "split").agg(F.count("*").alias("text" if k == "key" else "audio"))
    return n("key").crossJoin(n("sha"))


@book.add("ngram_overlap", f"""with e as (select item_id as id, {WORDS_SQL} as w from benchmark), t as (select doc_id as line, {WORDS_SQL} as w from documents),
 x as (select e.id, min(line) as line from e join t on array_to_string(e.w, ' ') = array_to_string(t.w, ' ') group by 1), eg as (select distinct id, array_to_string(w[a:a + 4], ' ') as g from (select id, w, unnest(range(1, len(w) - 3)) as a from e)),
 tg as (select line, array_to_string(w[a:a + 4], ' ') as g from (select line, w, unnest(range(1, len(w) - 3)) as a from t)), h as (select id, min(line) as line from eg join tg using (g) group by 1)
 select id, line, 'exact' as kind from x union all select id, line, 'ngram' from h where id not in (select id from x)""")
def ngram_overlap(spark, d):
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.words(F.col("text")).alias("words"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("line"), T.words(F.col("text")).alias("words"))
    return D.overlap(e, t).select("id", "line", "kind")


@book.add("cross_eval_overlap", f"with b as (select item_id, array_to_string({WORDS_SQL}, ' ') as t from benchmark) select item_id from b where t in (select array_to_string({WORDS_SQL}, ' ') from conversations) or item_id % 2 = 0")
def cross_eval_overlap(spark, d):
    joined = lambda rows: rows.select("*", F.array_join(T.words(F.col("text")), " ").alias("t"))
    b = joined(table(spark, d, "benchmark"))
    other = joined(table(spark, d, "conversations")).select("t").union(b.where("item_id % 2 = 0").select("t"))
    return b.join(other.distinct(), "t", "left_semi").select("item_id")


@book.add("corpus_merge", r"""with n as (select *, regexp_replace(text, '[\s।.,?!]+', '', 'g') as k from (select text, doc_id, lang from documents union all select text, item_id - 100000, 'bench' from benchmark)),
 f as (select *, row_number() over (partition by k order by doc_id) as r from n where k not in (select regexp_replace(text, '[\s।.,?!]+', '', 'g') from benchmark where item_id % 2 = 0) and k <> '')
 select doc_id, lang || '-' || case when q < 1000 then lpad(q::varchar, 3, '0') else left(q::varchar, 3) end as new_id from (select *, row_number() over (partition by lang order by doc_id) as q from f where r = 1)""")
def corpus_merge(spark, d):
    norm = T.corpus_norm(F.col("text")).alias("k")
    b = table(spark, d, "benchmark")
    new = table(spark, d, "documents").select("doc_id", "lang", norm).union(b.select(F.col("item_id") - 100000, F.lit("bench"), norm)).where("k <> ''")
    return D.merge_corpus(b.where("item_id % 2 = 0").select(norm), new, "k", "doc_id", "lang").select("doc_id", "new_id")


@book.add("phrase_repeat_rate", "select count(*) as n, count(distinct (role, text)) as n_units, 1 - count(distinct (role, text)) / count(*) as rate from conversations")
def phrase_repeat_rate(spark, d):
    return D.repeat_rate(table(spark, d, "conversations"), "role", "text")


@book.add("leak_groups", f"select doc_id as id, min(doc_id) over (partition by {KEY_SQL}) as grp from documents")
def leak_groups(spark, d):
    return S.leak_groups(keyed(spark, d), "key", "sha").select("id", "grp")


@book.add("grouped_split", f"""with k as (select doc_id as id, min(doc_id) over (partition by {KEY_SQL}) as grp from documents), g as (select grp, count(*) as n, substr(sha256('1234|' || grp), 1, 12) as h from k group by 1),
 s as (select *, coalesce(sum(n) over (order by h, grp rows between unbounded preceding and 1 preceding), 0) as start, sum(n) over () as total from g), t as (select *, coalesce((select sum(n) from s where start < 0.05 * total), 0) as n_test from s)
 select id, case when start < 0.05 * total then 'test' when start - n_test < 0.05 * total then 'val' else 'train' end as split from k join t using (grp)""")
def grouped_split(spark, d):
    return S.grouped_split(S.leak_groups(keyed(spark, d).select("id", "key"), "key")).select("id", "split")


@book.add("speaker_disjoint_split", f"""with k as (select doc_id as id, source, {KEY_SQL} as key from documents), g as (select source, count(*) as n, substr(sha256('1234|' || source), 1, 12) as h from k group by 1),
 s as (select *, coalesce(sum(n) over (order by h rows between unbounded preceding and 1 preceding), 0) as start, sum(n) over () as total, lead(h) over (order by h) as nx from g), c as (select source from s where nx is not null and start < 0.05 * total)
 select id, case when source in (select source from c) then 'test' when key in (select key from k where source in (select source from c)) then 'dropped' else 'pool' end as split from k""")
def speaker_disjoint_split(spark, d):
    return S.speaker_disjoint(keyed(spark, d).select("id", "speaker", "key"), "speaker", ["key"]).select("id", "split")


@book.add("hash_split_v8")
def hash_split_v8(spark, d):
    return table(spark, d, "documents").select("doc_id", S.hash_split(F.concat_ws("|", "source", "doc_id", "text")).alias("split"))


@book.add("stratified_sample", """with q as (select lang, greatest(1, round_even(100 * count(*) / (select count(*) from documents), 0)) as quota from documents group by 1),
 r as (select doc_id, lang, source, row_number() over (partition by lang, source order by sha256('0|' || doc_id)) as r from documents), t as (select *, row_number() over (partition by lang order by r, source) as t from r)
 select doc_id, lang, source from t join q using (lang) where t <= quota""")
def stratified_sample(spark, d):
    return S.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), 100, "lang", "source", "doc_id").select("doc_id", "lang", "source")


@book.add("corpus_counts", """select 'total' as level, 'all' as name, count(*) as n from documents union all select 'category', lang, count(*) from documents group by 2
 union all select 'subcategory', lang || '/' || source, count(*) from documents group by 2 union all select 'listed', x, (select count(*) from documents where source = x) from (select unnest(['src1', 'src3', 'nowhere']) as x)""")
def corpus_counts(spark, d):
    return S.corpus_counts(table(spark, d, "documents"), "lang", "source", ["src1", "src3", "nowhere"])


def gated(spark, d):
    return G.clip_reasons(clips(spark, d))


@book.add("report_totals", f"""select count(*) as clips, count(*) filter (len(reasons) = 0) as accepted, count(*) filter (len(reasons) > 0) as rejected, sum(duration_s) / 3600 as hours, sum(duration_s) filter (len(reasons) = 0) / 3600 as accepted_hours,
 sum(duration_s) filter (len(reasons) > 0) / 3600 as rejected_hours, avg(duration_s) as mean_s, avg(duration_s) filter (len(reasons) = 0) as accepted_mean_s from {GATED_SQL}""")
def report_totals(spark, d):
    return R.totals(gated(spark, d), "duration_s", F.size("reasons") == 0)


@book.add("report_reasons", f"select reason, count(*) as clips, sum(duration_s) / 3600 as hours from (select unnest(reasons) as reason, duration_s from {GATED_SQL}) group by 1")
def report_reasons(spark, d):
    return R.by_reason(gated(spark, d), "reasons", "duration_s")


@book.add("report_by_group", f"""select coalesce(nullif(speaker, 'R'), '(none)') as grp, count(*) as clips, count(*) filter (len(reasons) = 0) as accepted, sum(duration_s) / 3600 as hours, coalesce(sum(duration_s) filter (len(reasons) = 0), 0) / 3600 as accepted_hours from {GATED_SQL} group by 1""")
def report_by_group(spark, d):
    return R.by_group(gated(spark, d).withColumn("speaker", F.nullif("speaker", F.lit("R"))), "speaker", "duration_s", F.size("reasons") == 0)


@book.add("report_grouping_sets", f"""select speaker, style, grouping_id(speaker, style) as gid, count(*) as files, count(*) filter (len(reasons) > 0) as rejected, sum(duration_s) / 3600 as hours, avg(snr_db) as mean_snr_db, avg(clip_frac) as mean_clip_frac, avg(silence_ratio) as mean_silence_ratio
 from {GATED_SQL} group by grouping sets ((), (speaker), (style))""")
def report_grouping_sets(spark, d):
    return R.grouping_sets(gated(spark, d), ["speaker", "style"], "duration_s", F.size("reasons") > 0, ["snr_db", "clip_frac", "silence_ratio"])


@book.add("report_stats", f"""with g as (select * from {GATED_SQL}), u as (select 'all' as part, duration_s from g union all select 'accepted', duration_s from g where len(reasons) = 0)
 select part, avg(duration_s) as mean, quantile_cont(duration_s, 0.05) as p05, quantile_cont(duration_s, 0.1) as p10, quantile_cont(duration_s, 0.25) as p25, quantile_cont(duration_s, 0.5) as median, quantile_cont(duration_s, 0.75) as p75, quantile_cont(duration_s, 0.9) as p90, quantile_cont(duration_s, 0.95) as p95 from u group by 1""")
def report_stats(spark, d):
    rows = gated(spark, d).select("duration_s", (F.size("reasons") == 0).alias("ok"))
    part = F.explode(F.when(F.col("ok"), F.array(F.lit("all"), F.lit("accepted"))).otherwise(F.array(F.lit("all"))))
    return R.stats(rows.select("duration_s", part.alias("part")), "duration_s", ["part"])


@book.add("report_histogram", f"select cast(cast(lo as int) as varchar) || '..' || cast(cast(lo + 2 as int) as varchar) as bin, lo, count(*) as n from (select floor(duration_s / 2) * 2 as lo from {GATED_SQL}) group by 1, 2")
def report_histogram(spark, d):
    return R.histogram(gated(spark, d), "duration_s", 2.0).withColumn("lo", F.col("lo").cast("double"))


@book.add("report_v8", f"""with g as (select id, speaker, duration_s, snr_db, silence_ratio, lufs from {GATED_SQL}) select speaker, stat, count(value) as n, avg(value) as mean, min(value) as lo, max(value) as hi
 from (select speaker, unnest(['duration_s', 'snr_db', 'silence_ratio', 'lufs']) as stat, unnest([duration_s, snr_db, silence_ratio, lufs]) as value from g) group by 1, 2""")
def report_v8(spark, d):
    return R.stat_table(gated(spark, d), ["duration_s", "snr_db", "silence_ratio", "lufs"], ["speaker"])


@book.add("hours_crosstab", f"select speaker, coalesce(sum(duration_s) filter (style = 'O'), 0) / 3600 as \"O\", coalesce(sum(duration_s) filter (style = 'F'), 0) / 3600 as \"F\" from {GATED_SQL} group by 1")
def hours_crosstab(spark, d):
    return R.crosstab(gated(spark, d), "speaker", "style", ["O", "F"], "duration_s")


@book.add("rejects_listing", f"select id, speaker, array_to_string(reasons, ', ') as reasons from {GATED_SQL} where len(reasons) > 0")
def rejects_listing(spark, d):
    return gated(spark, d).where("size(reasons) > 0").select("id", "speaker", F.array_join("reasons", ", ").alias("reasons"))
