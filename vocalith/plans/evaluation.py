"""Queries of evaluation metrics, resampling, gates and queues."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from vocalith.functions import text as T
from vocalith.operators import evaluation as V
from vocalith.plans.base import Book, table

book = Book()
#: What a recogniser can write another way: one letter as two code points, and a mark of little difference.
SPELT = [("e", "\u00e9", "e\u0301"), ("k", "\u0915\u093c", "\u0958"), ("n", "\u0929", "\u0928\u093c"), ("m", "\u092e\u0901", "\u092e\u0902")]
_OTHER = lambda t, k: "replace(" * len(SPELT) + t + "".join(f", '{x[0]}', '{x[k]}')" for x in SPELT)
_TURNS = f"(select conv_id, turn, {_OTHER('lower(text)', 1)} as t, {_OTHER('lower(text)', 2)} as o from conversations)"
_BARE = lambda t, mark: rf"regexp_replace(replace(replace(nfc_normalize(lower({t})), chr(2364), ''), chr(2305), chr(2306)), '[^\p{{L}}\p{{N}}{mark}]', '', 'g')"
_CANON = lambda t: f"lower(nfc_normalize(replace(replace(replace(replace({t}, 'ऩ', 'न'), 'क़', 'क'), '़', ''), 'ँ', 'ं')))"
_HEARD = "replace(replace(o, 'th', 't'), 'ou', case when turn % 2 = 0 then 'u' else 'ouou' end)"
_REF, _HYP = _BARE("t", r"\p{M}"), _BARE(_HEARD, r"\p{M}")


#: Turns that one task compares.
TURNS = 500


def turns(spark, d):
    """Turns of conversations with some letters spelt in other scripts, and what a recogniser might make of them."""
    t = o = F.lower("text")
    for plain, one, other in SPELT:
        t, o = F.replace(t, F.lit(plain), F.lit(one)), F.replace(o, F.lit(plain), F.lit(other))
    said = table(spark, d, "conversations")
    dealt = said.repartition(max(1, math.ceil(said.count() / TURNS)))  # one file is one task otherwise, and a turn costs up to its length squared
    rows = dealt.select("conv_id", "turn", t.alias("ref"), o.alias("spelt"))
    heard = F.replace(F.replace("spelt", F.lit("th"), F.lit("t")), F.lit("ou"), F.when(F.col("turn") % 2 == 0, "u").otherwise("ouou"))
    return rows.withColumn("hyp", heard)


def _cer_sql(formula: str, ref: str = _REF, hyp: str = _HYP) -> str:
    return f"with c as (select conv_id, turn, {ref} as r, {hyp} as h from {_TURNS}) select conv_id, turn, {formula} as cer from c"


_RATE = "case when length(r) = 0 then (case when length(h) = 0 then 0.0 else 1.0 end) else levenshtein(r, h) / length(r) end"


@book.add("cer", _cer_sql(_RATE))
def cer(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.error_rate(T.cer_clean(F.col("ref")), T.cer_clean(F.col("hyp"))).alias("cer"))


@book.add("cer_legacy", _cer_sql(_RATE, _BARE("t", ""), _BARE(_HEARD, "")))
def cer_legacy(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.error_rate(T.cer_clean_legacy(F.col("ref")), T.cer_clean_legacy(F.col("hyp"))).alias("cer"))


@book.add("cer_bounded", _cer_sql("least(1.0, levenshtein(r, h) / greatest(1, length(r)))", *(rf"regexp_replace({_CANON(t)}, '[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]+', '', 'g')" for t in ("t", _HEARD))))
def cer_bounded(spark, d):
    bare = lambda c: F.regexp_replace(T.canon(F.col(c)), " ", "")
    return turns(spark, d).select("conv_id", "turn", T.bounded_error(bare("ref"), bare("hyp")).alias("cer"))


@book.add("token_error_rate")
def token_error_rate(spark, d):
    rows = turns(spark, d).select("conv_id", "turn", T.words(F.col("ref")).alias("r"), T.words(F.col("hyp")).alias("h"))
    return rows.select("conv_id", "turn", V.token_error_rate(F.col("r"), F.col("h")).alias("wer"))


@book.add("best_reference_score")
def best_reference_score(spark, d):
    rows = turns(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array("ref", F.replace("ref", F.lit("th"), F.lit("t"))).alias("refs"), F.array("hyp", F.replace("hyp", F.lit("ouou"), F.lit("ou"))).alias("hyps"))
    return V.best_reference(rows, "id", "refs", "hyps").select("id", "err")


@book.add("text_exact", f"with c as (select conv_id, turn, {_CANON('t')} as r, {_CANON('o')} as h from {_TURNS}) select conv_id, turn, r = case when turn % 3 = 0 then replace(replace(h, 'th', 't'), 'zz', 'z') else h end as exact from c")
def text_exact(spark, d):
    heard = F.replace(F.replace("spelt", F.lit("th"), F.lit("t")), F.lit("zz"), F.lit("z"))
    rows = turns(spark, d).withColumn("got", F.when(F.col("turn") % 3 == 0, heard).otherwise(F.col("spelt")))
    return rows.select("conv_id", "turn", F.array_contains(F.array(T.canon(F.col("ref"))), T.canon(F.col("got"))).alias("exact"))


@book.add("keyword_hits", r"""with e as (select item_id, trim(regexp_replace(lower(text), '[\p{P}\p{S}\p{Z}\p{C}]+', ' ', 'g')) as t from benchmark), w as (select item_id, t, unnest(list_distinct(list_concat(string_split(t, ' ')[1:3], [string_split(t, ' ')[4] || string_split(t, ' ')[5]]))) as w from e)
 select item_id, count(*) filter (contains(' ' || t || ' ', ' ' || w || ' ')) / count(*) as share, coalesce(array_to_string(list_sort(list(w) filter (not contains(' ' || t || ' ', ' ' || w || ' ') and contains(replace(t, ' ', ''), w))), ','), '') as splits from w where length(w) > 2 group by 1""")
def keyword_hits(spark, d):
    b = table(spark, d, "benchmark").withColumn("w", F.split(T.canon(F.col("text")), " "))
    wanted = F.concat(F.slice("w", 1, 3), F.array(F.concat(F.get("w", F.lit(3)), F.get("w", F.lit(4)))))
    return V.keyword_hits(b.withColumn("wanted", wanted), "item_id", "text", "wanted").select("item_id", "share", F.array_join("splits", ",").alias("splits"))


_LI = "(select l_returnflag as category, l_quantity, l_discount, case when l_linenumber = 3 then null else l_tax end as l_tax from lineitem)"


@book.add("category_metrics", f"""with l as (select category, unnest(['l_quantity', 'l_discount', 'l_tax']) as metric, unnest([l_quantity, l_discount, l_tax]) as value from {_LI}), g as (select category, metric, value from l union all select null, metric, value from l)
 select category, metric, count(value) as n, avg(value) as mean, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.9) as p90 from g group by 1, 2""")
def category_metrics(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), "l_quantity", "l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"))
    return V.metric_table(rows, "category", ["l_quantity", "l_discount", "l_tax"])


@book.add("voice_quality", """select l_suppkey, avg(l_quantity) filter (l_returnflag = 'A') as "A", avg(l_quantity) filter (l_returnflag = 'N') as "N", avg(l_quantity) filter (l_returnflag = 'R') as "R", avg(l_quantity) as mean, max(l_discount) as max_clip, count(*) filter (l_tax = 0) as n_silent from lineitem group by 1""")
def voice_quality(spark, d):
    li = table(spark, d, "lineitem")
    wide = li.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return wide.join(li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.max("l_discount").alias("max_clip"), F.count_if(F.col("l_tax") == 0).alias("n_silent")), "l_suppkey")


@book.add("milestone_summary", "select l_linestatus, count(*) as n, avg(l_quantity) as mean, quantile_cont(l_quantity, 0.5) as median, quantile_cont(l_quantity, 0.9) as p90, max(l_quantity) as most, quantile_cont(l_quantity, 0.1) as p10, min(l_quantity) as least from lineitem group by 1")
def milestone_summary(spark, d):
    p = F.percentile("l_quantity", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.1)))
    out = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), p.alias("p"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"))
    return out.select("l_linestatus", "n", "mean", *[F.get("p", F.lit(k)).alias(x) for k, x in enumerate(("median", "p90", "p10"))], "most", "least")


def _draw(seed: int, expr: str, n: str) -> str:
    return f"(cast('0x' || substr(md5('{seed}|' || {expr}), 1, 7) as bigint) % {n})"


_BOOT = f"""with s as (select o_custkey, avg(o_totalprice) as v, row_number() over (order by o_custkey) - 1 as k, count(*) over () as n from orders group by 1), dr as (select b, {_draw(0, "b || '|' || k", 'n')} as k from s, range(100) t(b)),
 m as (select b, avg(v) as mean from dr join s using (k) group by 1)"""


@book.add("bootstrap_ci", f"{_BOOT} select quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from m")
def bootstrap_ci(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return V.interval(V.resamples(s, "v", "o_custkey", 100))


@book.add("bootstrap_poisson")
def bootstrap_poisson(spark, d):
    return V.poisson_resamples(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 50)


_REP = "(select l_suppkey as s, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as rep, l_quantity as v from lineitem)"


def repeats(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.row_number().over(w) - 1).alias("rep"), F.col("l_quantity").alias("v"))


@book.add("two_level_bootstrap", f"""with x as {_REP}, z as (select s, count(*) as r, row_number() over (order by s) - 1 as k, count(*) over () as n from x group by 1), dr as (select b, k as j, {_draw(0, "b || '|' || k", 'n')} as k from z, range(100) t(b)),
 i as (select b, z.s, {_draw(1, "b || '|' || j", 'r')} as rep from dr join z using (k)), m as (select b, avg(v) as mean from i join x using (s, rep) group by 1) select quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from m""")
def two_level_bootstrap(spark, d):
    return V.interval(V.two_level(repeats(spark, d), "s", "rep", "v", 100))


@book.add("repeat_noise", """with r as (select l_linenumber, avg(l_quantity) as m from lineitem group by 1), s as (select l_orderkey, avg(l_quantity) as m from lineitem group by 1)
 select (select stddev_samp(m) from r) as repeat_std, (select count(*) from r) as n_repeats, count(*) as n_sentences, quantile_cont(m, 0.5) as median, quantile_cont(m, 0.9) as p90 from s""")
def repeat_noise(spark, d):
    return V.repeat_noise(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@book.add("paired_delta", f"""with m as (select l_returnflag as system, l_suppkey as s, avg(l_quantity) as v from lineitem group by 1, 2), f as (select c.system, c.s, c.v - a.v as d from m c join m a on a.s = c.s and a.system = 'A' where c.system <> 'A'),
 p as (select *, row_number() over (partition by system order by s) - 1 as k, count(*) over (partition by system) as n from f), q as (select * from p where n >= 5), dr as (select system, b, {_draw(0, "b || '|' || k", 'n')} as k from q, range(100) t(b)),
 bt as (select system, b, avg(d) as mean from dr join q using (system, k) group by 1, 2), ci as (select system, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from bt group by 1)
 select system, count(*) as n, avg(d) as delta, any_value(lo) as lo, any_value(hi) as hi, any_value(lo > 0 or hi < 0) as excludes_zero from q join ci using (system) group by 1""")
def paired_delta(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_suppkey").alias("s"), "l_quantity")
    return V.paired_delta(li, "system", "s", "l_quantity", "A", 100)


@book.add("worst_k", "select l_orderkey, avg(l_discount) as err from lineitem group by 1 order by err desc, l_orderkey limit 10")
def worst_k(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("err")).orderBy(F.desc("err"), "l_orderkey").limit(10)


_CEN = "(select label, list(v order by k) as c from (select label, k, avg(v) as v from (select label, unnest(embedding)::double as v, unnest(range(len(embedding))) as k from embeddings) group by 1, 2) group by 1)"
_E = "(select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"
_COSINE = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@book.add("loo_centroid", f"""with t as (select label, list(v order by k) as t from (select label, k, sum(v) as v from (select label, unnest(embedding)::double as v, unnest(range(len(embedding))) as k from embeddings) group by 1, 2) group by 1),
 r as (select vec_id, e.label, e, list_transform(list_zip(t, e), lambda z: z[1] - z[2]) as r from {_E} e join t using (label)) select label, min({_COSINE.format(a='r', b='e')}) as lo, avg({_COSINE.format(a='r', b='e')}) as mean from r group by 1 having count(*) >= 3""")
def loo_centroid(spark, d):
    return V.leave_one_out(table(spark, d, "embeddings"), "vec_id", "label", "embedding").groupBy("label").agg(F.min("cosine").alias("lo"), F.avg("cosine").alias("mean"))


@book.add("centroid_similarity", f"select label, avg({_COSINE.format(a='e', b='c')}) as mean, min({_COSINE.format(a='e', b='c')}) as lo from {_E} e join {_CEN} c using (label) group by 1")
def centroid_similarity(spark, d):
    e = table(spark, d, "embeddings")
    c = V.centroids(e, "label", "embedding")
    return e.join(F.broadcast(c), "label").select("label", V.cosine(F.col("embedding"), F.col("centroid")).alias("s")).groupBy("label").agg(F.avg("s").alias("mean"), F.min("s").alias("lo"))


@book.add("group_centroid", f"select label, round(unnest(c), 6) as v, unnest(range(len(c))) as dim from {_CEN}")
def group_centroid(spark, d):
    return V.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("dim", "v")).select("label", F.round("v", 6).alias("v"), F.col("dim").cast("long").alias("dim"))


@book.add("same_diff_cosine", f"""with e as (select vec_id, label, vec_id // 10 as s, e from {_E}), p as (select case when a.label = b.label then 'same' else 'different' end as kind, {_COSINE.format(a='a.e', b='b.e')} as c from e a join e b on a.vec_id < b.vec_id where (a.label = b.label and a.s <> b.s) or (a.label <> b.label and a.s = b.s))
 select kind, 'all' as pair, count(*) as n, avg(c) as mean, min(c) as lo, max(c) as hi from p group by 1 union all
 select 'pair', pair, count(*), avg(c), null, null from (select least(a.label, b.label) || '|' || greatest(a.label, b.label) as pair, {_COSINE.format(a='a.e', b='b.e')} as c from e a join e b on a.s = b.s and a.label < b.label) group by 2""")
def same_diff_cosine(spark, d):
    e = table(spark, d, "embeddings").withColumn("s", F.expr("vec_id div 10"))
    return V.pair_cosines(e, "vec_id", "label", "s", "embedding")


@book.add("param_grid_rank", """with g as (select p_size, avg(p_retailprice % 97) as err, case when p_size % 5 <> 0 then avg(p_retailprice % 31) end as score from part group by 1),
 r as (select *, row_number() over (order by err, p_size) + row_number() over (order by coalesce(score, 0) desc, p_size) as rank_sum from g) select p_size, rank_sum, row_number() over (order by rank_sum, err, p_size) as place from r""")
def param_grid_rank(spark, d):
    score = F.when(F.col("p_size") % 5 != 0, F.avg(F.col("p_retailprice") % 31))
    g = table(spark, d, "part").groupBy("p_size").agg(F.avg(F.col("p_retailprice") % 97).alias("err"), score.alias("score"))
    return V.grid_rank(g, "err", "score", "p_size").select("p_size", F.col("rank_sum").cast("long").alias("rank_sum"), F.col("place").cast("long").alias("place"))


_CLS = "(select lang, case when quality = 1 and toxic = 0 then 'pass' when quality = 1 then 'known_gap' when toxic = 1 then 'unexpected_pass' else 'fail' end as cls from documents join labels using (doc_id))"


@book.add("regression_report", f"select lang, count(*) as n, count(*) filter (cls = 'pass') as n_pass, count(*) filter (cls = 'fail') as n_fail, count(*) filter (cls = 'known_gap') as n_gap, count(*) filter (cls = 'unexpected_pass') as n_unexpected, count(*) filter (cls = 'pass') / nullif(count(*) filter (cls in ('pass', 'fail')), 0) as pass_rate from {_CLS} group by rollup (lang)")
def regression_report(spark, d):
    ok, bad = F.col("quality") == 1, F.col("toxic") == 1
    cls = F.when(ok & ~bad, "pass").when(ok, "known_gap").when(bad, "unexpected_pass").otherwise("fail")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", cls.alias("cls"))
    n = lambda c: F.count_if(F.col("cls") == c)
    scored = F.nullif(F.count_if(F.col("cls").isin("pass", "fail")), F.lit(0))
    return rows.rollup("lang").agg(F.count("*").alias("n"), n("pass").alias("n_pass"), n("fail").alias("n_fail"), n("known_gap").alias("n_gap"), n("unexpected_pass").alias("n_unexpected"), (n("pass") / scored).alias("pass_rate"))


@book.add("before_after_probe", """with p as (select lang, regexp_replace(translate(lower(text), 'éèêç', 'eeec'), '[^a-z]+', '', 'g') as want, regexp_replace(translate(lower(replace(text, 'en', 'an')), 'éèêç', 'eeec'), '[^a-z]+', '', 'g') as before_, regexp_replace(translate(lower(replace(text, 'zz', 'z')), 'éèêç', 'eeec'), '[^a-z]+', '', 'g') as after_ from documents)
 select lang, count(*) as n, count(*) filter (before_ <> want) as wrong_before, count(*) filter (after_ <> want) as wrong_after from p group by rollup (lang)""")
def before_after_probe(spark, d):
    fold = lambda c: F.regexp_replace(F.translate(F.lower(c), "éèêç", "eeec"), "[^a-z]+", "")
    old, new = F.replace("text", F.lit("en"), F.lit("an")), F.replace("text", F.lit("zz"), F.lit("z"))
    rows = table(spark, d, "documents").select("lang", fold("text").alias("want"), fold(old).alias("old"), fold(new).alias("new"))
    return rows.rollup("lang").agg(F.count("*").alias("n"), F.count_if(F.col("old") != F.col("want")).alias("wrong_before"), F.count_if(F.col("new") != F.col("want")).alias("wrong_after"))


@book.add("judge_tally", "select event_type, count(*) as n, avg(k % 7) as clarity, avg(k % 5 + 1) as warmth from (select event_type, cast(props->>'$.k' as int) as k from events) where k % 7 between 1 and 5 group by 1")
def judge_tally(spark, d):
    k = F.from_json("props", "k int")["k"]
    scores = table(spark, d, "events").select("event_type", F.struct((k % 7).alias("clarity"), (k % 5 + 1).alias("warmth")).alias("s"))
    valid = scores.where("s.clarity between 1 and 5 and s.warmth between 1 and 5")
    return valid.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("s.clarity").alias("clarity"), F.avg("s.warmth").alias("warmth"))


@book.add("pairwise_wins", """with p as (select event_type, case when cast(props->>'$.k' as int) % 3 = 0 then 'tie' when (cast(props->>'$.k' as int) % 3 = 1) = (event_id % 2 = 0) then 'a' else 'b' end as w from events)
 select event_type, count(*) filter (w = 'a') as a, count(*) filter (w = 'b') as b, count(*) filter (w = 'tie') as tie from p group by 1""")
def pairwise_wins(spark, d):
    k = F.from_json("props", "k int")["k"]
    first_wins, a_first = k % 3 == 1, F.col("event_id") % 2 == 0
    rows = table(spark, d, "events").select("event_type", F.when(k % 3 == 0, "tie").when(first_wins == a_first, "a").otherwise("b").alias("w"))
    return rows.groupBy("event_type").pivot("w", ["a", "b", "tie"]).agg(F.count(F.lit(1))).fillna(0)


@book.add("style_label_counts", "select event_type as style, count(*) as n, sum(least(3, cast(props->>'$.k' as int) % 6)) as pauses from events where event_type in ('click', 'view', 'signup') and value / 100 between 0 and 1 group by 1")
def style_label_counts(spark, d):
    k = F.from_json("props", "k int")["k"] % 6
    kept = F.filter(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: i < 3)
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "signup") & (F.col("value") / 100).between(0, 1))
    return rows.groupBy(F.col("event_type").alias("style")).agg(F.count("*").alias("n"), F.sum(F.size(kept)).alias("pauses"))


_SC = "(select *, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 as id, 1 - l_discount as text_score, l_tax * 4 as cer, l_quantity / 50 as important, l_quantity / 3 as rate from lineitem)"
_PRON = "(0.3e0 * text_score + 0.4e0 * (1 - cer) + 0.3e0 * important)"
_RATE_OK = "(case when rate between 8 and 14 then 1e0 else greatest(0, 1 - least(abs(rate - 8), abs(rate - 14)) / 8) end)"


def scores(spark, d):
    return table(spark, d, "lineitem").withColumns({"id": F.expr("l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000"), "text_score": 1 - F.col("l_discount"), "cer": F.col("l_tax") * 4, "important": F.col("l_quantity") / 50, "rate": F.col("l_quantity") / 3})


@book.add("proxy_scores", f"select id, l_extendedprice, round({_PRON}, 4) as pronunciation, {_RATE_OK} as rate_ok, (0.5e0 * {_PRON} + 0.5e0 * {_RATE_OK}) / 1 as total from {_SC}".replace("round(" + _PRON + ", 4)", _PRON))
def proxy_scores(spark, d):
    rate = F.col("rate")
    pron = 0.3 * F.col("text_score") + 0.4 * (1 - F.col("cer")) + 0.3 * F.col("important")
    ok = F.when(rate.between(8, 14), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.abs(rate - 8), F.abs(rate - 14)) / 8))
    return scores(spark, d).select("id", "l_extendedprice", pron.alias("pronunciation"), ok.alias("rate_ok"), (0.5 * pron + 0.5 * ok).alias("total"))


@book.add("failure_class", f"select id, l_extendedprice, case when text_score < 0.95e0 then 'normalization' when l_partkey % 11 = 0 then 'word_boundary' when cer > 0.15e0 or important < 0.75e0 then 'pronunciation' when rate < 6 then 'audio' when l_suppkey % 3 = 0 then 'prosody' else 'ok' end as failure from {_SC}")
def failure_class(spark, d):
    c = F.col
    kind = F.when(c("text_score") < 0.95, "normalization").when(c("l_partkey") % 11 == 0, "word_boundary").when((c("cer") > 0.15) | (c("important") < 0.75), "pronunciation").when(c("rate") < 6, "audio").when(c("l_suppkey") % 3 == 0, "prosody").otherwise("ok")
    return scores(spark, d).select("id", "l_extendedprice", kind.alias("failure"))


@book.add("run_summary", "select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as gid, count(*) as n, avg(l_quantity) as mean_quantity, avg(l_discount) as mean_discount, avg(l_tax) as mean_tax from lineitem group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus))")
def run_summary(spark, d):
    li = table(spark, d, "lineitem")
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return li.groupingSets([[r], [r, s]], r, s).agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity"), F.avg("l_discount").alias("mean_discount"), F.avg("l_tax").alias("mean_tax"))


@book.add("regression_gate", """with c as (select o_orderkey as id, o_orderpriority as cat, o_orderkey % 4 as pr, o_totalprice / 1e6 as o, case when o_orderkey % 3 = 0 then o_totalprice / 1e6 + (o_custkey % 11 - 5) / 50.0e0 end as n from orders),
 g as (select cat, avg(o) - avg(coalesce(n, o)) as drop_ from c group by 1 having bool_or(n is not null)), w as (select greatest(0, max(drop_)) as worst, count(*) filter (drop_ > 0.01) as n_cats from g), k as (select count(*) filter (pr = 1 and o - n > 0.05) as n_critical, max(n - o) filter (id = 3) as gain from c),
 y as (select *, list_filter([case when coalesce(gain, 0) < 0.05 then 'target' end, case when n_critical > 0 then 'critical' end, case when n_cats > 0 then 'category' end, 'rtf'], lambda x: x is not null) as why from k, w)
 select len(why) = 0 as accepted, array_to_string(why, ';') as why, n_critical, n_cats, worst from y""")
def regression_gate(spark, d):
    k = F.col("o_orderkey")
    old = F.col("o_totalprice") / 1e6
    new = F.when(k % 3 == 0, old + (F.col("o_custkey") % 11 - 5) / 50.0)
    cases = table(spark, d, "orders").select(k.alias("case_id"), F.col("o_orderpriority").alias("category"), (k % 4).alias("priority"), old.alias("old_total"), new.alias("new_total"), old.alias("old_pron"), new.alias("new_pron"))
    return V.change_gate(cases, 0.1, 0.15, 3)


@book.add("target_queue", """with t as (select o_custkey, count(*) as tried from orders where o_orderstatus = 'F' group by 1) select o_orderkey, o_orderpriority, o_totalprice, coalesce(tried, 0) as tried from orders left join t using (o_custkey)
 where o_totalprice < 100000 and coalesce(tried, 0) < 5 and o_orderstatus <> 'P' order by o_orderpriority, o_totalprice, o_orderkey""")
def target_queue(spark, d):
    o = table(spark, d, "orders")
    tried = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("tried"))
    out = o.join(tried, "o_custkey", "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
    return out.where("o_totalprice < 100000 and tried < 5 and o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority", "o_totalprice", "tried").orderBy("o_orderpriority", "o_totalprice", "o_orderkey")


@book.add("repeat_failures", "select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1 having n > 1 order by n desc, o_custkey limit 20")
def repeat_failures(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "o_custkey").limit(20)


@book.add("recent_experiments", "select o_orderkey, o_orderstatus, o_orderdate from orders where o_orderstatus in ('F', 'O') order by o_orderdate desc, o_orderkey desc limit 50")
def recent_experiments(spark, d):
    return table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_orderstatus", "o_orderdate").limit(50)


@book.add("affected_cases", "select doc_id from documents where sha256(text || '|a') <> sha256(replace(text, 'the', 'teh') || '|a')")
def affected_cases(spark, d):
    key = lambda t: F.sha2(F.to_json(F.struct(t.alias("text"), F.lit("a").alias("config"))), 256)
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", key(F.col("text")).alias("k"))
    new = docs.select("doc_id", key(F.replace("text", F.lit("the"), F.lit("teh"))).alias("k2"))
    return old.join(new, "doc_id").where("k <> k2").select("doc_id")


@book.add("memoised_eval", "select doc_id, length(text) as value from documents")
def memoised_eval(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.md5("text").alias("key"))
    cache = docs.where("doc_id % 2 = 0").dropDuplicates(["key"]).select("key", F.length("text").cast("long").alias("value"))
    return V.memoised(docs, "key", cache, "value", lambda rows: rows.withColumn("value", F.length("text").cast("long"))).select("doc_id", "value")


@book.add("candidate_rank", """with c as (select l_suppkey, l_partkey, max(l_quantity) / 50 as total, max(l_tax) as pron, 'c' || l_partkey as change, l_partkey % 3 = 0 as dis from lineitem group by 1, 2),
 r as (select *, row_number() over w as place, total - lead(total) over w as margin from c window w as (partition by l_suppkey order by round(total, 3) desc, pron desc, length(change), change))
 select l_suppkey, change, place, coalesce(least(1, 0.5 + 5 * margin) * case when dis then 0.7e0 else 1 end, 0.5) as confidence from r""")
def candidate_rank(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.max("l_quantity") / 50).alias("total"), F.max("l_tax").alias("pron"))
    c = c.withColumns({"change": F.concat(F.lit("c"), "l_partkey"), "dis": F.col("l_partkey") % 3 == 0})
    return V.candidate_rank(c, "l_suppkey", "total", "pron", "change", "dis").select("l_suppkey", "change", F.col("place").cast("long").alias("place"), "confidence")


@book.add("worst_cases_report", """select l_suppkey, id, l_extendedprice from (select l_suppkey, id, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, id) as r from (select *, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 as id from lineitem)) where r <= 15""")
def worst_cases_report(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "id")
    return scores(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 15").select("l_suppkey", "id", "l_extendedprice")


@book.add("previous_eval", "with l as (select o_custkey, o_orderdate, max(o_orderkey) as id from orders group by 1, 2) select o_orderkey, previous from orders join (select o_custkey, o_orderdate, lag(id) over (partition by o_custkey order by o_orderdate) as previous from l) using (o_custkey, o_orderdate)")
def previous_eval(spark, d):
    return V.previous(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "previous")


@book.add("latest_by_path", r"""with p as (select url, regexp_extract(url, '^https?://([^/]+)/', 1) as host, cast(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) as int) as step from pages where regexp_matches(url, '/(en|de|fr)/[0-9]+'))
 select right(host, 4) as tld, max_by(url, (step, case when starts_with(url, 'https') then 1 else 0 end, url)) as latest, max(step) as step from p group by 1""")
def latest_by_path(spark, d):
    p = table(spark, d, "pages").where(F.col("url").rlike("/(en|de|fr)/[0-9]+"))
    p = p.select("url", F.right(F.regexp_extract("url", "^https?://([^/]+)/", 1), F.lit(4)).alias("tld"), F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1).cast("int").alias("step"))
    best = F.max_by("url", F.struct("step", F.when(F.col("url").startswith("https"), 1).otherwise(0), "url"))
    return p.groupBy("tld").agg(best.alias("latest"), F.max("step").alias("step"))


@book.add("report_diff", "select o_orderkey, case when o_orderkey % 100 = 7 then 'X' else o_orderstatus end as s, 'new' as side from orders where o_orderkey % 100 = 7 and o_orderstatus <> 'X' union all select o_orderkey, o_orderstatus, 'old' from orders where o_orderkey % 100 = 7 and o_orderstatus <> 'X'")
def report_diff(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), "o_totalprice").drop("o_totalprice")
    new = old.withColumn("s", F.when(F.col("o_orderkey") % 100 == 7, "X").otherwise(F.col("s")))
    return new.exceptAll(old).withColumn("side", F.lit("new")).union(old.exceptAll(new).withColumn("side", F.lit("old")))
