"""Queries of listening tests; a user is a listener, an event a rating."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.operators import listening as L
from vocalith.plans.base import Book, table

book = Book()
_K = "cast(props->>'$.k' as int)"
_SYS = "case event_type when 'error' then 'anchor' else event_type end"
_RATINGS = f"(select user_id as listener, event_id % 40 as item, {_SYS} as system, unnest(['clarity', 'warmth']) as dim, unnest([{_K} % 5 + 1, ({_K} // 5) % 5 + 1]) as value from events)"
_PICKS = f"""(select user_id as listener, event_id % 40 as item, case when event_id % 8 = 0 then event_id % 40 end as repeat_of, 's' || least(event_id % 3, 3) as a, 's' || (event_id % 3 + 1) as b, dim, pick,
 case pick when 'A' then 's' || (event_id % 3) when 'B' then 's' || (event_id % 3 + 1) else 'tie' end as winner from (select *, unnest(['clarity', 'warmth']) as dim, unnest([(['A', 'B', 'tie', ''])[{_K} % 4 + 1], (['A', 'B', 'tie', ''])[({_K} // 4) % 4 + 1]]) as pick from events) where pick <> '')"""


def k():
    return F.from_json("props", "k int")["k"]


def ratings(spark, d):
    e = table(spark, d, "events").withColumn("k", k())
    system = F.when(F.col("event_type") == "error", "anchor").otherwise(F.col("event_type"))
    wide = e.select(F.col("user_id").alias("listener"), (F.col("event_id") % 40).alias("item"), system.alias("system"), (F.col("k") % 5 + 1).alias("clarity"), (F.expr("k div 5") % 5 + 1).cast("int").alias("warmth"))
    return wide.unpivot(["listener", "item", "system"], ["clarity", "warmth"], "dim", "value")


def picks(spark, d):
    e = table(spark, d, "events").withColumn("k", k())
    cell = lambda n: F.get(F.array(*[F.lit(x) for x in ("A", "B", "tie", "")]), n.cast("int"))
    scores = e.select(F.col("user_id").alias("listener"), F.col("event_id").alias("id"), cell(F.col("k") % 4).alias("clarity"), cell(F.expr("k div 4") % 4).alias("warmth"))
    m = F.col("event_id") % 3
    key = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 40).alias("item"), F.when(F.col("event_id") % 8 == 0, F.col("event_id") % 40).alias("repeat_of"), F.concat(F.lit("s"), m).alias("a"), F.concat(F.lit("s"), m + 1).alias("b"))
    long = scores.unpivot(["listener", "id"], ["clarity", "warmth"], "dim", "pick").where("pick <> ''").join(key, "id")
    return long.withColumn("winner", F.when(F.col("pick") == "A", F.col("a")).when(F.col("pick") == "B", F.col("b")).otherwise("tie"))


@book.add("ab_plan", """with p as (select doc_id as item, md5('7|' || doc_id) as h from documents order by h, item limit 30), s as (select item, substr(md5('8|' || item), 1, 1) < '8' as a_left, row_number() over (order by h, item) as r from p),
 u as (select item, a_left, null::bigint as repeat_of from s union all select item, not a_left, item from s where r <= 6) select item, a_left, repeat_of, row_number() over (order by md5('9|' || item || '|' || coalesce(repeat_of::varchar, '-')), item) as no from u""")
def ab_plan(spark, d):
    return L.ab_plan(table(spark, d, "documents"), "doc_id", 30, 6, 7).withColumn("no", F.col("no").cast("long"))


def plan(spark, d):
    return L.rating_plan(table(spark, d, "benchmark").select(F.col("item_id").alias("item")), table(spark, d, "region").select(F.col("r_name").alias("system")), 5)


@book.add("rating_plan", """select item_id as item, r_name as a, null as b, substr(sha256('5|' || item_id || '|' || r_name), 1, 8) as id from benchmark, region
 union all select item_id, x.r_name, y.r_name, substr(sha256('5|' || item_id || '|' || x.r_name || '|' || y.r_name), 1, 8) from benchmark, region x, region y where x.r_name < y.r_name""")
def rating_plan(spark, d):
    cells, pairs = plan(spark, d)
    return cells.select("item", F.col("system").alias("a"), F.lit(None).cast("string").alias("b"), "id").union(pairs.select("item", "a", "b", "id"))


@book.add("listener_sheets", "with s as (select substr(sha256('5|' || item_id || '|' || r_name), 1, 8) as id from benchmark, region), l as (select n_name as listener from nation where n_nationkey < 6) select listener, id, row_number() over (partition by listener order by md5('3|' || listener || '|' || id), id) as no from l, s")
def listener_sheets(spark, d):
    listeners = table(spark, d, "nation").where("n_nationkey < 6").select(F.col("n_name").alias("listener"))
    return L.sheets(plan(spark, d)[0], listeners, 3).select("listener", "id", F.col("no").cast("long").alias("no"))


@book.add("score_validate", f"select event_id, dim, value from (select event_id, unnest(['clarity', 'warmth']) as dim, unnest([({_K} % 8)::varchar, case when {_K} % 3 = 0 then '' else ({_K} % 6)::varchar end]) as value from events) where value not in ('', '1', '2', '3', '4', '5')")
def score_validate(spark, d):
    e = table(spark, d, "events").withColumn("k", k())
    s = e.select("event_id", (F.col("k") % 8).cast("string").alias("clarity"), F.when(F.col("k") % 3 == 0, "").otherwise((F.col("k") % 6).cast("string")).alias("warmth"))
    return L.bad_cells(s, ["event_id"], ["clarity", "warmth"], ["1", "2", "3", "4", "5"])


@book.add("ab_unblind", f"select dim, winner, count(*) as n from {_PICKS} group by 1, 2")
def ab_unblind(spark, d):
    return picks(spark, d).groupBy("dim", "winner").agg(F.count("*").alias("n"))


@book.add("sign_test", f"""with w as (select listener, dim, count(*) filter (pick = 'A') as x, count(*) filter (pick in ('A', 'B')) as n from {_PICKS} group by 1, 2)
 select listener, dim, x, n, case when n = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(x, n - x) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0e0))))) end as p from w""")
def sign_test(spark, d):
    w = picks(spark, d).groupBy("listener", "dim").agg(F.count_if(F.col("pick") == "A").alias("x"), F.count_if(F.col("pick").isin("A", "B")).alias("n"))
    return w.withColumn("p", L.sign_test(F.col("x"), F.col("n")))


@book.add("repeat_consistency", f"with p as {_PICKS}, a as (select * from p where repeat_of is null) select p.listener, count(*) as n, count(*) filter (p.winner = a.winner) as same from p join a on a.listener = p.listener and a.dim = p.dim and a.item = p.repeat_of where p.repeat_of is not null group by 1")
def repeat_consistency(spark, d):
    return L.repeat_consistency(picks(spark, d))


@book.add("rating_means", f"""with i as (select system, dim, item, sum(value) as s, count(value) as c from {_RATINGS} group by 1, 2, 3), p as (select *, row_number() over (partition by system, dim order by item) - 1 as k, count(*) over (partition by system, dim) as n from i),
 dr as (select system, dim, b, cast('0x' || substr(md5('0|' || b || '|' || k), 1, 7) as bigint) % n as k from p, range(50) t(b)), m as (select system, dim, b, sum(s) / sum(c) as m from dr join p using (system, dim, k) group by 1, 2, 3),
 ci as (select system, dim, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1, 2) select system, dim, sum(s) / sum(c) as mean, count(*) as n_items, any_value(lo) as lo, any_value(hi) as hi from i join ci using (system, dim) group by 1, 2""")
def rating_means(spark, d):
    return L.rating_means(ratings(spark, d), 50)


@book.add("rating_pair_diffs", f"with m as (select system, dim, item, avg(value) as v from {_RATINGS} group by 1, 2, 3) select x.system as a, y.system as b, x.dim, count(*) as n, avg(x.v - y.v) as diff from m x join m y on x.dim = y.dim and x.item = y.item and x.system < y.system group by 1, 2, 3 having count(*) >= 3")
def rating_pair_diffs(spark, d):
    return L.pair_diffs(ratings(spark, d))


@book.add("anchor_check", f"with m as (select listener, system, avg(value) as m from {_RATINGS} group by 1, 2), e as (select listener, max(m) filter (system = 'anchor') as anchor, min(m) filter (system <> 'anchor') as lowest from m group by 1) select *, anchor >= lowest as flagged from e")
def anchor_check(spark, d):
    return L.anchor_failures(ratings(spark, d), "anchor")


@book.add("ab_bonferroni", f"""with e as (select least(a, b) as x, greatest(a, b) as y, dim, count(*) filter (winner = least(a, b)) as x_wins, count(*) filter (winner = greatest(a, b)) as y_wins, count(*) filter (winner = 'tie') as ties from {_PICKS} group by 1, 2, 3), t as (select *, count(*) over () as n_tests, x_wins + y_wins as n from e),
 p as (select *, least(1, 2 * list_sum(list_transform(range(0, least(x_wins, y_wins) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0e0))))) as p from t)
 select x, y, dim, x_wins, y_wins, ties, n_tests, p, p < 0.05 / n_tests as significant from p""")
def ab_bonferroni(spark, d):
    return L.bonferroni(picks(spark, d))
