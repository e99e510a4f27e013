"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.plans.base import Book, table
from vocalith.plans.scratch import new_path
from vocalith.sources import manifests as M

book = Book()

_MANIFEST = {
    "audio": "concat('clips/', cast(doc_id as string), '.wav')",
    "text": "case when doc_id % 11 = 0 then '   ' else concat(' ', replace(text, chr(10), ' '), ' ') end",
    "speaker_id": "case when doc_id % 13 = 0 then '' else source end",
    "language": "lang",
    "emotion": "cast(null as string)",
    "style": "case when doc_id % 3 = 0 then 'calm' else '' end",
    "label_source": "'model'",
    "rights_id": "source",
    "role": "'  '",
    "audio_sha256": "md5(text)",
    "rejected": "case when doc_id % 3 = 0 then ' YES ' when doc_id % 3 = 1 then 'no' else '1' end",
}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in columns.items()).replace("as string)", "as varchar)")


@book.add(
    "read_manifest",
    f"""with m as (select {_sql(_MANIFEST)} from documents),
    n as (select null::varchar as id, '/clips/' || audio as audio, nullif(trim(text), '') as text, nullif(trim(speaker_id), '') as speaker_id, language, emotion, nullif(trim(style), '') as style, nullif(trim(role), '') as role, label_source, rights_id,
      audio_sha256, lower(trim(rejected)) in ('1', 'true', 'yes') as rejected, null::varchar as reject_reason, null::varchar as verified_by, null::varchar as verified_at from m)
    select * replace (substr(sha1(speaker_id || '/' || audio), 1, 12) as id) from n where text is not null and speaker_id is not null""",
)
def read_manifest(spark, d):
    path = new_path(spark, "manifest")
    table(spark, d, "documents").selectExpr(*[f"{v} as {k}" for k, v in _MANIFEST.items()]).write.json(path)
    return M.read_manifest(spark, path, "json", "/clips/")[0]


@book.add(
    "read_pipe_metadata",
    """with l as (select doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') as t, source from documents)
    select 'f' || cast(doc_id as varchar) as file, case when doc_id % 2 = 0 then source else 'default' end as speaker, string_split(t, '|')[-1] as text
    from l where doc_id % 5 <> 0 and not contains(t, '|')""",
)
def read_pipe_metadata(spark, d):
    t = F.regexp_replace("text", "[\n\r]", " ")
    file = F.concat(F.lit("f"), F.col("doc_id"))
    line = F.when(F.col("doc_id") % 5 == 0, file).when(F.col("doc_id") % 2 == 0, F.concat_ws("|", file, "source", t)).otherwise(F.concat_ws("|", file, t))
    path = new_path(spark, "metadata")
    table(spark, d, "documents").where(~F.contains(t, F.lit("|"))).select(line.alias("value")).write.option("lineSep", "\n").text(path)
    return M.pipe_fields(spark.read.option("lineSep", "\n").text(path))


@book.add(
    "ingest_mapped",
    """select 'd' || cast(doc_id as varchar) as audio, text, 'spk_' || lower(upper(source)) || '_x' as speaker_id, 'indic' as language
    from documents where lower(lang) in ('en', 'de') and text <> ''""",
)
def ingest_mapped(spark, d):
    rows = table(spark, d, "documents").withColumn("gender", F.upper("source")).where(F.lower("lang").isin("en", "de"))
    return M.mapped(rows, {"audio": "d{doc_id}", "text": "text", "speaker_id": "spk_{gender}_x", "language": "=indic"}, lower=("gender",))


@book.add("source_row_id", "select doc_id, 'documents:' || r as source_id, 'documents_' || lpad(r::varchar, 6, '0') as clip_id from (select doc_id, row_number() over () - 1 as r from documents)")
def source_row_id(spark, d):
    return M.source_rows(spark, f"{d}/documents.parquet").select("doc_id", "source_id", "clip_id")


@book.add("shard_glob")
def shard_glob(spark, d):
    path = new_path(spark, "shards")
    table(spark, d, "documents").select("doc_id", "lang").repartition(4, "doc_id").write.partitionBy("lang").parquet(path)
    return M.shards(spark, path).select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "length")


@book.add("ingest_resume", "select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0")
def ingest_resume(spark, d):
    orders = table(spark, d, "orders")
    return M.resume(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey").select("o_orderkey", "o_custkey")


@book.add(
    "ingest_budget",
    """with r as (select o_orderkey // 1000 as shard, o_orderkey as row, cast(floor(o_totalprice) as bigint) as amount from orders),
    p as (select *, coalesce(sum(amount) over (order by shard, row rows between unbounded preceding and 1 preceding), 0) as prior from r)
    select shard, row, amount, prior::bigint as prior from p where prior < 90000000""",
)
def ingest_budget(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey div 1000 as shard", "o_orderkey as row", "cast(floor(o_totalprice) as long) as amount")
    return M.within_budget(rows, "shard", "row", "amount", 90_000_000).select("shard", "row", "amount", F.col("prior").cast("long").alias("prior"))


@book.add(
    "ingest_summary",
    """select count(*) filter (where lang <> 'en') as n_filtered, count(*) filter (where lang = 'en' and doc_id % 4 = 0) as n_skipped,
    count(*) filter (where lang = 'en' and doc_id % 4 <> 0) as n_new, sum(n_chars) filter (where lang = 'en' and doc_id % 4 <> 0) / 3600.0 as hours,
    count(distinct source) filter (where lang = 'en' and doc_id % 4 <> 0) as n_speakers from documents""",
)
def ingest_summary(spark, d):
    en, skip = F.col("lang") == "en", F.col("doc_id") % 4 == 0
    return table(spark, d, "documents").agg(
        F.count_if(~en).alias("n_filtered"), F.count_if(en & skip).alias("n_skipped"), F.count_if(en & ~skip).alias("n_new"),
        (F.sum(F.when(en & ~skip, F.col("n_chars"))) / 3600.0).alias("hours"), F.countDistinct(F.when(en & ~skip, F.col("source"))).alias("n_speakers"),
    )


@book.add(
    "style_regroup",
    """with m as (select distinct event_type, 'grp_' || substr(event_type, 1, 1) as grp from events where event_type < 'm')
    select event_id, coalesce(grp, 'neutral') as grp from events left join m using (event_type)""",
)
def style_regroup(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    known = e.select("event_type").distinct().where("event_type < 'm'").withColumn("grp", F.concat(F.lit("grp_"), F.substr("event_type", F.lit(1), F.lit(1))))
    return M.regroup(e, known, ["event_type"], "neutral", "grp").select("event_id", "grp")


_SPLIT = "case when doc_id % 20 = 0 then 'test' when doc_id % 20 = 1 then 'val' else 'train' end"


@book.add("write_splits", f"select {_SPLIT} as split, count(*) as n, count(distinct source) as n_speakers, {_SPLIT} = 'test' as heldout from documents group by 1, 4")
def write_splits(spark, d):
    path = new_path(spark, "splits")
    M.write_splits(table(spark, d, "documents").selectExpr("doc_id", "source", f"{_SPLIT} as split"), path)
    return M.split_summary(spark.read.schema("doc_id long, source string, split string, heldout boolean").json(path).drop("heldout"), "split", "source")


@book.add("heldout_guard", f"select doc_id from documents where {_SPLIT} <> 'test'")
def heldout_guard(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_SPLIT} as split").where("split <> 'test'")
    M.refuse_heldout(rows)
    return rows.select("doc_id")


@book.add("write_training_list", """select cast(doc_id as varchar) || '.wav|' || source || '|' || replace(translate(text, '|', chr(2404)), '"', '') as value from documents""")
def write_training_list(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.col("doc_id"), F.lit(".wav")).alias("file"), "source", "text")
    return M.training_lines(rows, "file", "source", "text")


@book.add("shard_by_count", "select doc_id, (row_number() over (order by doc_id) - 1) // 250 as shard from documents")
def shard_by_count(spark, d):
    return M.shard_numbers(table(spark, d, "documents").select("doc_id"), "doc_id", 250)


@book.add("upsert_run", "select o_orderkey % 5 as run, o_orderkey, case when o_orderkey % 5 = 2 then o_totalprice + 1 else o_totalprice end as score from orders")
def upsert_run(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey % 5 as run", "o_orderkey", "o_totalprice as score")
    path = new_path(spark, "runs")
    rows.write.partitionBy("run").parquet(path)
    again = rows.where("run = 2").withColumn("score", F.col("score") + 1)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    return spark.read.parquet(path).select(F.col("run").cast("long").alias("run"), "o_orderkey", "score")


@book.add("first_baseline", "select o_custkey, min_by(o_totalprice, o_orderkey) as baseline from orders where o_orderkey % 10 < 5 group by 1 union all select o_custkey, min_by(o_totalprice, o_orderkey) from orders group by 1 having bool_and(o_orderkey % 10 >= 5)")
def first_baseline(spark, d):
    first = lambda rows: rows.groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("baseline"))
    orders = table(spark, d, "orders")
    base, now = first(orders.where("o_orderkey % 10 < 5")), first(orders.where("o_orderkey % 10 >= 5"))
    return base.unionByName(M.resume(now, base, "o_custkey"))


@book.add("backfill_metric", "select o_orderkey, case when o_orderkey % 4 = 0 then o_totalprice * 2 else o_totalprice end as metric from orders")
def backfill_metric(spark, d):
    orders = table(spark, d, "orders")
    redone = orders.where("o_orderkey % 4 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("redone"))
    return orders.join(redone, "o_orderkey", "left").select("o_orderkey", F.coalesce("redone", "o_totalprice").alias("metric"))


@book.add(
    "annotation_merge",
    """select d.doc_id as id, case when l.toxic = 0 then '+' || d.text else d.text end as text,
    case when l.doc_id is null then lang when l.toxic = 1 then 'tense' end as style, case when l.quality = 0 then 'rejected' end as reject_reason,
    case when l.doc_id is not null and l.quality = 1 then 'human_verified' else 'model' end as label_source,
    case when l.quality = 1 then 'ann' end as verifier from (select doc_id, trim(text) as text, lang from documents) d left join labels l using (doc_id)""",
)
def annotation_merge(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.trim("text").alias("text"), F.col("lang").alias("style"), F.lit("model").alias("label_source"))
    found = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id")
    edit = found.select("id", F.when(F.col("toxic") == 0, F.concat(F.lit("+"), "text")).otherwise("  ").alias("text"), F.when(F.col("toxic") == 1, "tense").otherwise("").alias("style"), (F.col("quality") == 0).alias("rejected"), F.lit("").alias("reason"), F.lit("ann").alias("annotator"), F.lit(2).alias("at"))
    old = edit.withColumns({"text": F.lit("stale"), "at": F.lit(1)})
    return M.merge_annotations(docs, edit.union(old))


#: Pinned: rows and checksum of ``region``, which is the same at every scale.
PIN = (5, 7370162031071439404)


@book.add("pinned_corpus", "select * from region")
def pinned_corpus(spark, d):
    return M.pinned(table(spark, d, "region"), ["r_regionkey", "r_name"], *PIN)


@book.add(
    "dataset_fingerprint",
    """with l as (select concat_ws(':', p_name, cast(p_size as varchar)) as line from part),
    b as (select cast('0x' || substr(md5(line), 1, 2) as int) % 64 as b, line from l),
    h as (select b, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as h from b group by 1)
    select sum(n)::bigint as n, sha256(string_agg(h, chr(10) order by b)) as digest from h""",
)
def dataset_fingerprint(spark, d):
    return M.listing_digest(table(spark, d, "part"), "p_name", "p_size")
