"""Queries of corpus-scale text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.operators import corpus as C, dedup as D, normalize as N
from vocalith.plans.base import Book, table

book = Book()


def docs(spark, d):
    return table(spark, d, "documents")


@book.add("text_key", r"select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]', ' ', 'g'), '\s+', ' ', 'g')) as key from documents")
def text_key(spark, d):
    return docs(spark, d).select("doc_id", T.text_key(F.col("text")).alias("key"))


@book.add("digit_fold", "select doc_id, text as folded from documents")
def digit_fold(spark, d):
    wide = F.translate("text", "0123456789", "".join(chr(0x966 + k) for k in range(10)))
    return docs(spark, d).select("doc_id", C.fold_digits(wide).alias("folded"))


def _nsw_sql() -> str:
    text, out = "text", []
    for name, pattern in C.NSW:
        out.append(f"select grp, '{name}' as class, sum(len(regexp_extract_all({text}, '{pattern}')))::bigint as n from t group by 1")
        text = f"regexp_replace({text}, '{pattern}', chr(1), 'g')"
    return "with t as (select lang as grp, text from documents union all select 'pages', html from pages) " + " union all ".join(out)


@book.add("nsw_profile", _nsw_sql())
def nsw_profile(spark, d):
    rows = docs(spark, d).select(F.col("lang").alias("grp"), "text").union(table(spark, d, "pages").select(F.lit("pages"), "html"))
    return C.nsw_profile(rows, "text", "grp")


@book.add("verbalize_corpus")
def verbalize_corpus(spark, d):
    return N.verbalize(docs(spark, d), "text").select("doc_id", "spoken", "hits")


_UNDER = "(string_split('" + N.UNDER_100 + "', ' '))"


def _small(n: str) -> str:
    """Words of a number below 10^7 in DuckDB."""
    parts = [f"case when ({n}) {m} // {size} > 0 then {_UNDER}[({n}) {m} // {size} + 1] || ' {name}' end" for m, size, name in (("% 10000000", 100_000, N.LAKH), ("% 100000", 1_000, N.THOUSAND), ("% 1000", 100, N.HUNDRED))]
    return f"concat_ws(' ', {', '.join(parts)}, case when ({n}) % 100 > 0 or ({n}) % 10000000 = 0 then {_UNDER}[({n}) % 100 + 1] end)"


_PAISE = "cast(round(o_totalprice * 100) as bigint)"
_WHOLE = f"{_PAISE} // 100"


@book.add("verbalize_numbers", f"""select o_orderkey, case when {_WHOLE} >= 10000000 then concat_ws(' ', {_small(f'{_WHOLE} // 10000000')}, '{N.CRORE}', case when {_WHOLE} % 10000000 > 0 then {_small(_WHOLE)} end) else {_small(_WHOLE)} end as whole,
 {_small(_WHOLE)} || ' दशमलव ' || {_UNDER}[{_PAISE} // 10 % 10 + 1] || ' ' || {_UNDER}[{_PAISE} % 10 + 1] as decimals,
 case when year(o_orderdate) between 1100 and 1999 then concat_ws(' ', {_UNDER}[year(o_orderdate) // 100 + 1], '{N.HUNDRED}', case when year(o_orderdate) % 100 > 0 then {_UNDER}[year(o_orderdate) % 100 + 1] end) else {_small('year(o_orderdate)')} end as in_year from orders""")
def verbalize_numbers(spark, d):
    paise = F.round(F.col("o_totalprice") * 100).cast("long")
    written = F.concat(F.floor(paise / 100).cast("string"), F.lit("."), F.lpad((paise % 100).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", N.count(F.floor(paise / 100)).alias("whole"), N.spoken(written).alias("decimals"), N.year(F.year("o_orderdate").cast("string")).alias("in_year"))


def lexicon(spark, d):
    """Words of the benchmark of five letters and more, each with a respelling."""
    w = C.tokens(table(spark, d, "benchmark"), "text").select(F.col("token").alias("word")).distinct().where("length(word) >= 5")
    return w.withColumn("say", F.reverse("word"))


LEX_SQL = r"""lex as (select distinct word, reverse(word) as say from (select regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') as word from benchmark) where length(word) >= 5)"""


@book.add("lexicon_respell", f"""with {LEX_SQL}, t as (select doc_id, unnest(string_split(text, ' ')) as raw, unnest(range(1, len(string_split(text, ' ')) + 1)) as pos from documents)
 select doc_id, string_agg(coalesce(say, raw), ' ' order by pos) as respelled, count(say) as hits from t left join lex on word = lower(raw) group by 1""")
def lexicon_respell(spark, d):
    return C.respell(docs(spark, d), "text", lexicon(spark, d), "doc_id")


@book.add("lexicon_coverage", rf"""with {LEX_SQL}, t as (select regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as token from documents)
 select token, count(*) as n from t where token <> '' and token not in (select word from lex) group by 1 order by n desc, token limit 100""")
def lexicon_coverage(spark, d):
    return C.uncovered(docs(spark, d), "text", lexicon(spark, d), 100)


@book.add("token_tags", rf"""with {LEX_SQL}, t as (select lang, unnest(regexp_split_to_array(text, '\s+')) as raw from documents)
 select lang, case when regexp_matches(raw, '^[0-9.,:/%-]*[0-9][0-9.,:/%-]*$') then 'num' when not regexp_matches(raw, '[\p{{L}}\p{{N}}]') then 'punct' when word is not null then 'hi-Latn' else 'en' end as tag, count(*) as n
 from t left join lex on word = lower(raw) where raw <> '' group by 1, 2""")
def token_tags(spark, d):
    each = docs(spark, d).select("lang", F.explode(F.split("text", r"\s+")).alias("raw")).where("raw <> ''").withColumn("word", F.lower("raw"))
    met = each.join(lexicon(spark, d), "word", "left")
    return met.groupBy("lang", C.tag(F.col("raw"), F.col("say").isNotNull()).alias("tag")).agg(F.count("*").alias("n"))


_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@book.add("sentence_split", rf"select doc_id, unnest({_SENT}) as sentence, unnest(range(len({_SENT}))) as pos from documents")
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "sentence", F.col("pos").cast("long").alias("pos"))


@book.add("romanized_sentences", rf"""with {LEX_SQL}, s as (select doc_id, unnest({_SENT}) as s, unnest(range(len({_SENT}))) as pos from documents), w as (select doc_id, pos, regexp_replace(unnest(regexp_split_to_array(lower(s), '\s+')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as word from s),
 c as (select doc_id, pos, count(*) as n, count(say) as hits, bool_or(coalesce(length(say) >= 6, false)) as sure from w left join lex using (word) where word <> '' group by 1, 2) select doc_id, pos from c where hits >= 2 and 2 * hits >= n and sure""")
def romanized_sentences(spark, d):
    s = docs(spark, d).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("pos", "s")).where(~F.col("s").rlike(r"[\x{900}-\x{97F}]"))
    met = C.tokens(s.withColumnRenamed("pos", "at"), "s", "doc_id", "at").join(lexicon(spark, d), F.col("token") == F.col("word"), "left")
    counts = met.groupBy("doc_id", "at").agg(F.count("*").alias("n"), F.count("say").alias("hits"), F.bool_or(F.coalesce(F.length("say") >= 6, F.lit(False))).alias("sure"))
    return counts.where("hits >= 2 and 2 * hits >= n and sure").select("doc_id", F.col("at").cast("long").alias("pos"))


@book.add("chunk_corpus")
def chunk_corpus(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(C.stream_chunks(F.col("text"))).alias("pos", "chunk"))


@book.add("gap_class", r"""with b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s+$', ''), '["''”’»)\]}]+$', ''), '\s+$', '') as b from documents)
 select doc_id, case when regexp_matches(b, '(\.\.\.|…)$') then 'ellipsis' when regexp_matches(b, '[.।]$') then 'sentence' when regexp_matches(b, '\?$') then 'question' when regexp_matches(b, '!$') then 'exclaim'
 when regexp_matches(b, ',$') then 'comma' when regexp_matches(b, '[;:]$') then 'colon' when regexp_matches(b, '[-–—]$') then 'dash' else 'phrase' end as gap from b""")
def gap_class(spark, d):
    return docs(spark, d).select("doc_id", C.gap_class(F.col("text")).alias("gap"))


@book.add("speakable_clean", r"""with p as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*([-•]|[0-9]+[.)])\s+', '', 'g'), '[*#`\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]', '', 'g'), '\s+', ' ', 'g')) as t from documents)
 select doc_id, case when regexp_matches(t, '[\p{L}\p{N}_]') then t else '' end as clean from p""")
def speakable_clean(spark, d):
    return docs(spark, d).select("doc_id", C.speakable(F.col("text")).alias("clean"))


@book.add("punct_variants", r"select doc_id, replace(text, ',', '।') as danda, regexp_replace(text, '([^,.;:!?।\s]) (and|but|because) ', '\1, \2 ', 'g') as conjunction from documents")
def punct_variants(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", C.punct_variant(t, "danda").alias("danda"), C.punct_variant(t, "conjunction").alias("conjunction"))


@book.add("rewrite_rules", r"select doc_id, regexp_replace(regexp_replace(text, '([0-9]{4})-([0-9]{2})-([0-9]{2})', '\3 \2 \1', 'g'), '([0-9]{3})-([0-9]{4})', '\1 \2', 'g') as rewritten from documents")
def rewrite_rules(spark, d):
    rules = [("iso_date", r"([0-9]{4})-([0-9]{2})-([0-9]{2})", "$3 $2 $1"), ("unused", "x", "y"), ("phone", r"([0-9]{3})-([0-9]{4})", "$1 $2")]
    return docs(spark, d).select("doc_id", C.rewrite(F.col("text"), rules, ["iso_date", "phone"]).alias("rewritten"))


@book.add("trigram_vector")
def trigram_vector(spark, d):
    return D.trigram_counts(docs(spark, d).select("doc_id", T.text_key(F.col("text")).alias("key")), "doc_id", "key")


@book.add("phoneme_list_filter", """with k as (select doc_id, source, n_chars, regexp_replace(lower(text), '[^a-eou-z]', '', 'g') as kept from documents), f as (select * from k where n_chars <= 2000 and length(kept) >= 5), s as (select source, row_number() over (order by min(doc_id)) - 1 as speaker_no from f group by 1)
 select doc_id, length(kept) as n_symbols, speaker_no from f join s using (source)""")
def phoneme_list_filter(spark, d):
    rows = docs(spark, d).withColumn("symbols", F.lower("text"))
    return C.phoneme_list(rows, "a-eou-z", "source", "doc_id", "symbols", "n_chars", 2000).select("doc_id", F.length("kept").cast("long").alias("n_symbols"), F.col("speaker_no").cast("long").alias("speaker_no"))
