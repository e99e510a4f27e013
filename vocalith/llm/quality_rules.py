"""Quality rules as a ledger of bits: every rule is measured once, policies are masks over the bits.

``ledger`` evaluates all rules over each text and stores the failures as one long (bit k: rule k failed) beside the
measurements. A policy is a version name and a mask; a new policy, or what one rule costs, is then bitwise arithmetic over
the stored ledger, with no second look at the texts. Everything is built from SQL functions; nothing shuffles but the
ablation's one-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vocalith.llm.native import BLANKS, let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: name -> the failure as a condition on the measurements; the place in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 7 * word_chars"),
    ("duplicate_lines", "n_lines >= 5 and 10 * n_dup_lines > 5 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("upper_case", "n_words >= 10 and 2 * n_upper > word_chars"),
    ("stuttering", "n_words >= 10 and 5 * n_stutter > n_words"),
    ("one_word", "n_words >= 50 and 20 * n_distinct < n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: version -> mask of the rules that reject.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}


def _repeated(w: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more. Only texts with an equal pair of window hashes are looked at closely."""

    def close(windows: Column) -> Column:
        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: (F.get(s, a)["h"] == F.get(s, b)["h"]) & (F.slice(w, F.get(s, a)["p"] + 1, F.lit(WINDOW)) == F.slice(w, F.get(s, b)["p"] + 1, F.lit(WINDOW)))
            twin = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k, F.greatest(k - 1, F.lit(0)))).otherwise(False) | F.when(k < last, same(k, k + 1)).otherwise(False))
            return let(F.sort_array(F.transform(twin, lambda k: F.get(s, k)["p"])), covered)

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

        return let(F.sort_array(F.transform(windows, lambda x, k: F.struct(x.alias("h"), k.alias("p")))), places)

    def look(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), close(windows)).otherwise(F.lit(0).cast("long"))

    def spanned(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda k: F.xxhash64(*[F.get(h, k + j) for j in range(WINDOW)]))

    return F.when(F.size(w) > WINDOW, let(spanned(hashes), look)).otherwise(F.lit(0).cast("long"))


def ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: the id, the measurements (long) and ``failed``, the bits of the rules it fails.

    A null or blank text has no words, no symbols of words and fails ``few_words``. Repeated rows give equal rows, other
    columns are not read, an empty table gives an empty one. Measurements take the whole text, however long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = documents.select(F.col(id_col).alias("_id"), text.alias("_t"))
    split = bare.select("_id", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0).alias("_l"))
    hashed = split.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    h = F.col("_h")
    stutter = F.size(F.filter(F.sequence(F.lit(1), F.size(h) - 1), lambda k: F.get(h, k) == F.get(h, k - 1)))
    gone = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    measures = {
        "n_words": F.size(h),
        "word_chars": F.length(F.translate("_t", BLANKS, "")),
        "n_symbols": gone(SYMBOLS),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _repeated(F.col("_w"), h),
        "n_upper": F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", "")),
        "n_stutter": F.when(F.size(h) > 1, stutter).otherwise(0),
        "n_distinct": F.size(F.array_distinct(h)),
    }
    out = hashed.select(F.col("_id"), *[c.cast("long").alias(n) for n, c in measures.items()])
    failed = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0).cast("long") for name, rule in RULES), F.lit(0).cast("long"))
    return out.withColumn("failed", failed).withColumnRenamed("_id", id_col)


def verdicts(found: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept`` under a policy of ``POLICIES``, and the policy's name."""
    return found.withColumns({"kept": F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0, "policy": F.lit(policy)})


def ablation(found: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that would be kept if only this rule were dropped."""
    mask = POLICIES[policy]
    used = [n for n in BIT if BIT[n] & mask]
    hit = found.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in used])).alias("r")
    return hit.select("f", "n", rule).groupBy("r.rule").agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    found = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    shown = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(*shown, (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "failed")


_SQL_RULES = " | ".join(f"(case when {rule} then {BIT[name]} else 0 end)" for name, rule in RULES)
ORACLE = rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
win as (select doc_id, a, w[a:a + 7] as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as a from s where len(w) > 8)),
twice as (select doc_id, unnest(list(a)) as a from win group by doc_id, g having count(*) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(a, a + 8)) as p from twice) group by 1),
m as (select s.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
        (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::bigint as n_upper,
        len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1]))::bigint as n_stutter, len(list_distinct(w))::bigint as n_distinct
      from s left join rep on rep.doc_id is not distinct from s.doc_id),
f as (select *, cast({_SQL_RULES} as bigint) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {BASE} <> 0 as base_failed, failed = 0 as kept, failed from f
"""
