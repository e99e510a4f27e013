"""Row gates: named failures, rights, reviews, consent, references, constraints and routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Thresholds:
    """Limits of the clip gates."""

    min_s: float = 1.0
    max_s: float = 15.0
    min_rms_dbfs: float = -45.0
    max_rms_dbfs: float = -6.0
    min_lufs: float = -48.0
    max_lufs: float = -8.0
    max_clip_frac: float = 0.001
    max_clip_run: int = 6
    min_snr_db: float = 15.0
    max_silence_ratio: float = 0.6
    min_speech_s: float = 0.5
    min_cps: float = 4.0
    max_cps: float = 30.0
    max_cer: float = 0.35
    near_dur_tol: float = 0.1
    text_near_sim: float = 0.92
    vector_near_cos: float = 0.97
    condition_z: float = 4.0
    condition_min_group: int = 20


def reasons(checks: dict[str, Column]) -> Column:
    """Array of the names whose condition holds, in the order given; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


def clip_reasons(rows: DataFrame, th: Thresholds = Thresholds(), out: str = "reasons") -> DataFrame:
    """Failures of measured clips. ``n_chars`` is null where there is no transcript: its checks are then left out."""
    c, cps = F.col, F.col("n_chars") / F.greatest(F.col("speech_s"), F.lit(1e-3))
    empty = c("n_chars") == 0
    return rows.withColumn(out, reasons({
        "too_short": c("duration_s") < th.min_s, "too_long": c("duration_s") > th.max_s,
        "rms_low": c("rms_dbfs") < th.min_rms_dbfs, "rms_high": c("rms_dbfs") > th.max_rms_dbfs,
        "loudness_low": c("lufs") < th.min_lufs, "loudness_high": c("lufs") > th.max_lufs,
        "clipping": (c("clip_frac") > th.max_clip_frac) | (c("clip_run") >= th.max_clip_run),
        "low_snr": c("snr_db") < th.min_snr_db, "silence_ratio": c("silence_ratio") > th.max_silence_ratio,
        "too_little_speech": c("speech_s") < th.min_speech_s,
        "empty_transcript": empty, "speech_rate_low": ~empty & (cps < th.min_cps), "speech_rate_high": ~empty & (cps > th.max_cps),
    }))


def split_by_reasons(rows: DataFrame, col: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with all their reasons in one string."""
    return rows.where(F.size(col) == 0).drop(col), rows.where(F.size(col) > 0).withColumn("reason", F.array_join(col, ";")).drop(col)


def script_reasons(text: Column, script: str, other: str, allowed: str, names: tuple[str, str]) -> Column:
    """Failures of a text against a wanted script; all three sets are regex character classes without brackets."""
    count = lambda cls: F.length(text) - F.length(F.regexp_replace(text, f"[{cls}]", ""))
    wanted, rest = count(script), count(other)
    blank = F.trim(F.regexp_replace(text, r"\s", "")) == ""
    share = wanted / (wanted + rest) < 0.5
    return reasons({
        "empty_transcript": blank, names[0]: ~blank & (wanted == 0), names[1]: ~blank & F.when(wanted > 0, share).otherwise(False),
        "bad_normalization": ~blank & (text.rlike(r"\p{Nd}") | text.rlike(f"[^{allowed}]")),
    })


def inline_reasons(rows: DataFrame, order: list[str], own: str, payload: str, speaker: str, key: str, readable: str) -> DataFrame:
    """``rows`` with ``all_reasons``: their own, and duplicates of any earlier readable row, accepted or not."""
    seen = lambda *by: F.row_number().over(Window.partitionBy(*by, readable).orderBy(*order)) > 1
    ok = F.col(readable)
    dup = reasons({"duplicate_audio": ok & seen(payload), "duplicate_text": ok & seen(speaker, key)})
    return rows.withColumn("all_reasons", F.when(ok, F.concat(own, dup)).otherwise(F.array(F.lit("unreadable"))))


def human_labels(rows: DataFrame, labels: list[str], source: str = "label_source") -> DataFrame:
    """``rows`` with labels kept only where a person verified them; ``n_dropped`` says how many a row lost."""
    ok = F.coalesce(F.col(source) == "human_verified", F.lit(False))
    lost = sum((F.when(~ok & F.col(c).isNotNull(), 1).otherwise(0) for c in labels), F.lit(0))
    return rows.withColumn("n_dropped", lost).withColumns({c: F.when(ok, F.col(c)) for c in labels})


def rights_problems(entries: DataFrame) -> DataFrame:
    """Problems of rights entries read as strings and arrays: missing fields, flags that are no booleans, repeated ids."""
    needed = ["rights_id", "source", "licence", "speaker_ids", "permitted_uses", "speaker_authorization", "vendor_generated"]
    empty = lambda c: F.size(c) <= 0 if dict(entries.dtypes)[c].startswith("array") else F.trim(c) == ""
    missing = {f"missing {c}": F.col(c).isNull() | empty(c) for c in needed}
    flags = {f"{c} is no boolean": F.col(c).isNotNull() & (F.trim(c) != "") & ~F.col(c).isin("true", "false") for c in ("speaker_authorization", "vendor_generated")}
    twice = F.count("*").over(Window.partitionBy("rights_id")) > 1
    marked = entries.withColumn("problems", reasons(missing | flags | {"duplicate rights_id": F.col("rights_id").isNotNull() & twice}))
    return marked.where("size(problems) > 0").select("rights_id", F.array_join("problems", ";").alias("problems"))


def violation(use: str = "tts_training") -> Column:
    """Why an entry's columns do not permit a use; null if they do."""
    return (
        F.when(F.col("rights_id").isNull(), "no data-rights entry")
        .when(~F.coalesce("speaker_authorization", F.lit(False)), "speaker not authorized")
        .when(~F.array_contains("permitted_uses", use), f"{use} not a permitted use")
        .when(F.col("vendor_generated") & ~F.coalesce("vendor_generation_permission", F.lit(False)), "vendor-generated audio without permission")
    )


def rights_check(rows: DataFrame, entries: DataFrame, use: str = "tts_training") -> DataFrame:
    """Rows that may not be used, with ``reason``. ``rows``: id, speaker_id, rights_id (may be null); ``entries``: also ``pos``, their
    order. A row without a rights_id takes its speaker's first entry, unless the speaker's entries disagree."""
    judged = entries.withColumn("why", violation(use))
    by_id = judged.select(F.col("rights_id").alias("e_id"), "speaker_ids", "why")
    named = rows.where("coalesce(rights_id, '') <> ''").join(by_id, F.col("rights_id") == F.col("e_id"), "left")
    covered = F.coalesce(F.array_contains("speaker_ids", F.col("speaker_id")), F.lit(False))
    first = named.select("id", "speaker_id", F.when(F.col("e_id").isNull(), "no data-rights entry").when(F.col("why").isNotNull(), F.col("why")).when(~covered, "speaker not covered by rights entry").alias("reason"))
    each = judged.select(F.explode("speaker_ids").alias("speaker_id"), "pos", F.coalesce("why", F.lit("")).alias("why"))
    by_speaker = each.groupBy("speaker_id").agg(F.countDistinct("why").alias("n_views"), F.min_by("why", "pos").alias("why"))
    loose = rows.where("coalesce(rights_id, '') = ''").select("id", "speaker_id").join(by_speaker, "speaker_id", "left")
    second = loose.select("id", "speaker_id", F.when(F.col("why").isNull(), "no data-rights entry").when(F.col("n_views") > 1, "conflicting rights entries").otherwise(F.nullif("why", F.lit(""))).alias("reason"))
    return first.union(second).where("reason is not null")


def rights_enforce(rows: DataFrame, entries: DataFrame, use: str = "tts_training") -> None:
    """Raise with the number of rows that may not be used and ten of their reasons."""
    bad = rights_check(rows, entries, use)
    if n := bad.count():
        raise ValueError(f"{n} rows are not cleared: {[tuple(r) for r in bad.orderBy('id').limit(10).collect()]}")


def rights_upsert(entries: DataFrame, new: DataFrame, key: str = "rights_id") -> DataFrame:
    """Entries with new ones: the same id unites speakers and revisions, and moves to the end (``pos``)."""
    a, b = entries.alias("a"), new.alias("b")
    last = entries.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_last"))
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").crossJoin(F.broadcast(last))
    none = F.expr("cast(array() as array<string>)")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(f"a.{c}", none), F.coalesce(f"b.{c}", none))).alias(c)
    pos = F.when(F.col(f"b.{key}").isNotNull(), F.col("_last") + F.col("b.pos")).otherwise(F.col("a.pos")).alias("pos")
    return met.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), both("speaker_ids"), both("revisions"), pos)


def review_reasons(clips: DataFrame, keys: str, reviews: DataFrame, limits: dict[str, int], allow_pending: bool = False) -> DataFrame:
    """``clips`` with ``reasons`` from the first of the keys (an array) that has a review; none is no opinion."""
    found = clips.select("id", F.posexplode(keys).alias("at", "review_id")).join(reviews, "review_id")
    names = ["quality", *limits]
    best = found.groupBy("id").agg(F.min_by(F.struct(*names), "at").alias("e"))
    low = {f"review_low_{k}": F.col(f"e.{k}") < n for k, n in limits.items()}
    pending = {} if allow_pending else {"review_pending": F.col("e.quality") == "review"}
    return clips.join(best, "id", "left").withColumn("reasons", reasons({"review_rejected": F.col("e.quality") == "rejected"} | pending | low)).drop("e")


def review_problems(lines: DataFrame, value: str = "value") -> DataFrame:
    """Problems of review entries in JSON lines: no string id, repeated id, unknown field, bad quality, a score that is no 1-5."""
    scores = ("naturalness", "pronunciation", "noise")
    e = lines.select(F.col(value).alias("raw"), F.from_json(value, "map<string,string>").alias("e"))
    text_id = F.get_json_object("raw", "$.id")
    e = e.withColumn("id", F.when(F.col("raw").rlike(r'"id"\s*:\s*"'), text_id))
    bad = {f"{k} is no 1-5": F.map_contains_key("e", k) & ~F.coalesce(F.col("e")[k].rlike("^[1-5]$") & ~F.col("raw").rlike(f'"{k}"\\s*:\\s*"'), F.lit(False)) for k in scores}
    unknown = F.size(F.array_except(F.map_keys("e"), F.array(*[F.lit(x) for x in ("id", "quality", *scores)]))) > 0
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    checks = {"no id": F.coalesce(F.col("id"), F.lit("")) == "", "duplicate id": F.col("id").isNotNull() & twice, "unknown field": unknown,
              "bad quality": ~F.coalesce(F.col("e")["quality"].isin("approved", "rejected", "review"), F.lit(False))} | bad
    return e.withColumn("problems", F.array_join(reasons(checks), ";")).where("problems <> ''").select("id", "problems")


def consent_reason(use: Column) -> Column:
    """Why a use is not allowed by consent columns (granted, revoked, uses); null if it is."""
    return F.when(~F.coalesce("granted", F.lit(False)), "consent not granted").when(F.coalesce("revoked", F.lit(False)), "consent revoked").when(~F.coalesce(F.array_contains("uses", use), F.lit(False)), "use not permitted")


def retention_plan(references: DataFrame, now: str) -> DataFrame:
    """References with ``purge``: older than their speaker's days, or the speaker is revoked; and ``clone_capable``, false when a
    purge leaves a speaker without any (null where nothing was purged)."""
    old = F.col("created") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.col("days"))
    purge = F.coalesce(F.col("revoked"), F.lit(False)) | F.coalesce(old, F.lit(False))
    w = Window.partitionBy("speaker")
    marked = references.withColumn("purge", purge)
    return marked.withColumn("clone_capable", F.when(F.max("purge").over(w), ~F.min("purge").over(w)))


def admit_references(references: DataFrame, most: int = 10) -> DataFrame:
    """``references`` (speaker, hash, at, id) with ``admitted``: the first of each hash, and of these the first ``most`` of a speaker."""
    first = F.row_number().over(Window.partitionBy("speaker", "hash").orderBy("at", "id")) == 1
    marked = references.withColumn("_first", first)
    slot = F.row_number().over(Window.partitionBy("speaker", "_first").orderBy("at", "id"))
    return marked.withColumn("admitted", F.col("_first") & (slot <= most)).drop("_first")


def screen_reference(rows: DataFrame, min_s: float = 3.0, max_s: float = 30.0, min_rate: int = 16_000) -> DataFrame:
    """``rows`` with the first reason to reject a reference, and a quality score where there is none."""
    c = F.col
    why = (
        F.when(c("duration_s") < min_s, "too short").when(c("duration_s") > max_s, "too long").when(c("sample_rate") < min_rate, "sample rate")
        .when(c("clip_frac") > 0.01, "clipped").when(c("rms_dbfs") < -45, "too quiet").when(c("speech_ratio") < 0.3, "mostly silence")
    )
    length = F.when(c("duration_s").between(5, 12), 1.0).otherwise(F.greatest(F.lit(0.3), F.least(c("duration_s") / 5, 12 / c("duration_s"))))
    level = F.greatest(F.lit(0.2), F.least(F.lit(1.0), (c("rms_dbfs") + 40) / 20))
    score = length * level * (0.5 + 0.5 * c("speech_ratio")) * (1 - c("clip_frac") * 20)
    return rows.withColumn("reject", why).withColumn("quality", F.when(why.isNull(), score))


def best_reference(rows: DataFrame, speaker: str, ref: str, quality: str, duration: str) -> DataFrame:
    """Each speaker's reference of the highest quality, then duration, then id."""
    return rows.groupBy(speaker).agg(F.max_by(ref, F.struct(quality, duration, ref)).alias("best"))


def constraints(rows: DataFrame, checks: dict[str, Column], unique: dict[str, list[str]], key: str) -> DataFrame:
    """Rows that break table constraints: row conditions that must hold, and value lists (ids, aliases) without repeats."""
    out = rows.select(key, F.explode(reasons({n: ~F.coalesce(c, F.lit(False)) for n, c in checks.items()})).alias("violation"))
    for name, columns in unique.items():
        each = rows.select(key, F.explode(F.array_compact(F.array_distinct(F.concat(*[F.col(c) if dict(rows.dtypes)[c].startswith("array") else F.array(c) for c in columns])))).alias("v"))
        twice = each.withColumn("n", F.count("*").over(Window.partitionBy("v"))).where("n > 1").select(key, F.lit(name).alias("violation")).distinct()
        out = out.union(twice)
    return out


def resolve_alias(requests: DataFrame, entries: DataFrame, name: str = "voice") -> DataFrame:
    """``requests`` with ``resolved``: the entry of that id, else one that is not planned and has the alias, else null."""
    ids = entries.select(F.col("id").alias(name), F.col("id").alias("_by_id"))
    aliases = entries.where("status <> 'planned'").select(F.explode("aliases").alias(name), F.col("id").alias("_by_alias")).groupBy(name).agg(F.min("_by_alias").alias("_by_alias"))
    return requests.join(ids, name, "left").join(aliases, name, "left").withColumn("resolved", F.coalesce("_by_id", "_by_alias")).drop("_by_id", "_by_alias")


def route(requests: DataFrame, engines: DataFrame, fallback: bool = True) -> DataFrame:
    """The first engine by (tier, name) that supports all controls of each request (relational division by a sorted control list).

    Requests with equal control lists are routed once. Without any, the best engine is taken as ``degraded``, or none if there is no
    fallback; ``missing`` then lists controls that some engine lacks. ``engines``: engine, tier (int), controls (array).
    """
    wanted = requests.select(F.array_sort(F.array_distinct("controls")).alias("controls")).distinct()
    pairs = wanted.crossJoin(F.broadcast(engines.select("engine", "tier", F.col("controls").alias("offered"))))
    lack = pairs.withColumn("lack", F.array_except("controls", "offered"))
    place = F.struct("tier", "engine")
    able = F.when(F.size("lack") == 0, place)
    best = lack.groupBy("controls").agg(F.min(able).alias("able"), F.min(place).alias("any"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lack")))).alias("missing"))
    chosen = best.select("controls", F.coalesce("able.engine", "any.engine" if fallback else F.lit(None)).alias("engine"), F.col("able").isNull().alias("degraded"), F.when(F.col("able").isNull(), F.array_join("missing", ",")).alias("missing"))
    return requests.withColumn("_k", F.array_sort(F.array_distinct("controls"))).join(chosen.withColumnRenamed("controls", "_k"), "_k").drop("_k")
