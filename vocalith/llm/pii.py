"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Each kind has a pattern, a validator and context words. ``F.split`` and ``F.regexp_extract_all`` with one pattern give the
pieces between matches and the matches; running sums of their lengths are the spans, in code points. The piece before a
match is its context. Patterns carry ``\\G`` or a look-behind so that a match can begin only where the plain pattern's
leftmost match would, and possessive repeats, so that long runs of digits or letters take linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vocalith.llm.native import let, sums_before, unused

#: Characters before a span that can hold a context word.
CONTEXT = 48
#: kind, pattern, a text that any match needs, words nearby, score without them. Base kinds come first and are always kept.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|kontakt|courriel|correo", 0.9),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|host|server|address|adresse", 0.7),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "", r"card|visa|master|karte|carte|tarjeta", 0.8),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|call|tel|fax|mobil|handy", 0.8),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", r"iban|bank|konto|account|compte|cuenta", 0.7),
    ("pan", r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])", "", r"card|visa|amex|karte|carte|tarjeta", 0.3),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", r"ssn|social|security", 0.3),
    ("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", "", r"token|secret|passw|api.?key|apikey", 0.2),
]
BASE = ("email", "ip", "card", "phone")
#: Kinds beyond the base ones need this score; a context word adds ``BOOST``.
NEEDED, BOOST = 0.6, 0.4


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    return F.call_function("luhn_check", x)


def _at_most_255(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)


def _mod97(x: Column) -> Column:
    """The ISO 7064 remainder of an account number: four characters go to the end, A is 10 and Z is 35."""

    def rest(s: Column) -> Column:
        turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
        values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48))
        return F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return let(F.replace(x, F.lit(" "), F.lit("")), rest)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), _at_most_255)
    if kind == "card":
        return let(_digits(x), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(x) == 1)
    if kind == "pan":
        return _luhn(_digits(x))
    return F.lit(True)


def _found(text: Column, kind: str, pattern: str, needs: str, near: str, score: float) -> Column:
    """Array of the confirmed spans of one kind."""
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")

    def spans(matches: Column) -> Column:
        def placed(pieces: Column) -> Column:
            sizes = F.transform(matches, lambda m, k: F.length(F.get(pieces, k)) + F.length(m))

            def judged(before: Column) -> Column:
                def one(m: Column, k: Column) -> Column:
                    start = F.get(before, k) + F.length(F.get(pieces, k))
                    context = F.right(F.get(pieces, k), F.lit(CONTEXT))
                    mark = F.lit(score) + F.when(context.rlike(f"(?i){near}"), BOOST).otherwise(0.0)
                    return F.when(_valid(kind, m), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.least(F.lit(1.0), mark).alias("score")))

                return F.filter(F.transform(matches, one), lambda s: s.isNotNull() if kind in BASE else s.isNotNull() & (s["score"] >= NEEDED))

            return let(sums_before(sizes), judged)

        return F.when(F.size(matches) > 0, let(F.split(text, pattern), placed)).otherwise(none)

    seen = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), let(seen, spans)).otherwise(none) if needs else let(seen, spans)


def spans(documents: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``documents`` with ``out``, an array of (kind, start, end, score) by kind in the order of ``KINDS``, then start.

    Offsets count code points, the end is exclusive. Spans of different kinds may overlap. Null and empty texts have none;
    all other columns pass through, and ``out`` replaces a column of that name. Repeated rows give equal results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.withColumn(out, F.concat(*[_found(text, *kind) for kind in KINDS]))


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets; of overlapping spans the earlier one counts.

    Null and empty texts stay as they are, equal texts become equal, an empty table gives an empty one, and long texts are searched whole. All other columns
    pass through, whatever their names.
    """
    name = unused("_spans", documents.columns)
    found = spans(documents, text_col, name)

    def rebuilt(s: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

        def step(acc: Column, x: Column) -> Column:
            piece = F.substr(F.col(text_col), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int"))
            took = F.struct(F.concat(acc["done"], piece, F.lit("<"), x["kind"], F.lit(">")).alias("done"), x["end"].alias("at"))
            return F.when(x["start"] >= acc["at"], took).otherwise(acc)

        return F.aggregate(s, start, step, lambda acc: F.concat(acc["done"], F.substr(F.col(text_col), acc["at"].cast("int") + 1)))

    by_place = F.array_sort(F.transform(name, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return found.withColumn(text_col, F.when(F.size(name) > 0, let(by_place, rebuilt)).otherwise(F.col(text_col))).select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """All spans of all documents."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "spans")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[number(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
