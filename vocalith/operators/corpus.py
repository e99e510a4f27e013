"""Corpus-scale text jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
#: Classes of non-standard words, in the order in which they are taken and masked; boundaries are spelled out,
#: as not every engine has look-around.
NSW = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("url", r"https?://[^ \n<>\"]+"),
    ("version", r"v?[0-9]+\.[0-9]+\.[0-9]+(\.[0-9]+)*"),
    ("glued_id", r"(^|[^A-Za-z0-9_])([A-Z]+[0-9]|[0-9]+[A-Z])[A-Z0-9]*"),
    ("date_iso", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("date_dmy", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"),
    ("date_named", rf"[0-9]{{1,2}}(st|nd|rd|th)? ({MONTHS})(,? [0-9]{{4}}|[^A-Za-z]|$)|({MONTHS}) [0-9]{{1,2}}(st|nd|rd|th)?(,? [0-9]{{4}})?"),
    ("clock", r"[0-9]{1,2}:[0-9]{2}"),
    ("phone", r"\+[0-9][0-9 ()-]{6,}[0-9]"),
    ("percent", r"[0-9]+(\.[0-9]+)? ?%"),
    ("scaled", r"([$€£₹] ?)?[0-9][0-9,.]* ?(lakh|lac|crore|cr|k|million|billion)([^A-Za-z]|$)"),
    ("currency", r"[$€£₹] ?[0-9][0-9,.]*"),
    ("range", r"[0-9]+-[0-9]+"),
    ("fraction", r"[0-9]+/[0-9]+"),
    ("ordinal", r"[0-9]+(st|nd|rd|th)"),
    ("unit", r"[0-9]+ ?(km|kg|cm|mm|GB|MB)"),
    ("code", r"[0-9]{4,}"),
    ("number", r"[0-9]+"),
    ("acronym", r"[A-Z]{2,}"),
]
# Words before, and after, which a long clause is cut, and after which it is if nothing better is near.
BREAK_BEFORE = "और लेकिन क्योंकि जहाँ जहां जो कि तो या अगर जब ताकि and but because so or".split()
BREAK_AFTER = "है हैं था थी थे हूँ हूं".split()
WEAK_AFTER = "में पर से को ने तक लिए पास बाद mein par se ko tak liye".split()
#: Characters that a word of these, and the spaces beside it, take.
LONGEST = 2 + max(map(len, BREAK_BEFORE))
#: What can follow a piece's last mark.
GAPS = [("ellipsis", r"(\.\.\.|…)$"), ("sentence", r"[.।]$"), ("question", r"\?$"), ("exclaim", r"!$"), ("comma", r",$"), ("colon", r"[;:]$"), ("dash", r"[-–—]$")]
CLOSERS = "\"'”’»)]}"


def fold_digits(text: Column, first: int = 0x966) -> Column:
    """Digits of a block that begins at a code point, as ASCII."""
    return F.translate(text, "".join(chr(first + k) for k in range(10)), "0123456789")


#: What every match of a class has one of.
SIGN = r"[0-9@]|[A-Z]{2}|://"
#: A word, and the space after it, that no class can match a part of, and the run of such words between two that can stand beside a match: no class
#: reaches over a whole word without a digit, but for ``phone`` over brackets and hyphens, with which no such word begins; nor do empty ones count.
_PROSE = r"[^ \n0-9@A-Z:()-](?:[^ \n0-9@A-Z:]++|[A-Z](?![A-Z])|:(?!//))*+[ \n]|[A-Z](?![A-Z])(?:[^ \n0-9@A-Z:]++|[A-Z](?![A-Z])|:(?!//))*+[ \n]"
PROSE_RUN = rf"(?<![^ \n])({_PROSE})(?:({_PROSE}))++"


def without_prose(text: Column) -> Column:
    """``text`` with the first and last word only of each run of words that no class of ``NSW`` can match; the matches of all classes stay.
    Null for a text without any."""
    return F.when(text.rlike(SIGN), F.regexp_replace(text, PROSE_RUN, "$1$2"))


def nsw_counts(text: Column) -> Column:
    """Occurrences by class, in the order of ``NSW``; what an earlier class has taken is masked for the later ones. The text goes
    through the classes in one fold, and one that it has no match of costs a single look."""
    start = F.struct(text.alias("t"), F.expr("cast(array() as array<int>)").alias("n"))

    def take(acc: Column, k: Column) -> Column:
        out = F
        for at, (_, pattern) in enumerate(NSW):
            masked = F.struct(F.regexp_replace(acc["t"], pattern, "\x01").alias("t"), F.concat(acc["n"], F.array(F.regexp_count(acc["t"], F.lit(pattern)))).alias("n"))
            none = F.struct(acc["t"].alias("t"), F.concat(acc["n"], F.array(F.lit(0))).alias("n"))
            out = out.when(k == at, F.when(acc["t"].rlike(pattern), masked).otherwise(none))
        return out

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(NSW) - 1)), start, take, lambda acc: acc["n"])


def nsw_profile(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Occurrences of each class by group, as rows, in one scan; prose that no class can match goes first. Null texts count nothing."""
    left = rows.where(F.col(text).isNotNull()).select(*by, without_prose(F.col(text)).alias("_t"))
    counts = left.select(*by, F.when(F.col("_t").isNotNull(), nsw_counts(F.col("_t"))).alias("_n"))
    sums = counts.groupBy(*by).agg(*[F.sum(F.coalesce(F.get("_n", F.lit(k)), F.lit(0))).cast("long").alias(name) for k, (name, _) in enumerate(NSW)])
    return sums.unpivot([F.col(b) for b in by], [name for name, _ in NSW], "class", "n")


def tokens(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """Tokens by position: words without edge punctuation, in lower case."""
    each = rows.select(*keep, F.posexplode(F.split(F.lower(text), r"\s+")).alias("pos", "raw"))
    return each.select(*keep, "pos", F.regexp_replace("raw", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("token")).where("token <> ''")


#: Entries of a lexicon that are broadcast; beyond it the words of all texts are shuffled.
BROADCAST_ENTRIES = 200_000


def respell(rows: DataFrame, text: str, lexicon: DataFrame, *keep: str, limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """``rows`` (keyed by ``keep``) with whole words replaced from a lexicon (word, say; a row a word), and the number of hits. Null texts are left out.

    Words are looked up inside their texts, which are not shuffled. Beyond ``limit`` entries words become rows that meet the lexicon by a
    join, with equal results.
    """
    entries = lexicon.where("word is not null and say is not null").select("word", "say").limit(limit + 1).collect()  # ``limit`` rows and one at most
    if len(entries) <= limit:
        known = {r.word: r.say for r in entries}

        @F.pandas_udf("struct<respelled:string,hits:long>")
        def said(texts: pd.Series, lower: pd.Series) -> pd.DataFrame:
            out = []
            for t, low in zip(texts, lower, strict=True):
                hits = [(k, known[w]) for k, w in enumerate(low.split(" ")) if w in known]
                if hits:
                    words = t.split(" ")
                    for k, say in hits:
                        words[k] = say
                    t = " ".join(words)
                out.append((t, len(hits)))
            return pd.DataFrame(out, columns=["respelled", "hits"])

        made = rows.where(F.col(text).isNotNull()).select(*keep, said(F.col(text), F.lower(text)).alias("_said"))
        return made.select(*keep, "_said.respelled", "_said.hits")
    each = rows.select(*keep, F.posexplode(F.split(text, " ")).alias("pos", "raw")).withColumn("word", F.lower("raw"))
    met = each.join(lexicon, "word", "left")
    return met.groupBy(*keep).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("say", "raw").alias("w")))), lambda x: x["w"]), " ").alias("respelled"), F.count("say").alias("hits"))


def uncovered(rows: DataFrame, text: str, lexicon: DataFrame, top: int) -> DataFrame:
    """The most frequent tokens without an entry."""
    counts = tokens(rows, text).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(lexicon.select(F.col("word").alias("token")), "token", "left_anti").orderBy(F.desc("n"), "token").limit(top)


def tag(token: Column, known: Column) -> Column:
    """Class of a raw token: native script, romanised (a known word), other Latin, number, punctuation."""
    return F.when(token.rlike(r"[\x{900}-\x{97F}]"), "hi").when(token.rlike(r"^[0-9.,:/%-]*[0-9][0-9.,:/%-]*$"), "num").when(~token.rlike(r"[\p{L}\p{N}]"), "punct").when(known, "hi-Latn").otherwise("en")


def sentences(text: Column) -> Column:
    """Sentences: cut after an end mark that white space follows; blank ones go."""
    return F.filter(F.transform(F.split(text, r"(?<=[।.?!])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase_cut(text: Column, most: Column) -> Column:
    """Where a text that is longer than ``most`` is best cut: after the last strong break that ends in the second half of ``most``
    characters, else the last weak one there, else the last space; 0 if there is none. Strong breaks stand after a comma, a semicolon or a verb that
    ends a clause and before a conjunction, weak ones after a postposition."""
    n, half = most.cast("string"), F.floor(most / 2).cast("int").cast("string")
    head = F.substr(text, F.lit(1), most + LONGEST)

    def upto(low: Column, mark: str) -> Column:
        return F.length(F.call_function("regexp_extract", head, F.concat(F.lit("(?s)^(.{"), low, F.lit(","), n, F.lit("})(?= )" + mark)), F.lit(1)))

    ends = lambda words: rf"(?<=(?:^|[ ])(?:{'|'.join(words)}))"
    strong = upto(half, rf"(?:(?<=[,;])|{ends(BREAK_AFTER)}|(?= (?:{'|'.join(BREAK_BEFORE)})(?: |$)))")
    return F.coalesce(F.nullif(strong, F.lit(0)), F.nullif(upto(half, ends(WEAK_AFTER)), F.lit(0)), upto(F.lit("1"), ""))


def _cut(part: Column, most: Column) -> Column:
    """Pieces of a part that is too long: cut by ``phrase_cut``, else hard, until the rest fits."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), part.alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        def at(k: Column) -> Column:
            head = F.trim(F.substr(acc["rest"], F.lit(1), F.when(k > 0, k).otherwise(most)))
            rest = F.trim(F.substr(acc["rest"], F.when(k > 0, k + 2).otherwise(most + 1), F.length(acc["rest"])))
            return F.struct(F.concat(acc["done"], F.array(head)).alias("done"), rest.alias("rest"))

        return F.when(F.length(acc["rest"]) <= most, acc).otherwise(_let(phrase_cut(acc["rest"], most), at))

    steps = F.size(F.split(part, " ")) + F.floor(F.length(part) / most).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: F.concat(acc["done"], F.array(acc["rest"])))


def chunks(text: Column, most) -> Column:
    """Pieces of at most ``most`` characters: whole sentences while they fit, else cut at commas, then at phrase breaks, then at spaces, then hard.

    A sentence that is too long is cut into clauses, and a clause that is too long into pieces; a fold packs the parts in their order. The rest of
    a long clause can be joined by what follows it. Null texts give null, blank ones no pieces.
    """
    most = F.lit(most) if isinstance(most, int) else most
    clause = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.split(s, r"(?<=[,;])\s+"))
    parts = F.flatten(F.transform(sentences(text), clause))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + F.length(p) + 1 <= most)
        grown = F.struct(acc["done"].alias("done"), F.trim(F.concat(acc["cur"], F.lit(" "), p)).alias("cur"))
        packed = F.when(fits, grown).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p.alias("cur")))
        before = F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        long = _let(_cut(p, most), lambda cut: F.struct(F.concat(before, F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("done"), F.element_at(cut, -1).alias("cur")))
        return F.when(F.length(p) > most, long).otherwise(packed)

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def stream_chunks(text: Column, most: int = 120, first: int = 60) -> Column:
    """Pieces of a reply as a voice takes them: each sentence on its own, in ``chunks``; the first piece is cut again to ``first`` characters,
    and what follows a first piece that ends no sentence to three times its length and 20. Pieces without a letter or digit join the one
    before, or go if there is none."""

    def opened(all_: Column) -> Column:
        one = F.get(all_, F.lit(0))
        rest = F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))
        short = lambda head: F.when(F.size(head) > 1, F.concat(F.slice(head, F.lit(1), F.lit(1)), F.array(F.array_join(F.slice(head, F.lit(2), F.size(head)), " ")), rest)).otherwise(F.concat(head, rest))
        return F.when(F.length(one) > first, _let(chunks(one, first), short)).otherwise(all_)

    def second(all_: Column) -> Column:
        one, two = F.get(all_, F.lit(0)), F.get(all_, F.lit(1))
        room = 3 * F.length(one) + 20
        rest = F.slice(all_, F.lit(3), F.greatest(F.size(all_) - 2, F.lit(0)))
        halved = lambda k: F.when(k > 0, F.concat(F.array(one, F.substr(two, F.lit(1), k), F.substr(two, k + 2, F.length(two))), rest)).otherwise(all_)
        long = (F.size(all_) > 1) & ~one.rlike(r"[।.?!][^\p{L}\p{N}_]*$") & (F.length(two) > room)
        return F.when(long, _let(phrase_cut(two, room), halved)).otherwise(all_)

    def glued(acc: Column, c: Column) -> Column:
        last = F.concat(F.element_at(acc, -1), F.lit(" "), c)
        joined = F.when(F.size(acc) > 0, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(last))).otherwise(acc)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.concat(acc, F.array(c))).otherwise(joined)

    every = F.flatten(F.transform(sentences(text), lambda s: chunks(s, most)))
    return F.aggregate(_let(_let(every, opened), second), F.expr("cast(array() as array<string>)"), glued)


def gap_class(text: Column) -> Column:
    """Class of a piece by its last mark, closing quotes and brackets aside."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), f"[{CLOSERS}]+$".replace("]}", r"\]}"), ""), r"\s+$", "")
    out = F
    for name, pattern in GAPS:
        out = out.when(bare.rlike(pattern), name)
    return out.otherwise("phrase")


def speakable(text: Column) -> Column:
    """Without bullets, markdown marks and emoji, spaces collapsed; empty if nothing can be spoken."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*([-•]|[0-9]+[.)])\s+", ""), r"[*#`\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]", "")
    out = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(out.rlike(r"[\p{L}\p{N}_]"), out).otherwise("")


def punct_variant(text: Column, mode: str) -> Column:
    """``danda``: commas become dandas; ``conjunction``: a comma before a conjunction that no mark precedes."""
    return F.replace(text, F.lit(","), F.lit("।")) if mode == "danda" else F.regexp_replace(text, r"([^,.;:!?।\s]) (and|but|because) ", "$1, $2 ")


def rewrite(text: Column, rules: list[tuple[str, str, str]], names: list[str]) -> Column:
    """Apply the named regex rules in the order of the table."""
    for name, pattern, new in rules:
        if name in names:
            text = F.regexp_replace(text, pattern, new)
    return text


def phoneme_list(rows: DataFrame, vocabulary: str, speaker: str, order: str, symbols: str, seconds: str, longest: float, least: int = 5) -> DataFrame:
    """Rows of at most ``longest`` seconds with symbols of a vocabulary only, ``least`` of them at least, and speakers numbered
    by their first row."""
    clean = rows.withColumn("kept", F.regexp_replace(symbols, f"[^{vocabulary}]", "")).where((F.col(seconds) <= longest) & (F.length("kept") >= least))
    firsts = clean.groupBy(speaker).agg(F.min(order).alias("_first"))
    numbered = firsts.select(speaker, (F.row_number().over(Window.orderBy("_first")) - 1).alias("speaker_no"))  # a row a speaker
    return clean.join(F.broadcast(numbered), speaker)
