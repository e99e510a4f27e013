"""Splits without leakage, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.operators.graph import connected_components


def draw(seed: int, name) -> Column:
    """Sort key of a seeded hash: twelve hex digits, which order like the number they are."""
    return F.substr(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(name).cast("string")), 256), F.lit(1), F.lit(12))


def leak_groups(rows: DataFrame, *keys: str, id_col: str = "id") -> DataFrame:
    """``rows`` with ``grp``: the smallest id (long) that equal values of any key connect a row with; null keys connect nothing."""
    edges = None
    for k in keys:
        first = rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_col).alias("_first"))
        e = rows.select(id_col, k).join(first, k).where(F.col(id_col) != F.col("_first")).select(F.col("_first").alias("src"), F.col(id_col).alias("dst"))
        edges = e if edges is None else edges.union(e)
    roots = connected_components(edges).select(F.col("node").alias(id_col), F.col("root").alias("_root"))
    return rows.join(roots, id_col, "left").withColumn("grp", F.coalesce("_root", id_col)).drop("_root")


def grouped_split(rows: DataFrame, seed: int = 1234, test: float = 0.05, val: float = 0.05, group: str = "grp") -> DataFrame:
    """``rows`` with ``split``: whole groups in the order of a seeded hash fill test, then val, then train.

    Sizes by group come first; they are summed by the hash's leading digits, and only those sums run over one partition.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", draw(seed, group)).withColumn("p", F.substr("h", F.lit(1), F.lit(3)))
    heads = sizes.groupBy("p").agg(F.sum("n").alias("pn"))
    total = heads.agg(F.sum("pn").alias("total"))
    before = F.coalesce(F.sum("pn").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = heads.select("p", before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("h", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("inside", inside).join(F.broadcast(base), "p").select(group, "n", (F.col("base") + F.col("inside")).alias("start")).crossJoin(F.broadcast(total))
    in_test = F.col("start") < test * F.col("total")
    n_test = placed.agg(F.coalesce(F.sum(F.when(in_test, F.col("n"))), F.lit(0)).alias("n_test"))
    named = placed.crossJoin(F.broadcast(n_test)).select(group, F.when(in_test, "test").when(F.col("start") - F.col("n_test") < val * F.col("total"), "val").otherwise("train").alias("split"))
    return rows.join(named, group)


def speaker_disjoint(rows: DataFrame, speaker: str, keys: list[str], seed: int = 1234, test: float = 0.05) -> DataFrame:
    """``rows`` with ``split``: test holds whole speakers in the order of a seeded hash, never the last one; rows of others that
    share a key with it are ``dropped``; the rest is ``pool``. Fewer than two speakers are an error."""
    sizes = rows.groupBy(speaker).agg(F.count("*").alias("n")).withColumn("h", draw(seed, speaker))
    w = Window.orderBy("h", speaker)  # a row a speaker
    ranked = sizes.withColumns({"start": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "after": F.lead("h").over(w), "total": F.sum("n").over(Window.partitionBy())})
    chosen = ranked.where(F.col("after").isNotNull() & (F.col("start") < test * F.col("total"))).select(speaker, F.lit(True).alias("_test"))
    marked = rows.join(F.broadcast(chosen), speaker, "left")
    out = marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("pool")).drop("_test")
    for k in keys:
        held = out.where("split = 'test'").select(F.col(k).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(True))
        out = out.join(held, F.col(k) == F.col("_k"), "left").withColumn("split", F.when((F.col("split") != "test") & F.col("_hit"), "dropped").otherwise(F.col("split"))).drop("_k", "_hit")
    return out


def hash_split(key: Column, val: float = 0.02, test: float = 0.02) -> Column:
    """Split by CRC32 of a key: reproducible by row, but texts can be on both sides."""
    x = F.crc32(key.cast("binary")) % 10_000 / 10_000
    return F.when(x < test, "test").when(x < test + val, "val").otherwise("train")


def stratified(rows: DataFrame, n: int, category: str, sub: str, id_col: str, seed: int = 0) -> DataFrame:
    """About ``n`` rows: each category's share (one at least), taken in turn from its subcategories, in a seeded order.

    Ranks within a subcategory come from a hash; only a subcategory's first ``n`` rows can be taken, so no more are ranked
    against each other in their category.
    """
    counts = rows.groupBy(category).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    quota = counts.crossJoin(F.broadcast(total)).select(category, F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_c") / F.col("_t"))).cast("int").alias("_quota"))
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256)
    first = F.row_number().over(Window.partitionBy(category, sub).orderBy(h))
    some = rows.withColumn("_r", first).where(F.col("_r") <= n)
    turn = F.row_number().over(Window.partitionBy(category).orderBy("_r", sub))
    return some.withColumn("_turn", turn).join(F.broadcast(quota), category).where("_turn <= _quota").drop("_r", "_turn", "_quota")


def corpus_counts(rows: DataFrame, category: str, sub: str, listed: list[str]) -> DataFrame:
    """Counts in all, by category, by category and subcategory, and of each listed subcategory, zeros too."""
    rolled = rows.rollup(category, sub).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "subcategory").when(F.col("g") == 1, "category").otherwise("total")
    name = F.when(F.col("g") == 0, F.concat_ws("/", category, sub)).when(F.col("g") == 1, F.col(category)).otherwise("all")
    names = rows.sparkSession.createDataFrame([(x,) for x in listed], "name string")
    found = rows.groupBy(F.col(sub).alias("name")).agg(F.count("*").alias("n"))
    fixed = F.broadcast(names).join(found, "name", "left").select(F.lit("listed").alias("level"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    return rolled.select(level.alias("level"), name.alias("name"), "n").union(fixed)
