"""Blinded listening tests: plans, sheets, and what the ratings say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.operators.evaluation import draws, met_draws
from vocalith.plans.scratch import materialize


def token(seed: int, *parts: str) -> Column:
    """Blind id of a cell: eight hex digits of a seeded hash."""
    return F.substr(F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256), F.lit(1), F.lit(8))


def shuffled(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def ab_plan(items: DataFrame, item: str, n: int, hidden: int, seed: int) -> DataFrame:
    """``n`` items by a seeded order with a seeded side for system A, ``hidden`` of them again with sides swapped, numbered in
    another seeded order. Columns: no, item, a_left, repeat_of (the item, for repeats)."""
    picked = items.select(F.col(item).alias("item")).distinct().withColumn("h", shuffled(seed, "item")).orderBy("h", "item").limit(n)
    sides = picked.withColumns({"a_left": F.substr(shuffled(seed + 1, "item"), F.lit(1), F.lit(1)) < "8", "r": F.row_number().over(Window.orderBy("h", "item"))})  # n rows
    again = sides.where(F.col("r") <= hidden).select("item", (~F.col("a_left")).alias("a_left"), F.col("item").alias("repeat_of"))
    both = sides.select("item", "a_left", F.lit(None).cast(dict(items.dtypes)[item]).alias("repeat_of")).union(again)
    order = F.md5(F.concat_ws("|", F.lit(str(seed + 2)), "item", F.coalesce(F.col("repeat_of").cast("string"), F.lit("-"))))
    return both.withColumn("no", F.row_number().over(Window.orderBy(order, "item")))  # n + hidden rows


def rating_plan(items: DataFrame, systems: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rating stimuli (item, system, id) and pairwise stimuli (item, a, b, id), each with a blind id; the key is kept apart."""
    cells = items.crossJoin(F.broadcast(systems)).withColumn("id", token(seed, "item", "system"))
    a, b = systems.withColumnRenamed("system", "a"), systems.withColumnRenamed("system", "b")
    pairs = items.crossJoin(F.broadcast(a.join(F.broadcast(b), F.col("a") < F.col("b")))).withColumn("id", token(seed, "item", "a", "b"))
    return cells, pairs


def clashes(stimuli: DataFrame) -> DataFrame:
    """Blind ids that more than one stimulus has."""
    return stimuli.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def sheets(stimuli: DataFrame, listeners: DataFrame, seed: int) -> DataFrame:
    """Each listener's own order of the same stimuli: listener, id, no."""
    order = Window.partitionBy("listener").orderBy(shuffled(seed, "listener", "id"), "id")
    return listeners.crossJoin(stimuli.select("id")).withColumn("no", F.row_number().over(order))


def bad_cells(scores: DataFrame, keys: list[str], dims: list[str], allowed: list[str]) -> DataFrame:
    """Cells outside the allowed values; blank is allowed."""
    long = scores.unpivot(keys, dims, "dim", "value")
    return long.where((F.trim("value") != "") & ~F.col("value").isin(*allowed))


def unblind(scores: DataFrame, key: DataFrame, dims: list[str]) -> DataFrame:
    """Picks by system: ``scores`` (listener, id, dims with A, B, tie or blank), ``key`` (id, item, a, b)."""
    long = scores.unpivot(["listener", "id"], dims, "dim", "pick").where("coalesce(pick, '') <> ''")
    return long.join(F.broadcast(key), "id").withColumn("winner", F.when(F.col("pick") == "A", F.col("a")).when(F.col("pick") == "B", F.col("b")).otherwise("tie"))


def sign_test(wins: Column, n: Column) -> Column:
    """Two-sided exact binomial p of ``wins`` of ``n`` fair picks: 1 for none, at most 1. Terms follow from each other, in
    logarithms, so that no factorial is needed."""
    k = F.least(wins, n - wins).cast("int")
    start = F.struct((n * F.lit(-0.6931471805599453)).alias("log"), F.lit(0.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((acc["log"] + F.log((n - i) / (i + 1))).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), k), start, add, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def repeat_consistency(picks: DataFrame) -> DataFrame:
    """Per listener: picks of hidden repeats (item, repeat_of, winner, dim) that name the same system as the first time."""
    a = picks.where("repeat_of is null").select("listener", "dim", F.col("item").alias("repeat_of"), F.col("winner").alias("first"))
    met = picks.where("repeat_of is not null").join(a, ["listener", "dim", "repeat_of"])
    return met.groupBy("listener").agg(F.count("*").alias("n"), F.count_if(F.col("winner") == F.col("first")).alias("same"))


def rating_means(ratings: DataFrame, b: int, seed: int = 0) -> DataFrame:
    """Per dimension and system: mean, and an interval that resamples items (ratio of sums). ``ratings``: item, system, dim, value."""
    by_item = ratings.groupBy("system", "dim", "item").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    w = Window.partitionBy("system", "dim")
    placed = materialize(by_item.withColumns({"k": F.row_number().over(w.orderBy("item")) - 1, "n": F.count("*").over(w)}), "placed")
    boot = met_draws(draws(placed, b, seed, "system", "dim"), placed.select("system", "dim", "k", "s", "c"), "system", "dim", "k").groupBy("system", "dim", "b").agg((F.sum("s") / F.sum("c")).alias("m"))
    ci = boot.groupBy("system", "dim").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    mean = by_item.groupBy("system", "dim").agg((F.sum("s") / F.sum("c")).alias("mean"), F.count("*").alias("n_items"))
    return mean.join(ci, ["system", "dim"]).select("system", "dim", "mean", "n_items", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))


def pair_diffs(ratings: DataFrame, least: int = 3) -> DataFrame:
    """Per pair of systems and dimension: mean difference of item means over common items, of which there must be ``least``."""
    m = ratings.groupBy("system", "dim", "item").agg(F.avg("value").alias("v"))
    x, y = m.select(F.col("system").alias("a"), "dim", "item", F.col("v").alias("va")), m.select(F.col("system").alias("b"), "dim", "item", F.col("v").alias("vb"))
    return x.join(y, ["dim", "item"]).where("a < b").groupBy("a", "b", "dim").agg(F.count("*").alias("n"), F.avg(F.col("va") - F.col("vb")).alias("diff")).where(F.col("n") >= least)


def anchor_failures(ratings: DataFrame, anchor: str) -> DataFrame:
    """Listeners whose mean for the anchor is at least that of their lowest system."""
    m = ratings.groupBy("listener", "system").agg(F.avg("value").alias("m"))
    each = m.groupBy("listener").agg(F.max(F.when(F.col("system") == anchor, F.col("m"))).alias("anchor"), F.min(F.when(F.col("system") != anchor, F.col("m"))).alias("lowest"))
    return each.withColumn("flagged", F.col("anchor") >= F.col("lowest"))


def bonferroni(picks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per unordered pair and dimension: wins, ties, sign test, and whether it holds at alpha over the number of tests."""
    pair = F.array_sort(F.array("a", "b"))
    each = picks.withColumns({"x": F.get(pair, F.lit(0)), "y": F.get(pair, F.lit(1))}).groupBy("x", "y", "dim").agg(
        F.count_if(F.col("winner") == F.col("x")).alias("x_wins"), F.count_if(F.col("winner") == F.col("y")).alias("y_wins"), F.count_if(F.col("winner") == "tie").alias("ties"))
    tests = each.agg(F.count("*").alias("n_tests"))
    p = sign_test(F.col("x_wins"), F.col("x_wins") + F.col("y_wins"))
    return each.crossJoin(F.broadcast(tests)).withColumn("p", p).withColumn("significant", F.col("p") < alpha / F.col("n_tests"))
