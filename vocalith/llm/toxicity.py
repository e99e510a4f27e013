"""Toxicity severity by cumulative-link ordinal regression over sparse text features: words and their first letters.

P(grade > k) = sigmoid(w.x - t_k): one weight vector for all thresholds t_0 < t_1 < ..., which are kept in order by learning
the logarithms of their gaps. The output is the expected severity, the sum of P(grade > k).

Grades are whatever ordered numbers from 0 the labels hold. The query's labels say toxic or not and of good quality or not;
``graded`` makes 0 (not toxic), 1 (toxic, of low quality) and 2 (toxic, of good quality) of them, from the labels alone: other
filters catch toxic junk, and toxic prose that reads well does the most harm. The fit takes at
most ``SAMPLE_ROWS`` labelled rows; features are all words and stems of theirs that tell toxic rows apart by a log-odds test.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vocalith.llm.labels import sample
from vocalith.llm.native import unused

SAMPLE_ROWS = 20_000
#: How rare sides weigh: 0 like all others, 1 as much as the other side in sum.
BALANCE = 0.25
#: Rows whose words a step of the fit holds at once.
PART = 1_000
#: Besides whole words, their first 4, 6 and 7 letters are features, which meet inflected forms.
STEMS = (4, 6, 7)
#: A word or stem is a feature from this standard score of its log-odds, and in this many rows.
LEAST_Z, LEAST_ROWS = 3.0, 3
LETTERS = re.compile(r"[^\W\d_]+").findall
SCORE = "expected_severity double, p_toxic double, grade int"


def counts_of(text: str | None, number: dict[str, int]) -> Counter:
    """Counts of the features that ``number`` knows. A stem's key is its length and its letters."""
    words = LETTERS(text.lower()) if text else []
    found = Counter(map(number.get, words))
    for n in STEMS:
        found.update(map(number.get, [f"{n}{w[:n]}" for w in words]))
    found.pop(None, None)
    return found


def graded(labels: DataFrame) -> Column:
    """Severity of the columns ``toxic`` and, if there, ``quality``: 0, 1, or 2 where quality is good. Null for a null ``toxic``."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(good, 2).otherwise(1))


def _stem(n: int):
    return lambda x: F.concat(F.lit(str(n)), F.left(x, F.lit(n)))


class Model:
    """Words, their shared weights, and ordered thresholds."""

    def __init__(self, words: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.number, self.weights, self.cuts = {w: k for k, w in enumerate(words)}, weights, cuts

    def linear(self, text: str | None) -> float:
        found = counts_of(text, self.number)
        return float(sum(self.weights[k] * log1p(n) for k, n in found.items()))

    def severity(self, linear: np.ndarray) -> pd.DataFrame:
        above = 1 / (1 + np.exp(-np.clip(linear[:, None] - self.cuts[None, :], -50, 50)))
        return pd.DataFrame({"expected_severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(axis=1).astype(np.int32)})


def marked_words(rows: DataFrame) -> list[tuple[str, float]]:
    """Words of a bounded sample (text, label) that tell labels above 0 apart, with their log-odds."""
    up = (F.col("label") > 0).cast("int").alias("label")
    total = rows.agg(F.count("*").alias("n"), F.sum(up).alias("toxic")).first()
    n, toxic = total.n, total.toxic or 0
    each = rows.select(up, F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    stems = [F.transform("w", _stem(n)) for n in STEMS]
    words = each.select("label", F.explode(F.array_distinct(F.concat("w", *stems))).alias("word"))
    counted = words.groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("both")).where(f"both >= {LEAST_ROWS}")
    a, b = F.col("a") + 0.5, F.col("both") - F.col("a") + 0.5
    out_a, out_b = F.lit(float(toxic)) + 1 - a, F.lit(float(n - toxic)) + 1 - b
    odds = F.log(a / out_a) - F.log(b / out_b)
    scored = counted.select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b + 1 / out_a + 1 / out_b)).alias("z"))
    return sorted((r.word, r.odds) for r in scored.where(F.abs("z") >= LEAST_Z).collect())  # words of SAMPLE_ROWS rows


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 500, l2: float = 2e-4):
    """Weights and thresholds of sparse rows (``rows`` ascending) by full-batch gradient steps (Adam) on the cumulative-link likelihood.

    P(grade = j) = a - b with a = P(grade > j - 1) and b = P(grade > j); its logarithm has the slope 1 - a - b in w.x. Rows
    count by how rare their side (grade 0 or above) is, to the power ``BALANCE``.
    """
    n, up, levels = len(grades), grades > 0, int(grades.max())
    share = np.where(up, up.mean(), 1 - up.mean())
    each = (0.5 / share) ** BALANCE
    each /= each.sum()
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(levels - 1)])
    ends = np.searchsorted(rows, np.arange(0, n + PART, PART))  # rows ascend; a part at a time bounds what a step holds
    parts = [(rows[a:b] - at, cols[a:b], values[a:b], min(PART, n - at)) for at, a, b in zip(range(0, n, PART), ends, ends[1:])]
    m, v, row = np.zeros_like(p), np.zeros_like(p), np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        cuts = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        linear = np.concatenate([np.bincount(r, v * w[c], k) for r, c, v, k in parts])
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(linear[:, None] - cuts, -40, 40))), np.zeros((n, 1))], axis=1)
        a, b = above[row, grades], above[row, grades + 1]
        chance = np.maximum(a - b, 1e-12)
        slope = (1 - a - b) * each
        by_cut = np.bincount(grades, a * (1 - a) / chance * each, levels + 1)[1:] - np.bincount(grades, b * (1 - b) / chance * each, levels + 1)[:-1]
        by_gap = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        by_word = sum(np.bincount(c, v * slope[at : at + PART][r], n_features) for at, (r, c, v, _) in zip(range(0, n, PART), parts, strict=True))
        grad = np.concatenate([l2 * w - by_word, [by_cut.sum()], by_gap])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def fit(documents: DataFrame, labels: DataFrame, text_col: str = "text", grade: str | Column | None = None) -> Model:
    """A model from labelled documents that are not held out; ``grade`` is a column of ``labels`` or an expression over it,
    ``graded`` if it is not given. Without rows above 0, or without other rows, nothing is rejected."""
    rows = sample(documents, labels, graded(labels) if grade is None else grade, SAMPLE_ROWS, text_col)
    marked = marked_words(rows)
    blank = Model([w for w, _ in marked], np.zeros(len(marked)), np.array([50.0]))
    if not marked:
        return blank
    number = blank.number

    @F.pandas_udf("struct<cols:binary,counts:binary>")
    def vector(texts: pd.Series) -> pd.DataFrame:
        found = [counts_of(t, number) for t in texts]
        return pd.DataFrame({"cols": [np.array(list(c), "<i4").tobytes() for c in found], "counts": [np.log1p(np.array(list(c.values()), "<f4")).tobytes() for c in found]})

    got = rows.select("label", vector("text").alias("v")).select("label", "v.*").toPandas()  # SAMPLE_ROWS rows at most
    y = got["label"].to_numpy().astype(np.int64)
    if not 0 < (y > 0).sum() < len(y):
        return blank
    y = np.unique(y, return_inverse=True)[1]  # grades that no row has are no thresholds
    at = np.repeat(np.arange(len(got), dtype=np.int32), got["cols"].map(len) // 4)
    cols, counts = np.frombuffer(b"".join(got["cols"]), "<i4"), np.frombuffer(b"".join(got["counts"]), "<f4")
    weights, cuts = fit_ordinal(at, cols, counts, y, len(marked))
    return Model([w for w, _ in marked], weights, cuts)


def score(documents: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``documents`` with a struct ``out``: expected_severity (0 to the number of thresholds), p_toxic and grade.

    Null, empty and wordless texts have no features: they get the severity of the thresholds alone, which is near 0. Equal
    texts score equally, and long ones are read whole; other columns pass through, and ``out`` replaces a column of that
    name. An empty table gives an empty one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # words of SAMPLE_ROWS rows

    @F.pandas_udf(SCORE)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            yield m.severity(np.array([m.linear(t) for t in batch], dtype=float))

    return documents.withColumn(out, scored(text_col))


def reject(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` without those whose severity is more likely above 0 than not. Nulls, empty and wordless texts stay, equal
    rows stay or go together, long texts are read whole, and columns pass through whatever their names."""
    own = unused("_toxicity", documents.columns)
    found = score(documents, fit(documents, labels, text_col), text_col, own)
    return found.where(F.col(f"{own}.p_toxic") < 0.5).select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents, learned from the labels of those that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(documents, fit(documents, labels)).select("doc_id", "toxicity.*")
    return found.withColumn("rejected", F.col("p_toxic") >= 0.5)
