"""Quality by votes of the nearest labelled documents in a latent semantic space.

A text's terms are its pairs of neighbouring bytes (folded to ``TERMS`` buckets) and a few terms for its shape: length
class, share of distinct words, stuttering, repeated lines, symbols, capitals, digits. Term counts are damped, weighted by rarity, and projected to
``DIMENSIONS`` by a truncated singular value decomposition of a bounded labelled sample. The sample's vectors and labels are
broadcast. Every document is compared with all of them: exact cosines by blocked matrix products, the ``NEIGHBOURS`` nearest
vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vocalith.llm.labels import held_out, sample

#: Labelled rows that are learned from, at most; they bound the broadcast.
SAMPLE_ROWS = 4_096
TERMS, SHAPES, DIMENSIONS, NEIGHBOURS, BLOCK = 4_096, 24, 48, 15, 1_024
FOLD = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7) & np.uint64(TERMS - 1)).astype(np.int64)
#: Symbols, capitals and digits among the bytes.
KIND = np.array([1 if chr(b) in "#*$%&|<>!=_~^{}[]\\" else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 0 for b in range(256)])
#: Weight of the shape terms against the damped counts.
SHAPE_WEIGHT = 3.0


def terms(text: bytes | None) -> np.ndarray:
    """Damped term counts: never all zero, as every text has a length class."""
    out = np.zeros(TERMS + SHAPES, np.float32)
    raw = np.frombuffer(text or b"", np.uint8)
    if len(raw) > 1:
        pairs = raw[:-1].astype(np.int64) << 8
        pairs |= raw[1:]
        counts = np.bincount(FOLD[pairs], minlength=TERMS) * (1000.0 / len(raw))
        out[:TERMS] = np.log1p(counts)
        out[:TERMS] /= np.linalg.norm(out[:TERMS])
    w = (text or b"").split()
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    n = len(w)
    shape = out[TERMS:]
    shape[min(15, int(2 * np.log2(1 + n)) // 2)] = 0.5
    shape[16] = sum(map(eq, w, w[1:])) / max(1, n)
    shape[17] = 1 - len(set(lines)) / max(1, len(lines))
    shape[18] = max(0.0, 0.5 - len(set(w)) / n) if n else 0.0
    shape[19] = float(n < 20) / 2
    kinds = np.bincount(KIND[raw], minlength=4) / max(1, len(raw))
    shape[20:23] = np.sqrt(kinds[1:])
    shape *= SHAPE_WEIGHT
    return out


class Space:
    """Rarity weights, projection, and the labelled vectors (unit length)."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, seed: int = 7):
        rows = len(counts)
        self.rarity = np.ones(TERMS + SHAPES, np.float32)
        self.rarity[:TERMS] = np.log((1 + rows) / (1 + (counts[:, :TERMS] > 0).sum(axis=0))) + 1
        x = counts * self.rarity
        rank = min(DIMENSIONS, rows)
        q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        for _ in range(4):  # subspace iteration, then the small exact decomposition
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.project = (q @ vt[:rank].T).astype(np.float32)
        self.vectors, self.labels = self._unit(x @ self.project), labels.astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        cosine = self._unit((counts * self.rarity) @ self.project) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6)
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def fit(documents: DataFrame, labels: DataFrame, text_col: str = "text", label: str = "quality") -> Space | None:
    """The space of at most ``SAMPLE_ROWS`` labelled rows that are not held out; None without any."""
    rows = sample(documents, labels, label, SAMPLE_ROWS, text_col)

    @F.pandas_udf("binary")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t).astype(np.float16).tobytes() for t in texts])

    got = rows.select("label", counted(F.col("text").cast("binary")).alias("v")).collect()  # bounded by SAMPLE_ROWS
    if not got:
        return None
    got.sort(key=lambda r: (bytes(r.v), r.label))
    return Space(np.stack([np.frombuffer(r.v, np.float16) for r in got]).astype(np.float32), np.array([r.label for r in got]))


def score(documents: DataFrame, space: Space | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``documents`` with ``out``, the weighted share of votes for label 1, between 0 and 1; 0.5 without any labelled row.

    Null and empty texts are compared by their length class. Equal and repeated texts score alike to 2e-7, which batches of other sizes can
    change; which of equally near neighbours votes is not defined. Other columns pass through, and ``out`` replaces a column of
    that name. Memory is bounded by ``BLOCK`` rows at a time, however long their texts. An empty table gives an empty one.
    """
    if space is None:
        return documents.withColumn(out, F.lit(0.5))
    shared = documents.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [shared.value.vote(np.stack([terms(t) for t in batch[at : at + BLOCK]])) for at in range(0, len(batch), BLOCK)]
            yield pd.Series(np.concatenate(parts).astype(float) if parts else [], dtype=float)

    return documents.withColumn(out, voted(F.col(text_col).cast("binary")))


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from quality labels of those that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(documents, fit(documents, labels)).select("doc_id", held_out().alias("held_out"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
