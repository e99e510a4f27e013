"""SimHash near-duplicates by a grid range join over segment popcounts.

Method: a 64-bit fingerprint is cut into 32 segments of two bits, and each segment becomes its bit count (0, 1, 2), held
as a thermometer code (00, 01, 11), so that the Manhattan distance of two such vectors is the bit count of their XOR. One
differing bit moves one coordinate by at most one: the Manhattan distance is a lower bound of the Hamming distance. The
range join puts the coordinates into ``distance + 2`` blocks. Vectors within ``distance`` differ in at most that many
blocks, so they agree in some pair of blocks; each pair of blocks is one grid with cells of side one, and only
fingerprints of one cell meet. The join condition first compares the Manhattan distances, then the fingerprints.

Cells with many fingerprints (a large family of near copies) would meet pair by pair. For these, and only these, each
fingerprint is filed under itself and its 64 one-bit neighbours: at distance 2 or less two fingerprints share such a file,
and those that share one are within 2. Each file links its members to its smallest one: the same components from 65 rows
a fingerprint, however large the cell.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from vocalith.llm.native import unused
from vocalith.operators.graph import connected_components
from vocalith.operators.skew import lookup
from vocalith.plans.scratch import materialize

#: A-Z to a-z in UTF-8; no other byte changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once: 64 bytes each.
BLOCK = 1 << 15
#: The low bit of each two-bit segment.
LOW_BITS = 0x5555555555555555
BLOCKS = 4
#: Fingerprints of a cell that still meet pair by pair.
DENSE = 256


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer."""
    w = text.translate(LOWER).split() if text else []
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*(w[k:] for k in range(words))))) if len(w) >= words else [b" ".join(w)]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        part = b"".join([digest(s, seed) for s in shingles[at : at + BLOCK]])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def majority(s: np.ndarray) -> int:
    """SimHash of an array of 64-bit hashes, as a signed integer: bits that are set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), BLOCK):
        ones += np.unpackbits(s[at : at + BLOCK].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s)).view(">i8")[0])


def fingerprint_column(text, words: int = 3):
    """Column of fingerprints (long) of a text column: nulls, empty and blank texts give 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs within ``distance`` (1 or 2) bits; ``prints.fp`` is unique.

    Cells of up to ``DENSE`` fingerprints give every such pair; larger ones give enough of them to connect the rest.
    """
    if distance not in (1, 2):
        raise ValueError("the grid and the one-bit files are laid out for 1 or 2 bits")
    low = F.lit(LOW_BITS)
    first, second = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    both, any_ = first.bitwiseAND(second), first.bitwiseOR(second)
    embedded = prints.select("fp", any_.bitwiseOR(F.shiftleft(both, 1)).alias("v"))
    bits = 64 // BLOCKS
    masks = [_signed(sum(((1 << bits) - 1) << (bits * k) for k in ab)) for ab in combinations(range(BLOCKS), 2)]
    cells = embedded.select("fp", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    crowd = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = cells.join(crowd, ["grid", "cell"])
    few, many = met.where(F.col("n") <= DENSE), met.where(F.col("n") > DENSE)
    a, b = few.alias("a"), few.alias("b")
    near = (
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.v").bitwiseXOR(F.col("b.v"))) <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    )
    pairs = a.join(b, near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    files = many.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("file"))
    if distance == 1:  # a file holds both ends of a pair only if it is one of them
        files = files.where(F.col("fp") != F.col("file")).select(F.col("fp").alias("src"), F.col("file").alias("dst"))
        stars = files.join(prints.select(F.col("fp").alias("dst")), "dst", "left_semi").select("src", "dst")
    else:
        firsts = files.groupBy("file").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").select("file", "src")
        stars = files.join(firsts, "file").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return pairs.union(stars).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``documents``: its id, ``fp`` (long) and ``component_id``, the smallest id it is linked to.

    Null, empty and blank texts have fingerprint 0 and link like any other; texts of fewer than ``words`` words are one
    shingle. Null ids get a component but never name one, unless all its ids are null (then the id is null). Repeated
    rows stay. Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    prints = materialize(documents.select(F.col(id_col).alias("id"), fingerprint_column(text_col, words).alias("fp")), "prints")
    return components(prints, distance).select(F.col("id").alias(id_col), "fp", "component_id")


def components(prints: DataFrame, distance: int = 2) -> DataFrame:
    """``prints`` (id, fp and more) with ``component_id``; it is read twice, so pass a written table."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(nodes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    linked = nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return lookup(prints, linked.join(least, "root").select("fp", "root", "component_id", "n"), "fp", "n")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``documents`` with one row of each component: the one with its smallest id, then with the smallest hash of its text.

    Columns, rows and texts are otherwise as they came, whatever the columns' names. Null, empty and blank texts are copies of each other, long
    texts are read whole. Null ids come last in a component; of repeated equal rows one stays. An empty table gives an empty one.
    """
    keys = documents.select(F.col(id_col).alias("id"), fingerprint_column(text_col, words).alias("fp"), F.xxhash64(text_col).alias("tie"))
    prints = materialize(keys, "prints")
    return first_of(documents, components(prints, distance), prints, id_col, text_col)


def first_of(documents: DataFrame, found: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``documents`` with one row of each ``root`` of ``found`` (id, tie, root), for ``keep_first``."""
    best = found.groupBy("root").agg(F.min_by(F.struct("id", "tie"), F.struct(F.col("id").isNull(), "id", "tie")).alias("k"))
    tie, rank = (unused(x, documents.columns) for x in ("_tie", "_rank"))
    on = F.col(f"d.{id_col}").eqNullSafe(F.col("k.k.id")) & (F.col(f"d.{tie}") == F.col("k.k.tie"))
    kept = documents.withColumn(tie, F.xxhash64(text_col)).alias("d").join(best.alias("k"), on, "left_semi")
    if not prints.groupBy("id", "tie").count().where("count > 1").limit(1).count():
        return kept.select(*documents.columns)
    whole = F.xxhash64(*[c for c, kind in documents.dtypes if not kind.startswith("map")])  # equal in id and text: the first by all columns
    order = Window.partitionBy(id_col, tie).orderBy(text_col, whole)  # only where rows repeat: a second shuffle
    return kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two bits or fewer, over all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
