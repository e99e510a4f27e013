"""Near copies by their sets of five-word shingles: pairs with a Jaccard similarity of 0.8 or more are linked.

SimHash fingerprints of the sets come first: those within two bits meet in the segment-popcount grids of ``simhash``, and are verified on the
whole sets. That joins most copies, but fingerprints of sets with a similarity of 0.8 can be ten bits apart, where no grid is cheap. So the
sets also meet by the bands of ``minhash``, with the same verification; its crowded buckets, templates and skew are handled there. A
similar pair shares neither a grid cell nor a band five times in a million at a similarity of 0.8, and less often above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vocalith.llm import minhash, simhash
from vocalith.llm.simhash import first_of
from vocalith.operators.graph import connected_components
from vocalith.operators.skew import lookup
from vocalith.plans.scratch import materialize

WORDS = 5


def _by_print(rows: DataFrame) -> DataFrame:
    """Pairs (src, dst) of sets: each with the least of its fingerprint, and the least ones of fingerprints within two bits."""
    known = rows.where("print is not null").select("print", "fp").distinct()
    heads = materialize(known.groupBy("print").agg(F.min("fp").alias("head"), F.count("*").alias("n")), "heads")
    twins = known.join(heads.where("n > 1"), "print").where("fp <> head").select(F.col("head").alias("src"), F.col("fp").alias("dst"))
    near = simhash.links(heads.select(F.col("print").alias("fp")))
    head = lambda x: heads.select(F.col("print").alias(x), F.col("head").alias(f"h{x}"))
    met = near.join(head("src"), "src").join(head("dst"), "dst").select(F.least("hsrc", "hdst").alias("src"), F.greatest("hsrc", "hdst").alias("dst"))
    return twins.union(met)


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each component of near copies: the one with its smallest id, then with the smallest hash
    of its text. Null, empty and blank texts are copies of each other; of equal rows one stays; long texts are compared whole.
    Columns, rows and texts are otherwise as they came, whatever the columns' names. An empty table gives an empty one.
    """
    rows = minhash.signatures(documents, id_col, text_col, WORDS, prints=True)
    roots = connected_components(minhash.links(rows, documents, text_col, WORDS, _by_print(rows))).withColumnRenamed("node", "fp")
    prints = rows.select("id", "tie", F.coalesce("fp", F.lit(0)).alias("fp"))
    nodes = prints.groupBy("fp").agg(F.count("*").alias("n"))
    table = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")
    return first_of(documents, lookup(prints, table, "fp", "n"), prints, id_col, text_col)
