"""Document frequency, IDF and TF-IDF on long-form bags.

Per-document sums use windows over the id partitioning the bag already has,
so they add no exchange. The corpus size N is a scalar subquery (one job, one
number), never a driver-side loop. The IDF table is joined on ``term``; AQE
turns that join into a broadcast only when the measured vocabulary is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def doc_count(bag: DataFrame, id_col: str):
    """Number of documents with a non-empty bag, as a scalar-subquery column."""
    return bag.select(F.count_distinct(id_col)).scalar()


def document_frequency(bag: DataFrame) -> DataFrame:
    """``(term, df)``: number of documents containing each term."""
    return bag.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_raw(bag: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(term, df, idf)`` with idf = ln(N / (1 + df)): 0 at df = N-1, negative at df = N."""
    n = doc_count(bag, id_col)
    return document_frequency(bag).withColumn(
        "idf", F.log(n.cast("double") / (F.col("df") + 1)))


def tfidf_raw(bag: DataFrame, id_col: str = "doc_id", idf: DataFrame | None = None,
              carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, term, weight, *carry)`` = (tf / sum tf of the document) * idf.

    ``carry`` names extra per-term columns of ``idf`` to keep (e.g. a term hash
    computed once per vocabulary entry).
    """
    idf = idf if idf is not None else idf_raw(bag, id_col)
    total = F.sum("tf").over(Window.partitionBy(id_col))
    shares = bag.select(id_col, "term", (F.col("tf") / total).alias("_share"))
    return (shares.join(idf.select("term", "idf", *carry), "term")
            .select(id_col, "term",
                    (F.col("_share") * F.col("idf")).alias("weight"), *carry))


def tfidf_l2(bag: DataFrame, id_col: str = "doc_id", min_token_len: int = 2) -> DataFrame:
    """Smoothed, L2-normalised TF-IDF ``(id, term, w)``.

    idf = ln((1 + N) / (1 + df)) + 1 with N = documents with a non-empty bag
    (including those whose terms are all shorter than ``min_token_len``, which
    become zero vectors and therefore have no row); w = tf * idf / ||tf * idf||.
    """
    n = doc_count(bag, id_col)
    kept = bag.filter(F.length("term") >= min_token_len)
    dfreq = document_frequency(kept).withColumn(
        "idf", F.log((n.cast("double") + 1) / (F.col("df") + 1)) + 1)
    raw = kept.join(dfreq.select("term", "df", "idf"), "term").select(
        id_col, "term", "df", (F.col("tf") * F.col("idf")).alias("_r"))
    norm = F.sqrt(F.sum(F.col("_r") * F.col("_r")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", "df", (F.col("_r") / norm).alias("w"))
