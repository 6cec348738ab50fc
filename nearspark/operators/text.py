"""Text preparation: pages/documents -> long-form bags of words ``(id, term, tf)``.

Plan shape: texts are hash-partitioned by id once, so tokenising, counting and
every later per-document aggregate run without another exchange. (A text is
smaller than its bag as rows, so the text is what moves; of pages it is the
extracted text.) Cleaning,
splitting and stop-word removal are JVM expressions; stop words are an
``InSet`` (hash lookup). Only HTML field extraction and stemming use Python:
field extraction per page (Arrow batches), stemming once per distinct term of a worker.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspark.functions import text as tx
from nearspark.functions.html import extract_fields as _extract_one
from nearspark.functions.porter import stem_word

FIELDS_TYPE = T.StructType([T.StructField("heavy", T.StringType()),
                            T.StructField("light", T.StringType())])


@F.pandas_udf(FIELDS_TYPE)
def _extract_fields_udf(html: pd.Series) -> pd.DataFrame:
    pairs = [_extract_one(h) for h in html]
    return pd.DataFrame({"heavy": [p[0] for p in pairs], "light": [p[1] for p in pairs]})


@F.pandas_udf(T.StringType())
def _stem_udf(words: pd.Series) -> pd.Series:
    return pd.Series([stem_word(w) for w in words])


def extract_fields(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``heavy`` and ``light`` text columns extracted from HTML."""
    return (pages.withColumn("_f", _extract_fields_udf(F.col(html_col)))
            .withColumn("heavy", F.col("_f.heavy"))
            .withColumn("light", F.col("_f.light"))
            .drop("_f"))


def page_text(pages: DataFrame, id_col: str = "url", html_col: str = "html",
              weight: bool = False) -> DataFrame:
    """HTML pages -> ``(id, text)`` with heavy text doubled when ``weight``."""
    fields = extract_fields(pages.select(id_col, html_col), html_col)
    return fields.select(
        id_col,
        tx.combine_fields(tx.clean_text(F.col("heavy")), tx.clean_text(F.col("light")),
                          weight).alias("text"))


def token_rows(docs: DataFrame, id_col: str, text_col: str, stopwords=None,
               partitions: int | None = None, prepartition: bool = True) -> DataFrame:
    """One row per kept token: ``(id, term)``, duplicates kept."""
    stop = tx.default_stopwords() if stopwords is None else tuple(stopwords)
    base = docs.select(F.col(id_col), F.col(text_col))
    if prepartition:
        base = (base.repartition(partitions, id_col) if partitions
                else base.repartition(id_col))
    exploded = base.select(
        F.col(id_col), F.explode(tx.tokens(tx.clean_text(F.col(text_col)))).alias("term"))
    if stop:
        exploded = exploded.filter(~F.col("term").isin(list(stop)))
    return exploded


def bag_of_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 stopwords=None, stem: bool = False, partitions: int | None = None,
                 prepartition: bool = True) -> DataFrame:
    """Long-form bag ``(id, term, tf)``; documents with no token have no row."""
    toks = token_rows(docs, id_col, text_col, stopwords, partitions, prepartition)
    bag = toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    if stem:
        bag = stem_bag(bag, id_col, partitions)
    return bag


def stem_bag(bag: DataFrame, id_col: str, partitions: int | None = None) -> DataFrame:
    """Porter-stem the terms where they are (a worker remembers stems), merge counts.

    One exchange deals the stems by id, for the counts and for later steps by id.
    """
    stems = (bag.filter(F.col("term").isNotNull())
             .select(id_col, _stem_udf(F.col("term")).alias("term"), "tf"))
    return ((stems.repartition(partitions, id_col) if partitions else stems.repartition(id_col))
            .groupBy(id_col, "term").agg(F.sum("tf").alias("tf")))


def stem_column(c: Column) -> Column:
    return _stem_udf(c)


def page_bags(pages: DataFrame, id_col: str = "url", html_col: str = "html",
              weight: bool = False, stopwords=None, stem: bool = False,
              partitions: int | None = None) -> DataFrame:
    """HTML pages -> long-form bag (field extraction, weighting, tokens, counts).

    Fields are extracted where the pages are scanned; the extracted text, not the
    html, is dealt by id, by one exchange that the counts and later sums use too.
    """
    text = page_text(_on_all_cores(pages.select(id_col, html_col)), id_col, html_col, weight)
    return bag_of_words(text, id_col, "text", stopwords, stem, partitions)


def _on_all_cores(df: DataFrame) -> DataFrame:
    """``df`` spread over the cores where its scan has fewer parts than there are (small tables only)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def flatten_bag(bag: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Multiset -> set: term with tf = n becomes features term1 .. termn."""
    return bag.select(
        id_col,
        F.explode(F.transform(F.sequence(F.lit(1), F.col("tf")),
                              lambda k: F.concat(F.col("term"), k.cast("string")))).alias("feature"))
