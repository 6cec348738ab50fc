"""Crawl-index records: scan, filter, domain match, byte-range plan.

Index records are newline-delimited JSON objects whose fields are all strings.
The scan uses an explicit schema (nothing inferred); filters are plain column
predicates, so Catalyst pushes them into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_FIELDS = ("url", "mime", "status", "languages", "encoding", "filename", "offset", "length")
INDEX_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in INDEX_FIELDS])


def read_index(spark: SparkSession, path: str, corrupt_col: str | None = None) -> DataFrame:
    """Scan index files (JSON lines) with the fixed all-string schema.

    A line that is no JSON object gives a row of nulls; ``corrupt_col`` names a
    further column that holds such lines as they are.
    """
    if corrupt_col is None:
        return spark.read.schema(INDEX_SCHEMA).json(path)
    schema = T.StructType([*INDEX_SCHEMA.fields, T.StructField(corrupt_col, T.StringType(), True)])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", corrupt_col).json(path)


def parse_index_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Index records from a column of JSON strings."""
    parsed = lines.select(F.from_json(F.col(line_col), INDEX_SCHEMA).alias("r"))
    return parsed.select(*[F.col(f"r.{f}").alias(f) for f in INDEX_FIELDS])


def html_record_filter(url_prefix: str = "https", mime: str = "text/html", status: str = "200",
                       languages: str = "eng", encoding: str = "UTF-8") -> Column:
    """The record conjunction; a missing field never passes (null -> false)."""
    cond = (F.col("url").startswith(url_prefix) & (F.col("mime") == mime)
            & (F.col("status") == status) & (F.col("languages") == languages)
            & (F.col("encoding") == encoding))
    return F.coalesce(cond, F.lit(False))


def filter_index(records: DataFrame, **kwargs) -> DataFrame:
    return records.filter(html_record_filter(**kwargs))


def host_of(url: Column) -> Column:
    """Lower-case host; null where the URL has none, a plain pattern where it is malformed."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")),
                              F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1),
                                       F.lit(""))))


def domain_filter(records: DataFrame, domain: str, url_col: str = "url") -> DataFrame:
    """Records whose host is ``domain`` or one of its subdomains."""
    d = domain.lower()
    host = host_of(F.col(url_col))
    return records.filter((host == d) | host.endswith("." + d))


def byte_ranges(records: DataFrame) -> DataFrame:
    """Add integer ``start``/``end`` (inclusive) and the HTTP ``range`` string."""
    start = F.col("offset").try_cast("bigint")
    end = start + F.col("length").try_cast("bigint") - 1
    return records.select(
        *records.columns, start.alias("start"), end.alias("end"),
        F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), end.cast("string")).alias("range"))
