"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from nearspark.session import shared_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage; a lost executor costs at most the tasks that read the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "nearspark-" in folder.rpartition("/")[2]:
                p = spark._jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions_for(spark: SparkSession, n_bytes: int, per_partition: int = 16 << 20) -> int:
    """Shuffle width for ``n_bytes``: follows the data, never below the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_partition))


def small_batches(spark: SparkSession, rows: int = 1000, n_bytes: int = 4 << 20) -> None:
    """Let Python workers take long texts in batches of at most ``rows`` rows and about ``n_bytes``.

    Bounds the Arrow buffers that the JVM and the worker hold for a batch; a
    single longer text is a batch of its own, and smaller settings of the session stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", n_bytes)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < _number(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _number(setting: str) -> int:
    """A row or byte setting as Spark shows it (``10000``, ``64MB``, ``4194304b``)."""
    digits, unit = re.fullmatch(r"(-?\d+)\s*([a-zA-Z]*)", setting.strip()).groups()
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1].lower()]
