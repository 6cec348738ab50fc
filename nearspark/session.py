"""Spark session and shared-storage helpers.

Library code never invents storage: anything that must outlive a stage
(checkpoints, a stored LSH index, round-trip fixtures) goes under the folder the
cluster names in ``spark.checkpoint.dir``. Only a single-process session
(tests, bench) that names none gets a temporary one.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str | None = None, app: str = "nearspark",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, a fresh
    temporary folder serves a session whose executors all run in this process
    (``local[...]``: tests, bench); a cluster session must name its folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="nearspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (never reused)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"nearspark-{name}-{uuid.uuid4().hex[:12]}")


def local_path(path: str) -> str:
    """A ``file:`` URI as a plain path for Python-side file I/O.

    Spark readers and writers take URIs as they are; code that opens files from
    Python (the WARC writer and reader) needs the path itself, on storage every
    executor mounts.
    """
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path


def unsized(df):
    """``df`` without the planner's guess of its size, for rows that make many more: a guess that is too small would
    have them broadcast. Only sizes measured at run time count then."""
    spark = df.sparkSession
    rows = df.select("*")._jdf  # a range has numbers instead of rows
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def materialize(df, keep_partitioning: bool = False):
    """Cut lineage for an intermediate used several times (reliable checkpoint).

    Written to the shared checkpoint folder, so it survives executor loss;
    never a local checkpoint. An adaptive plan does not tell how its rows are dealt;
    with ``keep_partitioning`` the checkpoint is planned without AQE, so that later
    steps by the same key need no exchange.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
