"""Pair plumbing shared by all detectors.

* ``group_self_pairs``: all unordered pairs inside each group, with hot groups
  split into tiles so no task receives more than ``2 * tile_size`` members of
  one group. Used for exact-copy groups (the answer of the detectors contains
  those pairs) and for bucket candidates.
* ``expand_groups``: pairs of group representatives -> pairs of members.
* ``rank_pairs``: the reference's result order with an explicit rank column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TILE = 2048


def canonical(df: DataFrame, a: str, b: str, out1: str = "id1", out2: str = "id2") -> DataFrame:
    """Order each pair so that ``id1 < id2``."""
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(F.least(a, b).alias(out1), F.greatest(a, b).alias(out2), *rest)


def tile_keys(df: DataFrame, group_cols: list[str], id_col: str, payload: list[str],
              tile_size: int, min_size: int = 1) -> DataFrame:
    """Copy each row to the tile pairs ``(_lo, _hi)`` of its group (see below).

    Output columns: group columns, id, payload, ``_t`` (own tile), ``_lo``, ``_hi``.
    Groups smaller than ``min_size`` are dropped.
    """
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    if min_size > 1:
        sizes = sizes.filter(F.col("_n") >= min_size)
    sized = df.join(sizes, group_cols).withColumn(
        "_s", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(tile_size))).cast("int"))
    tiled = sized.withColumn("_t", F.pmod(F.xxhash64(F.col(id_col)), F.col("_s")).cast("int"))
    spread = tiled.select(
        *group_cols, id_col, *payload, "_t",
        F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_j"))
    return spread.select(
        *group_cols, id_col, *payload, "_t",
        F.least("_t", "_j").alias("_lo"), F.greatest("_t", "_j").alias("_hi"))


def group_self_pairs(df: DataFrame, group_cols: list[str], id_col: str,
                     payload: list[str] | None = None, tile_size: int = DEFAULT_TILE,
                     out1: str = "id1", out2: str = "id2") -> DataFrame:
    """All pairs ``id1 < id2`` that share ``group_cols``; skew-safe.

    A group of n members is cut into ``s = ceil(n / tile_size)`` tiles by a hash
    of the id. Each member is sent to the s tile pairs it belongs to, and the
    join key is ``(group, low tile, high tile)``. A pair counts in the one key of its
    two tiles, and each key holds at most two tiles, so the work of one hot group is
    spread over ``s(s+1)/2`` tasks. Groups below ``tile_size`` are not copied.
    """
    payload = payload or []
    keyed = tile_keys(df, group_cols, id_col, payload, tile_size, min_size=2)
    left = keyed.select(*group_cols, "_lo", "_hi", F.col("_t").alias("_t1"), F.col(id_col).alias(out1),
                        *[F.col(p).alias(f"{p}_1") for p in payload])
    right = keyed.select(*group_cols, "_lo", "_hi", F.col("_t").alias("_t2"), F.col(id_col).alias(out2),
                         *[F.col(p).alias(f"{p}_2") for p in payload])
    joined = left.join(right, group_cols + ["_lo", "_hi"]).filter(F.col(out1) < F.col(out2))
    # Two members of one tile also meet in the keys of other tiles: only their own counts.
    own = (F.least("_t1", "_t2") == F.col("_lo")) & (F.greatest("_t1", "_t2") == F.col("_hi"))
    return joined.filter(own).drop("_lo", "_hi", "_t1", "_t2")


def expand_groups(rep_pairs: DataFrame, members: DataFrame, rep_col: str, id_col: str,
                  value_col: str = "value") -> DataFrame:
    """``(rep1, rep2, value)`` x members -> ``(id1, id2, value)`` with id1 < id2."""
    m1 = members.select(F.col(rep_col).alias("rep1"), F.col(id_col).alias("_a"))
    m2 = members.select(F.col(rep_col).alias("rep2"), F.col(id_col).alias("_b"))
    out = rep_pairs.join(m1, "rep1").join(m2, "rep2")
    return out.select(F.least("_a", "_b").alias("id1"), F.greatest("_a", "_b").alias("id2"),
                      F.col(value_col).alias("value"))


def within_group_pairs(members: DataFrame, rep_col: str, id_col: str, value,
                       tile_size: int = DEFAULT_TILE) -> DataFrame:
    """Pairs inside each group of identical items, all with the same ``value``."""
    pairs = group_self_pairs(members, [rep_col], id_col, tile_size=tile_size)
    return pairs.select("id1", "id2", F.lit(value).cast("double").alias("value"))


def collapse_identical(df: DataFrame, id_col: str, key_col: str) -> tuple[DataFrame, DataFrame]:
    """Group rows with an identical ``key_col``.

    Returns ``(reps, members)``: one row per distinct key with ``rep`` = the
    smallest id (and the key), and ``(rep, id)`` for every row.
    """
    # An aggregate (partial, map-side) and a join, not a window: a window would
    # put a hot group of copies into one task.
    reps = df.groupBy(key_col).agg(F.min(id_col).alias("rep"))
    members = df.join(reps, key_col).select("rep", id_col)
    return reps.select("rep", key_col), members


def rank_pairs(pairs: DataFrame, ascending: bool) -> DataFrame:
    """Result order: distance ascending or similarity descending; ties by ids.

    A distributed sort, never one task: range-partition on the sort key, make
    the partitioning stable with a checkpoint, count each partition (one row
    per partition), and add the running offset of earlier partitions to a
    row number inside each partition.
    """
    order = [F.col("value").asc() if ascending else F.col("value").desc(),
             F.col("id1").asc(), F.col("id2").asc()]
    ranged = (pairs.repartitionByRange(*order)
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint())
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_pid").orderBy(*order)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn("rank", F.col("_off") + F.row_number().over(inner))
            .drop("_pid", "_off"))
