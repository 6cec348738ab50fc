"""The learning split and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """True for the quarter of rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def bounded_ids(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` distinct non-null ids of learnable rows, chosen by a hash of the id."""
    keep = rows.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).dropDuplicates([id_col])
    return keep.orderBy(F.xxhash64(id_col), id_col).limit(most)


def fair_share(sizes: list[int], most: int, least: int) -> int:
    """Largest number a group may give so that all give ``most`` rows at most; ``least`` at least."""
    left, groups = most, len(sizes)
    for n in sorted(sizes):
        if n * groups > left:
            return max(left // groups, least)
        left, groups = left - n, groups - 1
    return max(max(sizes, default=0), least)


def bounded_ids_by(rows: DataFrame, id_col: str, group_col: str, most: int, least: int) -> DataFrame:
    """Distinct learnable ``(id, group)``: of each group those of smallest hash, up to a share that is
    fair to all groups. ``most`` rows, or ``least`` of every group where these are more.
    """
    keep = (rows.select(id_col, group_col).filter(F.col(id_col).isNotNull() & F.col(group_col).isNotNull()
                                                  & ~held_out(id_col)).dropDuplicates()
            .withColumn("_h", F.xxhash64(id_col)))
    sizes = {r[0]: r["count"] for r in keep.groupBy(group_col).count().collect()}
    share = fair_share(list(sizes.values()), most, least)
    # Of large groups only the hashes below a bound that leaves about twice the share are ranked.
    bounds = [(g, int(min(2 * share / n, 1.0) * (2 ** 64 - 1)) - 2 ** 63) if n > 2 * share else (g, 2 ** 63 - 1)
              for g, n in sizes.items()]
    low = rows.sparkSession.createDataFrame(
        bounds, f"{group_col} {rows.schema[group_col].dataType.simpleString()}, _bound long")
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy("_h", id_col))
    return (keep.join(F.broadcast(low), group_col).filter("_h <= _bound").withColumn("_rank", rank)
            .filter(F.col("_rank") <= share).select(id_col, group_col))
