"""Best-fit packing by minimum bin slack.

Pieces of tokenised texts go into sequences of a fixed capacity. Per sequence a
subset-sum program on a bitset (bit ``s`` set: some available pieces sum to
``s``) finds the fullest combination that goes with the longest piece left; it
is removed, as often as the counts allow, and the search goes on. It only needs
how many pieces there are of each length (at most ``capacity`` numbers), so the
plan is made on the driver from a histogram, and every piece finds its place
from its rank among the pieces of its length. The plan has one row per kind of
sequence and length in it; its size depends on the capacity, not on the corpus.

Null text is an empty text, whose piece is the end id alone. Repeated rows are
packed like any others. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearspark.llm.staging import stage
from nearspark.llm.tokens import token_slices

SLICE_BYTES = 2 << 20


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        for batch, a, ids, counts in token_slices(batches, path, end_id, SLICE_BYTES):
            first = np.concatenate([[0], np.cumsum(counts)])
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            lo = (first[doc] + start) * 4
            cuts = [raw[x:y] for x, y in zip(lo.tolist(), (lo + length * 4).tolist())]
            cols = [batch.column(0).take(pa.array(a + doc)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cuts],
                                     pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048,
           id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids, cut at ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _cut(tokenizer_path, end_id, capacity, keep_ids), schema)


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """The available lengths (with multiplicity) of largest sum not above ``room``."""
    bits, taken = 1, []
    full = 1 << room
    mask = (full << 1) - 1
    for length in range(room, 0, -1):
        left, k = min(counts[length], room // length), 1
        while left and not bits & full:
            k = min(k, left)
            taken.append((length, k, bits))
            bits |= (bits << length * k) & mask
            left -= k
            k *= 2
        if bits & full:
            break
    at, out = bits.bit_length() - 1, {}
    for length, k, before in reversed(taken):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + k
            at -= length * k
    return out


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows ``(length, first_rank, n_ranks, per_sequence, first_sequence, offset)``.

    The pieces of ``length`` with ranks from ``first_rank`` on fill sequences
    from ``first_sequence`` on, ``per_sequence`` in each, side by side from ``offset``.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            combination = fullest(counts, capacity - longest)
            counts[longest] += 1
            combination[longest] = combination.get(longest, 0) + 1
            times = min(counts[x] // n for x, n in combination.items())
            offset = 0
            for length, n in sorted(combination.items(), reverse=True):
                rows.append((length, used[length], n * times, n, sequence, offset))
                used[length] += n * times
                counts[length] -= n * times
                offset += n * length
            sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _place(shared):
    def run(batches):
        rows = shared.value
        key = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = rows[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            within = rank - row[:, 1]
            out = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(row[:, 4] + within // row[:, 3]),
                 pa.array(row[:, 5] + within % row[:, 3] * length)],
                names=[*out.schema.names, "sequence_id", "offset"])
    return run


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a (staged) table of pieces."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    # Ranks within a length, without a window over the length: blocks by hash, then running block totals.
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    totals = dealt.groupBy("length", "_block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_block").orderBy("doc_id", "piece")
    ranked = (dealt.withColumn("_own", F.row_number().over(own)).join(totals, ["length", "_block"])
              .withColumn("_rank", F.col("_before") + F.col("_own") - 1)
              .select(*cut.columns, "_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(_place(shared), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **cols) -> DataFrame:
    return pack(stage(pieces(docs, tokenizer_path, end_id, capacity, **cols), "pieces"), capacity)
