"""Token ids as files of range-coded blocks, and back.

A chunk holds the ids of consecutive documents, cut into blocks of ``BLOCK``
ids. A block is coded on its own: its model starts from nothing but the chunk's
order-0 table, and a CRC-32 of its ids is checked after decoding. One arithmetic
coding step per id draws on three predictions:

* order 2: the id that last followed the two ids before, in this block,
* order 1: the id that last followed the id before, in this block,
* order 0: the chunk's id frequencies, scaled to ``2**18`` slots, or more where
  the chunk has more than 65,536 distinct ids.

Their shares of the coding interval adapt: each of the first two has a hit
probability per state of confidence (how often in a row its prediction held),
learned as the block is read; the product of their misses goes to order 0.
The coder is a 64-bit carry-less range coder that sends 32-bit words.

All blocks of a chunk are coded in step, one NumPy lane each, so Python's cost
per id is that of a few array elements. Chunks are rows of a Parquet table (the
file format): Spark's writers commit them on any store, a lost task is redone
alone. Documents are dealt by ranges of their id, of any type; empty and null texts
hold the end id alone. Rows that repeat an id stay, next to each other; null ids come
first. A very long text is a chunk of its own. An empty table gives no chunks and no
rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearspark.llm.staging import partitions_for, stage
from nearspark.llm.tokens import token_slices

BLOCK = 4096
LANES = 1024
SLOT_BITS = 18
UNIT_BITS = 6  # a slot of order 0 is up to 64 units of the coding interval
_HASH = 1024
_STATES = 8
_U = np.uint64
_WORD = _U(1 << 32)
_LOW = _U((1 << 32) - 1)


def slot_bits(n_values: int) -> int:
    """Slots of a table of ``n_values`` distinct ids: four for each at least."""
    return max(SLOT_BITS, (4 * n_values - 1).bit_length())


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their slots: at least 1 each, ``2**slot_bits`` in all."""
    values, counts = np.unique(ids, return_counts=True)
    all_slots = 1 << slot_bits(len(values))
    slots = 1 + (counts * (all_slots - len(values))) // counts.sum()
    slots[np.argmax(slots)] += all_slots - slots.sum()
    return values.astype(np.uint32), slots.astype(np.uint32)


class _Model:
    """State of the order-1 and order-2 predictions of every lane."""

    def __init__(self, lanes: int, bits: int):
        self.bits, self.total_bits = bits, bits + UNIT_BITS
        self.two = np.zeros((lanes, _HASH), np.int64).reshape(-1)  # id + 1, confidence above bit 32
        self.one = np.zeros((lanes, _HASH), np.int64).reshape(-1)
        # hit probability out of 2**16; state 0 of a context never seen is kept apart by id 0
        start = np.array([0.1, 0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85]) * 65536
        self.p2 = np.tile(start.astype(np.int64), lanes)
        self.p1 = np.tile(start.astype(np.int64), lanes)
        self.base = np.arange(lanes) * _HASH
        self.states = np.arange(lanes) * _STATES
        self.a = np.zeros(lanes, np.int64)
        self.b = np.zeros(lanes, np.int64)

    def shares(self, n: int):
        """Interval shares of the first ``n`` lanes: predicted ids + 1 and the two bounds, and order 0's unit."""
        a, b = self.a[:n], self.b[:n]
        self.at2 = self.base[:n] + ((a * 40503 + b * 30029 + 1) >> 3 & (_HASH - 1))
        self.at1 = self.base[:n] + (b * 40503 >> 4 & (_HASH - 1))
        e2, e1 = self.two[self.at2], self.one[self.at1]
        self.id2, self.id1 = e2 & 0xFFFFFFFF, e1 & 0xFFFFFFFF
        self.s2, self.s1 = e2 >> 32, e1 >> 32
        self.i2, self.i1 = self.states[:n] + self.s2, self.states[:n] + self.s1
        self.q2, self.q1 = self.p2[self.i2], self.p1[self.i1]
        has2 = self.id2 > 0
        has1 = (self.id1 > 0) & (self.id1 != self.id2)
        w2, w1 = self.q2 * has2, self.q1 * has1
        rest = (65536 - w2) * (65536 - w1) >> 16
        # A valid prediction keeps at least one of 64 units, so its share is never empty.
        unit = np.minimum(np.maximum(rest >> 10, 1), 64 - (has2 | has1))
        hits = (1 << self.total_bits) - (unit << self.bits)
        w1 = np.maximum((65536 - w2) * w1 >> 16, has1)
        two = hits * w2 // np.maximum(w2 + w1, 1)
        return two, hits, unit

    def learn(self, x: np.ndarray) -> None:
        """Take in the ids ``x + 1`` of the active lanes."""
        hit2, hit1 = x == self.id2, x == self.id1
        self.p2[self.i2] = np.maximum(self.q2 + (((hit2 * 65000) - self.q2) * (self.id2 > 0) >> 4), 64)
        self.p1[self.i1] = np.maximum(self.q1 + (((hit1 * 65000) - self.q1) * (self.id1 > 0) >> 4), 64)
        self.two[self.at2] = x + (np.minimum(self.s2 + 1, _STATES - 1) * hit2 << 32)
        self.one[self.at1] = x + (np.minimum(self.s1 + 1, _STATES - 1) * hit1 << 32)
        n = len(x)
        self.a[:n] = self.b[:n]
        self.b[:n] = x


def _lane_lengths(total: int) -> np.ndarray:
    n = -(-total // BLOCK)
    out = np.full(n, BLOCK, np.int64)
    if n:
        out[-1] = total - BLOCK * (n - 1)
    return out


def encode_blocks(ids: np.ndarray, values: np.ndarray, slots: np.ndarray) -> list[np.ndarray]:
    """Words (uint32) of each block of ``ids``; only the last block may be short."""
    length = _lane_lengths(len(ids))
    lanes = len(length)
    first = np.cumsum(slots.astype(np.int64)) - slots
    rank = np.searchsorted(values, ids)
    padded = np.zeros(lanes * BLOCK, np.int64)
    padded[:len(ids)] = rank
    steps = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    ident, width = values.astype(np.int64), slots.astype(np.int64)
    model = _Model(lanes, slot_bits(len(values)))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))
    words = np.zeros((lanes, 2 * BLOCK + 2), np.uint32)
    sent = np.zeros(lanes, np.int64)
    for t in range(int(length.max(initial=0))):
        n = lanes if t < length[-1] else lanes - 1
        r = steps[t, :n]
        x = ident[r] + 1
        two, hits, unit = model.shares(n)
        is2 = x == model.id2
        is1 = (x == model.id1) & ~is2
        from0 = ~(is2 | is1)
        start = np.where(from0, hits + first[r] * unit, two * is1).astype(np.uint64)
        size = np.where(from0, width[r] * unit, np.where(is2, two, hits - two)).astype(np.uint64)
        lo, part = low[:n], span[:n] >> _U(model.total_bits)
        lo += start * part
        part *= size
        settled = (lo ^ (lo + part)) < _WORD
        tight = (part < _WORD) & ~settled
        if tight.any():
            part[tight] = -lo[tight] & _LOW
        out = np.flatnonzero(settled | tight)
        words[out, sent[out]] = lo[out] >> _U(32)
        sent[out] += 1
        lo[out] <<= _U(32)
        part[out] <<= _U(32)
        span[:n] = part
        model.learn(x)
    for shift in (32, 0):
        words[np.arange(lanes), sent] = (low >> _U(shift)) & _LOW
        sent += 1
    return [words[i, :sent[i]].copy() for i in range(lanes)]


def decode_blocks(blocks: list[np.ndarray], total: int, values: np.ndarray, slots: np.ndarray) -> np.ndarray:
    length = _lane_lengths(total)
    lanes = len(length)
    if not lanes:
        return np.zeros(0, np.uint32)
    first = np.cumsum(slots.astype(np.int64)) - slots
    ident, width = values.astype(np.int64), slots.astype(np.int64)
    of_slot = np.repeat(np.arange(len(values)), slots)
    words = np.zeros((lanes, max(map(len, blocks)) + 1), np.uint64)
    for i, w in enumerate(blocks):
        words[i, :len(w)] = w
    model = _Model(lanes, slot_bits(len(values)))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))
    code = (words[:, 0] << _U(32)) | words[:, 1]
    read = np.full(lanes, 2)
    steps = np.zeros((BLOCK, lanes), np.uint32)
    for t in range(int(length.max())):
        n = lanes if t < length[-1] else lanes - 1
        two, hits, unit = model.shares(n)
        lo, part = low[:n], span[:n] >> _U(model.total_bits)
        v = np.minimum((code[:n] - lo) // part, _U((1 << model.total_bits) - 1)).astype(np.int64)
        is2 = v < two
        from0 = v >= hits
        r = of_slot[np.where(from0, (v - hits) // unit, 0)]
        x = np.where(from0, ident[r] + 1, np.where(is2, model.id2, model.id1))
        steps[t, :n] = x - 1
        start = np.where(from0, hits + first[r] * unit, two * ~is2).astype(np.uint64)
        size = np.where(from0, width[r] * unit, np.where(is2, two, hits - two)).astype(np.uint64)
        lo += start * part
        part *= size
        settled = (lo ^ (lo + part)) < _WORD
        tight = (part < _WORD) & ~settled
        if tight.any():
            part[tight] = -lo[tight] & _LOW
        out = np.flatnonzero(settled | tight)
        lo[out] <<= _U(32)
        part[out] <<= _U(32)
        code[out] = (code[out] << _U(32)) | words[out, read[out]]
        read[out] += 1
        span[:n] = part
        model.learn(x)
    return np.ascontiguousarray(steps.T).reshape(-1)[:total]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def pack_chunk(ids: np.ndarray) -> dict:
    """One chunk's columns."""
    values, slots = frequency_table(ids)
    blocks = encode_blocks(ids, values, slots)
    return {
        "n_ids": len(ids), "table_ids": zlib.compress(np.diff(values, prepend=np.uint32(0)).astype("<u4").tobytes()),
        "table_slots": zlib.compress(slots.astype("<u4").tobytes()),
        "block_words": [len(b) for b in blocks],
        "block_crc32": [crc32(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)],
        "payload": b"".join(b.astype("<u4").tobytes() for b in blocks),
    }


def unpack_chunk(row: dict) -> np.ndarray:
    values = np.cumsum(np.frombuffer(zlib.decompress(row["table_ids"]), "<u4"), dtype=np.uint32)
    slots = np.frombuffer(zlib.decompress(row["table_slots"]), "<u4")
    words = np.frombuffer(row["payload"], "<u4")
    blocks = np.split(words, np.cumsum(row["block_words"])[:-1])
    ids = decode_blocks(blocks, row["n_ids"], values, slots)
    for i, want in enumerate(row["block_crc32"]):
        if crc32(ids[i * BLOCK:(i + 1) * BLOCK]) != want:
            raise ValueError(f"block {i} fails its checksum")
    return ids


CHUNK_SCHEMA = ("part int, chunk int, doc_ids array<{}>, doc_lengths array<long>, n_ids long, table_ids binary, "
                "table_slots binary, block_words array<int>, block_crc32 array<long>, payload binary")


def _write(path: str, end_id: int, id_type: pa.DataType):
    fields = pa.schema([
        ("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(id_type)),
        ("doc_lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("table_ids", pa.binary()),
        ("table_slots", pa.binary()), ("block_words", pa.list_(pa.int32())),
        ("block_crc32", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, chunk = TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_pylist(
                [{"part": part, "chunk": chunk, "doc_ids": docs, "doc_lengths": lengths}
                 | pack_chunk(np.concatenate(held))], schema=fields)

        for batch, a, ids, counts in token_slices(batches, path, end_id, 8 << 20):
            docs += batch.column(0).slice(a, len(counts)).to_pylist()
            lengths += counts.tolist()
            held.append(ids)
            size += len(ids)
            if size >= BLOCK * LANES:
                yield flush()
                docs, lengths, held, size, chunk = [], [], [], 0, chunk + 1
        if docs:
            yield flush()
    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the written table of chunks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(spark, n_bytes, 24 << 20)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stage(ordered.mapInArrow(_write(tokenizer_path, end_id, id_type), CHUNK_SCHEMA.format(kind)), "token-ids")


def _read(digest_only: bool):
    names = ["part", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * (not digest_only)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "doc_ids"}
                ids = unpack_chunk(row)
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(cuts)
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()),
                        batch.column("doc_ids")[i].values, pa.array(starts), pa.array(ends - starts),
                        pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                if not digest_only:
                    cols.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cuts],
                                         pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def read_ids(chunks: DataFrame, digest_only: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` decoded from a table of chunks.

    ``start`` counts the ids of all documents before; it comes from running
    totals over the chunks (one small row each).
    """
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    # Two levels: within a part, then over the parts (one row each).
    part_total = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = part_total.select("part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("p0"))
    before = (chunks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("c0"))
              .join(parts, "part").select("part", "chunk", (F.col("p0") + F.col("c0")).alias("before")))
    schema = f"part int, chunk int, doc_id {kind}, at long, n_tokens long, ids_crc32 long"
    rows = chunks.mapInArrow(_read(digest_only), schema + ", ids array<int>" * (not digest_only))
    return rows.join(before, ["part", "chunk"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] * (not digest_only)))
