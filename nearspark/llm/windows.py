"""MinHash containment search of short items inside long texts.

Items are partitioned by size: class ``c`` holds the items with ``2**c`` to
``2**(c+1) - 1`` distinct shingles. For a class a text is read through windows
of ``2**(c+2)`` shingles that overlap by half, so a passage as long as an item
lies whole inside one window, and an item contained to ``t`` has a Jaccard
similarity of at least ``t / (4 + (1 - t))`` with that window, however long the
text is. ``band_settings`` turns that bound into bands that collide with at
least the asked probability.

A fixed-size presence filter of the items' shingles (no false negatives) spares
the signatures of windows that share no shingle with any item. What a text sends
on is its band keys that some item may have, and those of its shingles that some
item may have; both are short for a text without a match. Verification counts
the shared distinct shingles exactly, over the whole text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm import textops as T
from nearspark.llm.staging import stage

_U = np.uint64
FILTER_BITS = 22  # 512 KiB as packed bits, whatever the number of items


def size_class(n: int) -> int:
    return max(int(n).bit_length() - 1, 0)


def window_length(c: int) -> int:
    return 1 << (c + 2)


def lowest_similarity(threshold: float) -> float:
    """Least Jaccard similarity of a window with an item it contains to ``threshold``."""
    return threshold / (4 + 1 - threshold)


def band_settings(similarity: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """``(bands, rows)``: most selective rows whose bands reach ``recall`` at ``similarity``."""
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _salts(n: int) -> np.ndarray:
    return T.mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def band_keys(windows: list[np.ndarray], c: int, bands: int, rows: int) -> np.ndarray:
    """Band keys, one row per window (windows are non-empty shingle arrays)."""
    flat = np.concatenate(windows)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in windows])[:-1]])
    salt = _salts(bands * rows)
    out = np.zeros((len(windows), bands), np.uint64)
    for j in range(bands * rows):
        low = np.minimum.reduceat(T.mix(flat * salt[j]) if rows > 1 else flat * salt[j], starts)
        out[:, j // rows] = T.mix(out[:, j // rows] ^ low ^ salt[j])
    return T.mix(out ^ _U(c + 1))


def _item_rows(normalise, k: int):
    def run(batches):
        for batch in batches:
            for a, n, data, off in T.text_slices(batch):
                h, first = T.shingles_of(normalise(data), off, k)
                sets = [np.unique(h[first[i]:first[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array([len(x) for x in sets], pa.int32()),
                     pa.array([T.signed(x) for x in sets], pa.list_(pa.int64()))],
                    names=["item", "n_item", "sh"])
    return run


def _item_bands(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for item, n, sh in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   batch.column(2).to_pylist()):
                x = np.array(sh, np.int64).view(np.uint64)
                keys = T.signed(band_keys([x], size_class(n), bands, rows)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array([item] * len(keys), batch.column(0).type)],
                    names=["key", "item"])
    return run


def presence(values: DataFrame, col: str) -> np.ndarray:
    """Fixed-size filter of a column of hashes; at most ``2**(FILTER_BITS-6)`` words are gathered."""
    slot = F.shiftrightunsigned(F.col(col), 64 - FILTER_BITS)
    rows = (values.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out


def may_hold(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    slot = x >> _U(64 - FILTER_BITS)
    return (words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63)).astype(np.int64)) & 1 == 1


def _search(shared, classes: dict[int, int], bands: int, rows: int, normalise, k: int):
    def of_text(h: np.ndarray, hit: np.ndarray, key_filter: np.ndarray) -> np.ndarray:
        """Band keys, possibly held by an item, of the windows that hold a hit."""
        found = []
        at = np.flatnonzero(hit)
        distinct = len(np.unique(h[at]))
        for c, least in classes.items():
            if distinct < least:  # too few to hold the threshold's share of the class's smallest item
                continue
            size = window_length(c)
            step = size // 2
            last = max(0, -(-(len(h) - size) // step))
            # a hit at position p lies in windows p // step - 1 and p // step
            near = np.unique(np.clip(np.concatenate([at // step - 1, at // step]), 0, last))
            for i in range(0, len(near), 256):
                keys = band_keys([h[w * step:w * step + size] for w in near[i:i + 256].tolist()], c, bands, rows)
                keys = np.unique(keys)
                found.append(keys[may_hold(key_filter, keys)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def run(batches):
        T.keep_memory_low()
        item_filter, key_filter = shared.value
        for batch in batches:
            rows_out, all_keys, hits, places = [], [], [], []
            for a, n, data, off in T.text_slices(batch):
                h, first = T.shingles_of(normalise(data), off, k)
                hit = may_hold(item_filter, h)
                seen = np.concatenate([[0], np.cumsum(hit)])
                for i in np.flatnonzero(seen[first[1:]] > seen[first[:-1]]).tolist():
                    own, own_hit = h[first[i]:first[i + 1]], hit[first[i]:first[i + 1]]
                    keys = of_text(own, own_hit, key_filter)
                    if len(keys):
                        at = np.flatnonzero(own_hit)
                        values, where = np.unique(own[at], return_index=True)
                        rows_out.append(a + i)
                        all_keys.append(T.signed(keys))
                        hits.append(T.signed(values))
                        places.append(at[where].astype(np.int32))
            if rows_out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows_out)), pa.array(all_keys, pa.list_(pa.int64())),
                     pa.array(hits, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                    names=["doc_id", "keys", "hits", "places"])
    return run


def as_is(data: np.ndarray) -> np.ndarray:
    return data


def _best(matches: DataFrame, threshold: float) -> DataFrame:
    """Of a text's matches those that stand on shingles of their own.

    A match goes if an item contained to a larger share is in the same text and the
    text holds less than ``threshold`` of the shingles that set the match's item
    apart from that one. Items that are whole parts of others stay, and so do items
    contained to the same share. A text has at most a match per item.
    """
    def explained(x, y):
        better = y["n_shared"] * x["n_item"] > x["n_shared"] * y["n_item"]
        apart, held = F.array_except(x["sh"], y["sh"]), F.array_except(x["at"]["hits"], y["sh"])
        return better & (F.size(held) < F.lit(threshold) * F.size(apart))

    rows = matches.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(
        F.struct("item", "n_item", "n_shared", "sh", "at")).alias("all"))
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: explained(x, y)))
    return rows.select("doc_id", F.inline(kept))


def search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str,
           item_text_col: str, threshold: float, recall: float, max_hashes: int, k: int = 5,
           normalise=as_is, best: bool = False) -> DataFrame:
    """``(doc_id, item, n_item, n_shared, start_word, end_word)`` of verified matches.

    ``best``: without the matches that a better one explains (``_best``).

    ``n_shared`` of the item's ``n_item`` distinct shingles occur in the text;
    the words from ``start_word`` to ``end_word`` (exclusive) span their first
    occurrences. Items without a word match nothing.
    """
    spark = docs.sparkSession
    bands, rows = band_settings(lowest_similarity(threshold), recall, max_hashes)
    item_type = items.schema[item_col].dataType.simpleString()
    doc_type = docs.schema[id_col].dataType.simpleString()
    known = stage(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
                  .mapInArrow(_item_rows(normalise, k), f"item {item_type}, n_item int, sh array<long>")
                  .filter("n_item > 0"), "items")
    keyed = stage(known.mapInArrow(_item_bands(bands, rows), f"key long, item {item_type}"), "item-bands")
    smallest = known.groupBy(F.floor(F.log2("n_item")).alias("c")).agg(F.min("n_item").alias("n")).collect()
    classes = {size_class(r["n"]): math.ceil(threshold * r["n"] - 1e-9) for r in smallest}
    shared = spark.sparkContext.broadcast(
        (presence(known.select(F.explode("sh").alias("x")), "x"), presence(keyed, "key")))
    found = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _search(shared, classes, bands, rows, normalise, k),
        f"doc_id {doc_type}, keys array<long>, hits array<long>, places array<int>")
        .withColumn("row", F.monotonically_increasing_id()), "window-hits")
    pairs = (found.select("row", F.explode("keys").alias("key")).join(keyed, "key")
             .select("row", "item").distinct())
    shared_at = F.filter(F.arrays_zip("hits", "places"), lambda x: F.array_contains("sh", x["hits"]))
    out = (pairs.join(known, "item").join(found.drop("keys"), "row")
           .withColumn("at", shared_at).withColumn("n_shared", F.size("at"))
           .filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item")))
    if best:
        out = _best(out, threshold)
    return out.select(
        "doc_id", "item", "n_item", "n_shared", F.array_min("at.places").alias("start_word"),
        (F.array_max("at.places") + k).alias("end_word")).dropDuplicates()
