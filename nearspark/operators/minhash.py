"""MinHash signatures and banded LSH.

Plan:
1. bag -> one list of terms and one of counts per document (no longer than its
   own text).
2. An Arrow UDF flattens them to features ``term1..termN`` and takes md5 modulo
   2^32-1 and the ``num_hashes`` values of every *distinct* feature of a batch, with
   numpy uint64 arithmetic (``a*x + b < 2^64`` always holds, so it is exact); a
   document's minima are taken over its features' rows.
3. Identical signatures are collapsed first, so exact copies never square
   inside a bucket; bands of the distinct signatures are equi-joined on
   ``(band, bucket)`` with hot buckets tiled; candidates are de-duplicated and
   verified against the full signatures; groups are expanded at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspark import params
from nearspark.functions.hashing import MERSENNE_32, md5_mod, minhash_coefficients
from nearspark.operators import pairs as P
from nearspark.operators.text import flatten_bag
from nearspark.session import materialize

_CHUNK = 1 << 18  # features per numpy block inside one Arrow batch


def _signature_udf(num_hashes: int, seed: int):
    a, b = minhash_coefficients(num_hashes, seed)
    m = np.uint64(MERSENNE_32)

    def hash_values(x: np.ndarray, h: slice) -> np.ndarray:
        """``(a x + b) mod (2^32 - 1)``: a row a value, a column a hash."""
        out = np.empty((len(x), len(a[h])), np.uint32)
        for i in range(0, len(x), 1 << 16):
            out[i:i + (1 << 16)] = (x[i:i + (1 << 16), None] * a[None, h] + b[None, h]) % m
        return out

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(terms: pa.Array, tfs: pa.Array) -> pa.Array:
        lens = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        # every feature of the batch once: term1 .. termN with N the term's largest tf, at base[term] + k - 1
        most = np.zeros(len(coded.dictionary), np.int64)
        np.maximum.at(most, code, tf)
        base = np.cumsum(most) - most
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        digests = b"".join([hashlib.md5(w + b"%d" % k).digest() for w, n in zip(words, most.tolist()) for k in range(1, n + 1)])
        x = np.frombuffer(digests, ">u4").reshape(-1, 4).sum(axis=1, dtype=np.uint64) % m
        last = np.concatenate(([0], np.cumsum(tf)))
        n_features = last[np.cumsum(lens)] - last[np.cumsum(lens) - lens]  # of each document
        out = np.empty((len(lens), num_hashes), np.uint32)
        first_row = np.concatenate(([0], np.cumsum(lens)))
        blocks, start = [], 0
        while start < len(lens):
            # take documents until the block holds about _CHUNK features
            upto = np.cumsum(n_features[start:])
            stop = start + max(1, int(np.searchsorted(upto, _CHUNK, "right")))
            r0, r1 = first_row[start], first_row[stop]
            k = np.arange(last[r1] - last[r0]) - np.repeat(last[r0:r1] - last[r0], tf[r0:r1])
            blocks.append((start, stop, np.repeat(base[code[r0:r1]], tf[r0:r1]) + k))
            start = stop
        for h0 in range(0, num_hashes, 32):
            h = slice(h0, min(num_hashes, h0 + 32))
            values = hash_values(x, h)
            for start, stop, at in blocks:
                rows, ends = values[at], np.cumsum(n_features[start:stop]).tolist()
                for doc, (r0, r1) in enumerate(zip([0, *ends], ends), start):
                    rows[r0:r1].min(axis=0, out=out[doc, h])
        offsets = pa.array(np.arange(len(lens) + 1) * num_hashes, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.int64).ravel()))

    return signature


def feature_values(bag: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, x)``: md5 of every flattened feature, modulo 2^32-1."""
    return flatten_bag(bag, id_col).select(id_col, md5_mod(F.col("feature")).alias("x"))


def signatures(bag: DataFrame, id_col: str = "doc_id", num_hashes: int = 128,
               seed: int = 42) -> DataFrame:
    """``(id, signature array<bigint>)`` for every document with a non-empty bag."""
    params.check_minhash(num_hashes, 1)
    kept = bag.filter(F.col("term").isNotNull() & (F.col("tf") > 0))
    lists = kept.groupBy(id_col).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
    return lists.select(id_col, _signature_udf(num_hashes, seed)(F.col("terms"), F.col("tfs")).alias("signature"))


ESTIMATORS = ("union", "match_fraction")


def signature_similarity(s1: Column, s2: Column, estimator: str = "union") -> Column:
    """m matching positions of n -> m / (2n - m), or m / n for ``match_fraction``; 0 when n = 0."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}")
    m = F.aggregate(F.zip_with(s1, s2, lambda x, y: F.when(x == y, 1).otherwise(0)),
                    F.lit(0), lambda acc, v: acc + v)
    n = F.size(s1)
    union = n if estimator == "match_fraction" else 2 * n - m
    return F.when(union == 0, F.lit(0.0)).otherwise(m.cast("double") / union)


def band_bucket(sig: Column, band: Column, rows: int) -> Column:
    """Bucket id of one band: md5 of the band written as a tuple ``(v1, v2, ...)``."""
    part = F.slice(sig, band * rows + 1, F.lit(rows))
    text = F.concat(F.lit("("), F.array_join(part, ", "),
                    F.lit(",)") if rows == 1 else F.lit(")"))
    return F.md5(text)


def lsh_index(sigs: DataFrame, id_col: str = "doc_id", num_bands: int = 16,
              rows_per_band: int = 8) -> DataFrame:
    """``(band, bucket, id)``: one row per document and band."""
    if rows_per_band <= 0:
        raise ValueError("rows_per_band must be positive")
    entries = F.transform(
        F.sequence(F.lit(0), F.lit(num_bands - 1)),
        lambda b: F.struct(b.alias("band"), band_bucket(F.col("signature"), b, rows_per_band)
                           .alias("bucket")))
    return (sigs.select(id_col, F.explode(entries).alias("e"))
            .select(F.col("e.band").alias("band"), F.col("e.bucket").alias("bucket"), id_col))


def lsh_probe(index: DataFrame, probe_sigs: DataFrame, id_col: str = "doc_id",
              probe_id_col: str = "probe_id", num_bands: int = 16,
              rows_per_band: int = 8) -> DataFrame:
    """Candidates ``(probe_id, id)``: union over bands of bucket members."""
    probes = lsh_index(probe_sigs.withColumnRenamed(probe_id_col, "_pid"), "_pid",
                       num_bands, rows_per_band)
    hits = probes.join(index, ["band", "bucket"])
    return hits.select(F.col("_pid").alias(probe_id_col), F.col(id_col)).distinct()


def candidate_pairs(index: DataFrame, id_col: str, tile_size: int = P.DEFAULT_TILE) -> DataFrame:
    """Distinct ``(id1, id2)`` sharing at least one ``(band, bucket)``."""
    return (P.group_self_pairs(index, ["band", "bucket"], id_col, tile_size=tile_size)
            .select("id1", "id2").distinct())


def minhash_pairs(bag: DataFrame, id_col: str = "doc_id", num_hashes: int = 128,
                  num_bands: int = 16, jaccard_threshold: float = 0.6, seed: int = 42,
                  tile_size: int = P.DEFAULT_TILE, sigs: DataFrame | None = None,
                  estimator: str = "union") -> DataFrame:
    """Near-duplicate pairs ``(id1, id2, value)`` with value >= threshold; value as ``estimator`` names it."""
    rows = params.check_minhash(num_hashes, num_bands, jaccard_threshold)
    if sigs is None:
        sigs = signatures(bag, id_col, num_hashes, seed)
    sigs = materialize(sigs)  # read by the collapse and by the member join
    reps, members = P.collapse_identical(sigs, id_col, "signature")
    index = lsh_index(reps, "rep", num_bands, rows)
    cands = candidate_pairs(index, "rep", tile_size)
    s1 = reps.select(F.col("rep").alias("id1"), F.col("signature").alias("s1"))
    s2 = reps.select(F.col("rep").alias("id2"), F.col("signature").alias("s2"))
    scored = (cands.join(s1, "id1").join(s2, "id2")
              .select(F.col("id1").alias("rep1"), F.col("id2").alias("rep2"),
                      signature_similarity(F.col("s1"), F.col("s2"), estimator).alias("value"))
              .filter(F.col("value") >= F.lit(jaccard_threshold)))
    between = P.expand_groups(scored, members, "rep", id_col)
    within = P.within_group_pairs(members, "rep", id_col, 1.0, tile_size)
    return between.unionByName(within)
