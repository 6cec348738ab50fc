"""Cosine similarity joins.

Sparse (TF-IDF, unit rows): exact join by norm sketches. Terms are dealt to buckets by a
hash; a document's *sketch* holds the norm of its vector's part in each bucket. By
Cauchy-Schwarz in every bucket, x.y is at most the product of the sketches, so only pairs
whose product reaches t are looked at. Vectors are stored once, in tiles by the number of
terms that matter in them; a task reads the two tiles of a pair from the shared folder and
compares their sketches as a matrix product, as wide as the vector with fewer such terms needs
(wider ones where many pairs may pass). The heavy terms of one vector then bound the value,
and what may still pass is scored on all terms, both as matrix products of rows that lie
together. Only pairs that pass leave a task. Time is quadratic in the documents, what is written is not.
Terms are known by 64-bit hashes. (Joining the documents by their rare terms instead writes
a row for each term that two documents share, which on prose is most pairs of a corpus.)

Equal bags are collapsed first: the join sees one representative of each class. Its pairs are
written out for all members where they are found (``sparse_cosine_pairs``), or a copy hangs on
it as in a star (``cosine_links``), which needs one row a copy instead of a clique. Links also
leave out what other links imply: a forest of each tile, then what joins two tiles' forests.

Dense (LSA vectors, embeddings): the same with whole vectors, which are stored once, in tiles; a task
reads the two tiles of a pair and hands on only the pairs whose product reaches the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspark.operators import pairs as P
from nearspark.session import local_path, materialize, shared_path, unsized

_U = np.uint64


def dense_cosine(v1: Column, v2: Column) -> Column:
    """dot / (|v1| |v2|); null when a norm is zero (never passes a threshold)."""
    dot = F.aggregate(F.zip_with(v1, v2, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    n1 = F.sqrt(F.aggregate(v1, F.lit(0.0), lambda s, x: s + x * x))
    n2 = F.sqrt(F.aggregate(v2, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, n1 * n2)


def equal_classes(bag: DataFrame, id_col: str = "doc_id", value_col: str = "tf") -> DataFrame:
    """``(id, rep)``: documents of equal bags share the smallest id. Bags are known by 128-bit hashes and size."""
    signature = bag.groupBy(id_col).agg(
        F.bit_xor(F.xxhash64("term", value_col)).alias("_a"),
        F.bit_xor(F.xxhash64(F.lit(1), value_col, "term")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    reps = signature.groupBy("_a", "_b", "_n").agg(F.min(id_col).alias("rep"))
    return signature.join(reps, ["_a", "_b", "_n"]).select(id_col, "rep")


@dataclass
class Tile:
    """Vectors one after another: entries ``first[i]`` to ``first[i + 1]`` are those of row ``i``.

    The ids of the documents that have the vector are ``ids[member[i]:member[i + 1]]``.
    """

    ids: pa.Array
    member: np.ndarray
    kind: np.ndarray  # equal for rows of one class
    first: np.ndarray
    terms: np.ndarray  # 64-bit hashes, heaviest first in a vector
    w: np.ndarray

    def __post_init__(self):
        """``heavy[i]``: entries of row ``i`` that leave a norm of at most ``rest[i]``, about 0.3, to the others."""
        upto = np.concatenate([[0.0], np.cumsum(self.w * self.w)])
        start, end = self.first[:-1], self.first[1:]
        at = np.searchsorted(upto, upto[end] - 0.1, "left")
        self.heavy = np.clip(at - start, 1, end - start)
        self.rest = np.sqrt(np.maximum(upto[end] - upto[start + self.heavy], 0)) + 1e-6
        self.norm = np.sqrt(np.maximum(upto[end] - upto[start], 0)) + 1e-6

    def __len__(self) -> int:
        return len(self.kind)

    def sketches(self, width: int, rows: slice) -> np.ndarray:
        n = len(range(*rows.indices(len(self))))
        out = np.empty((n, width), np.float32)
        step = max(1, (1 << 22) // width)
        for a in range(0, n, step):
            at = self.first[rows.start + a:rows.start + min(a + step, n) + 1]
            own = slice(at[0], at[-1])
            cell = np.repeat(np.arange(len(at) - 1) * width, np.diff(at)) + (self.terms[own] % _U(width)).astype(np.int64)
            w2 = self.w[own] * self.w[own]
            out[a:a + step] = np.sqrt(np.bincount(cell, w2, (len(at) - 1) * width)).reshape(-1, width)
        return out


def _packed(vecs: DataFrame, id_col: str) -> DataFrame:
    """``(id, terms, w, matter, n)``, one row a vector: its entries, how many terms matter in it (``1 / sum w^4``), how many it has."""
    w2 = F.col("w") * F.col("w")
    lists = vecs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("w", F.xxhash64("term").alias("k"))), asc=False).alias("_e"),
        F.coalesce(F.try_divide(F.pow(F.sum(w2), 2), F.sum(w2 * w2)), F.lit(0.0)).alias("matter"), F.count(F.lit(1)).alias("n"))
    return lists.select(id_col, F.col("_e.k").alias("terms"), F.col("_e.w").alias("w"), "matter", "n")


def _write_tiles(vecs: DataFrame, dealt: DataFrame, id_col: str, n_tiles: int) -> str:
    """The folder of ``(members, kind, terms, w)`` by tile: a row for each of ``dealt``, with the vector of its id.

    ``vecs`` may be packed already. ``dealt`` may name the tile ``_t`` and the ``members``; else a hash
    deals, and the id is the only member. Vectors whose heaviest term is the same lie together.
    """
    lists = vecs if "terms" in vecs.columns else _packed(vecs, id_col)
    tile = F.col("_t") if "_t" in dealt.columns else F.pmod(F.xxhash64(id_col), F.lit(n_tiles)).cast("int")
    members = F.col("members") if "members" in dealt.columns else F.array(id_col)
    rows = lists.join(dealt, id_col).select(
        members.alias("members"), F.xxhash64(id_col).alias("kind"), "terms", "w", tile.alias("_t"),
        F.get("terms", F.lit(0)).alias("_top"))
    folder = shared_path(vecs.sparkSession, "cosine-tiles")
    rows.repartition(n_tiles, "_t").sortWithinPartitions("_t", "_top").drop("_top").write.partitionBy("_t").parquet(folder)
    return folder


def _read_part(folder: str, t: int, columns: list[str]) -> list | None:
    """Columns of the files of tile ``t``, each as one array."""
    folder = f"{local_path(folder)}/_t={t}"
    store, place = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    tables = []
    for info in sorted(store.get_file_info(pafs.FileSelector(place, allow_not_found=True)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                tables.append(pq.ParquetFile(f).read(columns))
    rows = pa.concat_tables(tables).combine_chunks() if tables else None
    return [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in rows.columns] if rows else None


def _read_tile(folder: str, t: int) -> Tile | None:
    rows = _read_part(folder, t, ["members", "kind", "terms", "w"])
    if rows is None:
        return None
    members, kind, terms, w = rows
    return Tile(members.flatten(), members.offsets.to_numpy().astype(np.int64), kind.to_numpy(),
                terms.offsets.to_numpy().astype(np.int64), terms.flatten().to_numpy().view(_U), w.flatten().to_numpy())


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[0] .. start[0] + n[0] - 1, start[1] ..``."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - before, n)


class _Scorer:
    """Products of rows of ``a`` with rows of ``b``."""

    def __init__(self, a: Tile, b: Tile):
        self.a, self.b, self.asked = a, b, 0
        self.at: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # terms' numbers in a and b, and a place for each

    def numbered(self, n: int) -> None:
        """Number the terms once ``n`` more pairs make it worth while; before, each product looks its terms up."""
        self.asked += n
        if self.at is None and self.asked > 2 * (len(self.a) + len(self.b)):
            known, at_a = np.unique(self.a.terms, return_inverse=True)
            at_b = np.minimum(np.searchsorted(known, self.b.terms), len(known) - 1)
            at_b[known[at_b] != self.b.terms] = len(known)
            self.at = at_a.astype(np.int32), at_b.astype(np.int32), np.full(len(known) + 1, -1, np.int32)

    def dense(self, rows: np.ndarray, others: np.ndarray, n: np.ndarray, outside: bool) -> np.ndarray:
        """All ``rows`` with all ``others``, over the first ``n`` terms of the first; and with ``outside`` the norms of the
        second in further terms."""
        a, b, known = self.a, self.b, self.at
        e, row = _ranges(a.first[rows], n), np.repeat(np.arange(len(rows)), n)
        terms, at = np.unique(a.terms[e] if known is None else known[0][e], return_inverse=True)
        kind = np.float32 if outside else np.float64
        left = np.zeros((len(rows), len(terms)), kind)
        left[row, at] = a.w[e]
        if outside:
            own = np.zeros_like(left)
            own[row, at] = 1.0
        if known is not None:
            known[2][terms] = np.arange(len(terms), dtype=np.int32)
        out = np.empty((1 + outside, len(rows), len(others)))
        step = max(1, (1 << 22) // len(terms))
        for x in range(0, len(others), step):
            some = others[x:x + step]
            m = b.first[some + 1] - b.first[some]
            e = _ranges(b.first[some], m)
            if known is None:
                at = np.minimum(np.searchsorted(terms, b.terms[e]), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == b.terms[e])
            else:
                at = known[2][known[1][e]]
                hit = np.flatnonzero(at >= 0)
            right = np.zeros((len(some), len(terms)), kind)
            right[np.repeat(np.arange(len(some)), m)[hit], at[hit]] = b.w[e[hit]]
            out[0, :, x:x + step] = left @ right.T
            if outside:
                out[1, :, x:x + step] = np.sqrt(np.maximum(b.norm[some] ** 2 - own @ (right * right).T, 0) + 1e-5)
        if known is not None:
            known[2][terms] = -1
        return out

    def products(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, outside: bool = False) -> np.ndarray:
        """Of vectors ``i`` (ascending) of ``a`` with ``j`` of ``b``, over the first ``n`` terms of each row of ``a``.

        Rows that follow one another and share most partners (they lie by heaviest term) are a matrix product.
        """
        self.numbered(len(i))
        out = np.empty((1 + outside, len(i)))
        begin = np.flatnonzero(np.diff(i, prepend=-1)) if len(i) else i
        end, rows = np.append(begin[1:], len(i)), i[begin]
        ready = [(x, min(x + 64, len(rows))) for x in range(0, len(rows), 64)]
        while ready:
            x, y = ready.pop()
            at = slice(begin[x], end[y - 1])
            others, col = np.unique(j[at], return_inverse=True)
            if y - x > 1 and (8 * len(col) < (y - x) * len(others) or (y - x) * int(n[rows[x:y]].sum()) > 1 << 23):
                ready += [(x, (x + y) // 2), ((x + y) // 2, y)]
            else:
                found = self.dense(rows[x:y], others, n[rows[x:y]], outside)
                out[:, at] = found[:, np.repeat(np.arange(y - x), end[x:y] - begin[x:y]), col]
        return out

    def values(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = self.a.kind[i] == self.b.kind[j]
        return np.where(same, 1.0, self.products(i, j, np.diff(self.a.first))[0])

    def bounds(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the values, from the heavy terms of ``i``: what its others add is at most their norm times that of ``j`` outside."""
        near, outside = self.products(i, j, self.a.heavy, True)
        off = self.a.rest[i] * outside
        return near - (0 if self.plain else off) - 1e-5, near + off + 1e-5  # 32-bit floats are off by less

    @cached_property
    def plain(self) -> bool:
        return self.a.w.min() >= 0 and self.b.w.min() >= 0


def _spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of pairs ``(i, j)`` that join what ``label`` (smallest node of each, kept up to date) holds apart, none too many."""
    kept = [np.zeros(0, np.int64)]
    left = np.arange(len(i))
    while True:
        x, y = label[i[left]], label[j[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(kept)
        upper, at = np.unique(np.maximum(x, y), return_index=True)
        kept.append(left[at])
        label[upper] = np.minimum(x, y)[at]  # always a smaller one: no circle
        while len(moved := np.flatnonzero(label[label] != label)):
            label[moved] = label[label[moved]]


def _blocks(n: int, step: int, growth: int = 1):
    """Slices of ``step`` of ``n``, each ``growth`` times as long as the one before."""
    x = 0
    while x < n:
        yield slice(x, min(x + step, n))
        x, step = x + step, min(step * growth, 1 << 20)


def _passing(a: Tile, b: Tile, same: bool, width: int, threshold: float, lowest: float | None, strict: bool,
             label: np.ndarray | None = None):
    """``(i, j, value)`` of the pairs whose sketches' product reaches ``threshold`` and whose value reaches ``lowest``.

    The heavy terms of ``i`` alone tell most values to within its rest; what may pass is scored on all terms.
    With ``label`` (component of each row of ``a``, then of ``b``, or of ``a`` where they are the same) only pairs that
    join two components; it is kept up to date.
    """
    bound = threshold * (1 - 2e-3) - 1e-5  # products of 32-bit floats are off by less
    shift = 0 if same else len(a)
    most = max(256, (1 << 23) // width)

    scorer = _Scorer(a, b)

    def checked(i: np.ndarray, j: np.ndarray):
        if label is not None:
            keep = label[i] != label[j + shift]
            i, j = i[keep], j[keep]
        if lowest is None or not len(i):
            return i, j, scorer.values(i, j)
        least, most = scorer.bounds(i, j)
        keep = most >= lowest
        i, j, least = i[keep], j[keep], least[keep]
        if label is None:
            value = scorer.values(i, j)
            keep = value > lowest if strict else value >= lowest
            return i[keep], j[keep], value[keep]
        sure = np.flatnonzero(least > lowest)
        sure = sure[_spanning(label, i[sure], j[sure] + shift)]
        rest = np.flatnonzero((least <= lowest) & (label[i] != label[j + shift]))
        value = scorer.values(i[rest], j[rest])
        rest = rest[value > lowest if strict else value >= lowest]
        rest = rest[_spanning(label, i[rest], j[rest] + shift)]
        at = np.sort(np.concatenate([sure, rest]))
        return i[at], j[at], scorer.values(i[at], j[at])

    for whole in _blocks(len(a), most):
        left = a.sketches(width, whole)
        for cols in _blocks(len(b), most):
            if same and cols.stop <= whole.start:
                continue
            right, wide = left.T if same and cols == whole else b.sketches(width, cols).T, None
            for part in _blocks(len(left), max(1, (1 << 23) // right.shape[1])):
                near = left[part] @ right >= bound
                found = np.flatnonzero(near.ravel())
                if len(found) * 200 > near.size:  # many may pass: finer sketches tell more of them apart
                    wide = b.sketches(4 * width, cols).T if wide is None else wide
                    rows = slice(whole.start + part.start, whole.start + part.stop)
                    near &= a.sketches(4 * width, rows) @ wide >= bound
                    found = np.flatnonzero(near.ravel())
                i, j = np.divmod(found, right.shape[1])
                i += whole.start + part.start
                j += cols.start
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                for some in _blocks(len(i), 1 << 20) if label is None else _blocks(len(i), 1 << 14, 2):
                    x, y, value = checked(i[some], j[some])
                    if len(x):
                        yield x, y, value


def _rows_of(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray, value: np.ndarray, same: bool = False, most: int = 100_000):
    """``(id1, id2, value)`` of the members of the rows ``i`` and ``j``; of one row (``same``) each pair once."""
    n, m = a.member[i + 1] - a.member[i], b.member[j + 1] - b.member[j]
    upto = np.cumsum(n * m)
    x = 0
    while x < len(i):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + most, "right")))
        size = (n * m)[x:y]
        at, k = np.repeat(np.arange(x, y), size), _ranges(np.zeros(y - x, np.int64), size)
        p, q = k // m[at], k % m[at]
        if same:
            at, p, q = at[p < q], p[p < q], q[p < q]
        if len(at):
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(a.member[i[at]] + p)), b.ids.take(pa.array(b.member[j[at]] + q)),
                                              pa.array(value[at])], names=["id1", "id2", "value"])
        x = y


def _both(n: int) -> tuple[int, int]:
    """Pairs of tiles (0, 0), (0, 1), (1, 1), (0, 2) ... by number."""
    hi = (math.isqrt(8 * n + 1) - 1) // 2
    return n - hi * (hi + 1) // 2, hi


def _scored_pairs_fn(folder: str, widths: list[int], threshold: float, lowest: float | None, strict: bool):
    def run(batches):
        for batch in batches:
            for n in batch.column("id").to_pylist():
                lo, hi = _both(n)
                a = _read_tile(folder, lo)
                b = a if lo == hi else _read_tile(folder, hi)
                if a is None or b is None:
                    continue
                if a is b and (lowest is None or (1.0 > lowest if strict else 1.0 >= lowest)):
                    i = np.flatnonzero(np.diff(a.member) > 1)
                    yield from _rows_of(a, a, i, i, np.ones(len(i)), same=True)
                for i, j, value in _passing(a, b, a is b, widths[lo], threshold, lowest, strict):
                    yield from _rows_of(a, b, i, j, value)
    return run


def _own_links_fn(folder: str, widths: list[int], threshold: float, strict: bool):
    """A spanning forest of each tile's pairs, with the rows' numbers."""
    def run(batches):
        for batch in batches:
            for t in batch.column("id").to_pylist():
                a = _read_tile(folder, t)
                if a is None:
                    continue
                for i, j, value in _passing(a, a, True, widths[t], threshold, threshold, strict, np.arange(len(a))):
                    for rows in _rows_of(a, a, i, j, value, most=1 << 62):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t, np.int32)), pa.array(i), pa.array(j),
                                                          *rows.columns], names=["_t", "i", "j", "id1", "id2", "value"])
    return run


def _cross_links_fn(folder: str, own: str, widths: list[int], threshold: float, strict: bool):
    """What else links two tiles, given the links ``own`` of each."""
    def labels(t: int, a: Tile) -> np.ndarray:
        label, found = np.arange(len(a)), _read_part(own, t, ["i", "j"])
        if found is not None:
            _spanning(label, *[x.to_numpy() for x in found])
        return label

    def run(batches):
        for batch in batches:
            for n in batch.column("id").to_pylist():
                lo, hi = _both(n)
                hi += 1  # two tiles, never one twice
                a, b = _read_tile(folder, lo), _read_tile(folder, hi)
                if a is None or b is None:
                    continue
                label = np.concatenate([labels(lo, a), labels(hi, b) + len(a)])
                for i, j, value in _passing(a, b, False, widths[lo], threshold, threshold, strict, label):
                    yield from _rows_of(a, b, i, j, value)
    return run


@dataclass
class Dealt:
    """Tiles by the number of terms that matter, fewest first: a sketch as wide as the lower tile of a pair needs will do."""

    folder: str
    widths: list[int]
    ids: DataFrame  # of the vectors


def _deal(vecs: DataFrame, classes: DataFrame | None, id_col: str, threshold: float, block_docs: int,
          most_members: int = 256) -> Dealt:
    """Vectors packed and stored by tile, those of representatives only where ``classes`` are given, a row for each ``most_members`` copies."""
    spark = vecs.sparkSession
    if classes is not None:
        vecs = _representatives(vecs, classes, id_col)
    path = shared_path(spark, "cosine-vectors")
    _packed(vecs, id_col).write.parquet(path)
    packed = spark.read.parquet(path)
    octave = F.floor(F.log2(F.greatest("matter", F.lit(1.0))) * 4).cast("int").alias("_o")  # a quarter of one
    rows = packed.select(id_col, octave, "n")
    salt = F.xxhash64(id_col)
    if classes is not None:
        kept = classes.filter(F.col(id_col).isNotNull() & F.col("rep").isNotNull())
        size = kept.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"))
        part = F.pmod(F.xxhash64(id_col), F.ceil(F.col("_n") / most_members)).alias("_part")
        members = kept.join(size, "rep").select(F.col("rep"), part, F.col(id_col).alias("_id")).groupBy("rep", "_part").agg(
            F.collect_list("_id").alias("members"))
        rows = rows.join(members.withColumnRenamed("rep", id_col), id_col)
        salt = F.xxhash64(id_col, "_part")
    rows = materialize(rows)
    sizes = rows.groupBy("_o").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("e")).orderBy("_o").collect()  # 256 rows at most
    # At most 32 MB of vectors in a tile, tile pairs for all cores.
    n, total = (sum(x[c] for x in sizes) for c in ("r", "e"))
    most_rows = max(1, min(block_docs, max(2048, -(-n // 8))))
    most_entries = min(1 << 21, max(1 << 18, -(-total // 8)))
    groups: list[list] = []
    for x in sizes:
        if groups and groups[-1][1] + x.r <= most_rows and groups[-1][2] + x.e <= most_entries:
            groups[-1] = [groups[-1][0] + [x["_o"]], groups[-1][1] + x.r, groups[-1][2] + x.e]
        else:
            groups.append([[x["_o"]], x.r, x.e])
    share = max(threshold, 0.1) ** 2
    widths, first, parts = [], [], []
    for octaves, r, e in groups:
        k = max(1, -(-r // most_rows), -(-e // most_entries))
        width = 64 * max(4, min(1024, math.ceil(2 ** ((octaves[-1] + 1) / 4) / share / 64)))
        first += [(o, len(widths), k) for o in octaves]
        widths += [width] * k
    tile = F.lit(0)
    for o, start, k in first:
        tile = F.when(F.col("_o") == o, F.lit(start) + F.pmod(salt, F.lit(k))).otherwise(tile)
    dealt = rows.select(id_col, tile.cast("int").alias("_t"), *(["members"] if classes is not None else []))
    return Dealt(_write_tiles(packed, dealt, id_col, max(1, len(widths))), widths, rows.select(id_col))


def _tasks(spark, n: int, fn, schema: str) -> DataFrame:
    """A task for each number below ``n``. How many rows come of it the planner cannot tell, so it is not given the numbers' size."""
    return unsized(spark.range(0, n, 1, max(1, n))).mapInArrow(fn, schema)


def scored_candidates(vecs: DataFrame, id_col: str, threshold: float, lowest: float | None = None, strict: bool = False,
                      tile_size: int = 1 << 15, classes: DataFrame | None = None) -> DataFrame:
    """``(id1, id2, value)`` of the pairs whose sketches' product reaches the threshold; a task for each tile pair.

    Only values of ``lowest`` or more (above it if ``strict``) are handed on, where it is given.
    A sketch is as wide as the vector with fewer terms that matter in a pair needs (``1 / sum w^4``). With ``classes`` one
    vector of each is compared, and its pairs are handed on for all members.
    """
    d = _deal(vecs, classes, id_col, threshold, tile_size)
    id_type, n = vecs.schema[id_col].dataType.simpleString(), len(d.widths)
    found = _tasks(vecs.sparkSession, n * (n + 1) // 2, _scored_pairs_fn(d.folder, d.widths, threshold, lowest, strict),
                   f"id1 {id_type}, id2 {id_type}, value double")
    return P.canonical(found, "id1", "id2")


def candidates(vecs: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Pairs ``(id1, id2)`` whose sketches' product reaches the threshold."""
    return scored_candidates(vecs, id_col, threshold).select("id1", "id2")


def _representatives(vecs: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    reps = classes.filter(F.col("rep") == F.col(id_col)).select(id_col)
    return vecs.join(reps, id_col, "left_semi")


def sparse_cosine_pairs(vecs: DataFrame, id_col: str = "doc_id", threshold: float = 0.8,
                        strict: bool = False, tile_size: int = P.DEFAULT_TILE, block_docs: int = 1 << 15,
                        classes: DataFrame | None = None) -> DataFrame:
    """All pairs ``(id1, id2, value)`` of unit sparse vectors with cosine >= t (> t if strict).

    ``vecs`` has ``(id, term, w)`` and is read once. With ``classes`` (``equal_classes``) only representatives are joined
    and scored. Tiles hold at most ``block_docs`` vectors; copies of one stand in rows of at most ``tile_size`` / 8, so that
    those of a large class are spread over the tiles.
    """
    return scored_candidates(vecs, id_col, threshold, threshold, strict, block_docs, classes)


def cosine_links(vecs: DataFrame, classes: DataFrame, id_col: str = "doc_id", threshold: float = 0.8,
                 strict: bool = False, tile_size: int = P.DEFAULT_TILE) -> DataFrame:
    """Links ``(id1, id2, value)`` with the components of all qualifying pairs, without cliques.

    Of the qualifying pairs of representatives a spanning forest of each tile, and what links two tiles beyond
    their own forests; one link from each copy to its representative.
    """
    spark, id_type = vecs.sparkSession, vecs.schema[id_col].dataType.simpleString()
    d = _deal(_representatives(vecs, classes, id_col), None, id_col, threshold, 1 << 15)
    n, path = len(d.widths), shared_path(spark, "cosine-links")
    kind = f"id1 {id_type}, id2 {id_type}, value double"
    own = f"_t int, i long, j long, {kind}"
    _tasks(spark, n, _own_links_fn(d.folder, d.widths, threshold, strict), own).write.partitionBy("_t").parquet(path)
    cross = _tasks(spark, n * (n - 1) // 2, _cross_links_fn(d.folder, path, d.widths, threshold, strict), kind)
    found = P.canonical(unsized(spark.read.schema(own).parquet(path)).select("id1", "id2", "value").unionByName(cross), "id1", "id2")
    if threshold > 1 or strict and threshold >= 1:
        return found
    star = classes.filter(F.col("rep") != F.col(id_col)).join(
        d.ids.withColumnRenamed(id_col, "rep"), "rep", "left_semi")  # a bag without a vector has no links
    return found.unionByName(star.select(F.col("rep").alias("id1"), F.col(id_col).alias("id2"),
                                         F.lit(1.0).alias("value")))


def _read_vectors(folder: str, t: int) -> tuple[pa.Array, np.ndarray] | None:
    """Ids and unit vectors of a tile; a zero vector has no direction and passes no threshold."""
    rows = _read_part(folder, t, ["id", "vec"])
    if rows is None:
        return None
    ids, vec = rows
    if len(np.unique(np.diff(vec.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length")
    mat = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
    norms = np.linalg.norm(mat, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ids, mat / norms[:, None]


def _dense_pairs_fn(folder: str, threshold: float):
    def run(batches):
        for batch in batches:
            for n in batch.column("id").to_pylist():
                lo, hi = _both(n)
                a = _read_vectors(folder, lo)
                b = a if lo == hi else _read_vectors(folder, hi)
                if a is None or b is None:
                    continue
                for part in _blocks(len(a[1]), max(1, (1 << 21) // len(b[1]))):
                    sims = a[1][part] @ b[1].T
                    i, j = np.divmod(np.flatnonzero((sims >= threshold).ravel()), sims.shape[1])
                    keep = i + part.start < j if a is b else slice(None)
                    i, j = i[keep], j[keep]
                    for some in _blocks(len(i), 100_000):
                        yield pa.RecordBatch.from_arrays([a[0].take(pa.array(i[some] + part.start)), b[0].take(pa.array(j[some])),
                                                          pa.array(sims[i[some], j[some]])], names=["id1", "id2", "value"])
    return run


def dense_cosine_pairs(vectors: DataFrame, id_col: str, vec_col: str, threshold: float,
                       tile_size: int = 2048) -> DataFrame:
    """Exact all-pairs dense cosine >= t by tile-pair matrix products; ids of any type.

    Vectors are stored once, by tile; a task reads the tiles of its pair from the shared folder. A tile
    has about ``tile_size`` vectors, or four times as many where there are over 64 of these.
    """
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    path, folder = shared_path(spark, "dense-vectors"), shared_path(spark, "dense-tiles")
    vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("vec IS NOT NULL").write.parquet(path)
    stored = spark.read.parquet(path)
    n = stored.count()
    n_tiles = max(1, -(-n // (tile_size if n <= 64 * tile_size else 4 * tile_size)))
    tile = F.pmod(F.xxhash64("id"), F.lit(n_tiles)).cast("int").alias("_t")
    stored.select("id", "vec", tile).repartition(n_tiles, "_t").write.partitionBy("_t").parquet(folder)
    found = _tasks(spark, n_tiles * (n_tiles + 1) // 2, _dense_pairs_fn(folder, threshold),
                   f"id1 {id_type}, id2 {id_type}, value double")
    return P.canonical(found, "id1", "id2")
