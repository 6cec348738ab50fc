"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

Two texts link when ``100 * |A ∩ B| >= similarity * |A ∪ B|`` on their sets of
distinct 5-word shingles. The candidate search loses no such pair:

* Sizes are cut into bands. Scheme ``k`` covers pairs whose smaller set lies in
  band ``k``; a set takes part in the schemes of its own band and of the bands
  in which a smaller partner may lie.
* A scheme hashes the shingle universe into ``m`` segments. The subset of a set
  inside a segment is indexed by a signature; in ``u`` of the segments so are its
  one-deletion neighbours, which meet whenever the two subsets differ by at most
  one shingle. Plain segments cover one difference, deletion segments two, so
  sets that differ in at most ``H`` shingles must meet in some segment as soon as
  the coverage both sides keep exceeds ``H``.
* Allocation by cost: per band, ``m``, ``u`` and the spare coverage are the
  cheapest under a model of index rows and unselective segments
  (``scheme_for``). Per set, the spare coverage is spent on leaving out its
  costliest segments: empty ones, and those whose rarest shingle is frequent
  among the texts read along with it. Each side may drop half the spare, which
  keeps the common coverage above ``H`` whatever the other side drops.

Sets are handled by class: texts with equal sets share a 64-bit class hash, are
sent once per batch of rows, and are never compared. In a signature's bucket the
members are first verified against one of them only, then, where a bucket still
holds several components, against the member with most links; last, every pair
across components is verified that sizes and sketches do not rule out; large buckets
are cut into tiles for that, and a task hands on a pair once. A group
of near copies thus costs rows in proportion to its size, and no link is lost.
Verification intersects the full shingle sets.

Null and empty texts (or texts without a word) have an empty set, size 0, and
link with nothing. Equal rows and repeated ids keep one output row each. Other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm import textops as T
from nearspark.llm.staging import partitions_for, stage
from nearspark.operators.graph import connected_components
from nearspark.operators.pairs import tile_keys

_U = np.uint64
FILTER_BITS = 24  # 2 MiB as packed bits, whatever the corpus
GROUPS = 512  # counters of a sketch: few of its shingles share one, so near misses are told apart
HUB_ROUNDS = 1
TILE = 1024  # members of a bucket compared with one another at a time
PAIRS_HELD = 1_000_000
BROADCAST_ROWS = 200_000  # of two longs


def largest_partner(s: int, similarity: int) -> int:
    return 100 * s // similarity


def smallest_partner(s: int, similarity: int) -> int:
    return -(-similarity * s // 100)


def max_difference(a: int, b: int, similarity: int) -> int:
    """Largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
    shared = -(-similarity * (a + b) // (100 + similarity))
    return a + b - 2 * shared


@lru_cache(maxsize=None)
def band_edges(similarity: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, 100 * edges[-1] // similarity))
    return tuple(edges)


def band_of(s: int, similarity: int) -> int:
    return int(np.searchsorted(band_edges(similarity), s, side="right")) - 1


def _excess(mean: float, spare: int) -> float:
    """Expected amount by which a Poisson variable exceeds ``spare``."""
    p, below, total = math.exp(-mean), 0.0, 0.0
    for j in range(spare + 1):
        below += p
        total += (spare - j) * p
        p *= mean / (j + 1)
    return max(0.0, mean - spare + total) if spare < 4 * mean + 40 else 0.0


@lru_cache(maxsize=None)
def scheme_for(band: int, similarity: int) -> tuple[int, int]:
    """``(m, u)`` of a band: all segments, and those indexed with deletions."""
    lo, hi = band_edges(similarity)[band], band_edges(similarity)[band + 1] - 1
    need = max(max_difference(a, largest_partner(a, similarity), similarity)
               for a in range(max(lo, hi - 9), hi + 1)) + 1
    best = None
    for spare in sorted({*range(0, min(need, 8) + 1), *(round(need * f / 20) for f in range(1, 7))}):
        cover = need + 2 * spare
        for f in (1, 2, 4, 8, 16):  # deletion segments, in sixteenths of all
            m = max(1, min(cover - 1, round(cover / (1 + f / 16))))
            u = cover - m
            if u > m:
                continue
            load = lo / m
            plain, deleted = (m - u) * math.exp(-load), u * math.exp(-load)
            empty = _excess(plain + 2 * deleted * (1 + load), spare)
            single = _excess(plain * (1 + load) + 2 * deleted * (1 + load + load * load / 2), spare)
            cost = (m - u) + u * (1 + load) - spare + single + 100 * empty
            if best is None or cost < best[0]:
                best = (cost, m, u)
    return best[1], best[2]


def set_difference_bound(s: int, band: int, similarity: int) -> int:
    """Largest difference of a set of size ``s`` from any partner in the scheme of ``band``."""
    lo, hi = band_edges(similarity)[band], band_edges(similarity)[band + 1] - 1
    if s <= hi:  # the smaller side, or both in the band
        return max_difference(s, largest_partner(s, similarity), similarity)
    small = max(smallest_partner(s, similarity), lo)
    return max(max_difference(a, s, similarity) for a in {small, *range(max(small, hi - 9), hi + 1)} if a <= hi)


def signatures(shingles: np.ndarray, df: np.ndarray, similarity: int) -> np.ndarray:
    """All signatures of one set (distinct shingles, and how common each is nearby)."""
    s = len(shingles)
    out = []
    for band in range(band_of(smallest_partner(s, similarity), similarity), band_of(s, similarity) + 1):
        m, u = scheme_for(band, similarity)
        salt = T.mix(np.array([band + 1], np.uint64))[0]
        token = T.mix(shingles + salt)
        seg = ((token >> _U(32)) * _U(m)) >> _U(32)
        order = np.argsort(seg.astype(np.uint16) if m < 1 << 16 else seg, kind="stable")
        seg, token = seg[order].astype(np.int64), token[order]
        token = T.mix(token ^ salt)
        count = np.bincount(seg, minlength=m)
        ends = np.cumsum(count)
        total = np.zeros(s + 1, np.uint64)
        np.cumsum(token, out=total[1:])
        subset = total[ends] - total[ends - count]
        cost = np.full(m, np.iinfo(np.int64).max // 2)
        some = count > 0
        cost[some] = np.minimum.reduceat(df[order], (ends - count)[some]) * 64 // np.minimum(count[some], 8)
        if u:
            cost[:u][count[:u] == 1] = np.iinfo(np.int64).max // 2  # its deletion is the empty subset
        spare = (m + u - set_difference_bound(s, band, similarity) - 1) // 2
        keep = np.ones(m, bool)
        if spare > 0:
            weight = np.where(np.arange(m) < u, 2, 1)
            worst = np.argsort(-cost, kind="stable")[:spare]
            keep[worst[np.cumsum(weight[worst]) <= spare]] = False
        key = T.mix(salt + np.arange(1, m + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        out.append(T.mix(subset[keep] ^ key[keep]))
        if u:
            chosen = (seg < u) & keep[seg]
            out.append(T.mix((subset[seg[chosen]] - token[chosen]) ^ key[seg[chosen]]))
    return np.concatenate(out)


def class_hash(distinct: np.ndarray) -> np.uint64:
    tokens = np.append(T.mix(distinct ^ _U(0x5851F42D4C957F2D)), _U(len(distinct)))
    return T.mix(tokens.sum(dtype=np.uint64, keepdims=True))[0]


def _sets(batch: pa.RecordBatch, k: int):
    """Per slice of rows: first row and the list of distinct shingle arrays."""
    T.keep_memory_low()
    for a, n, data, off in T.text_slices(batch):
        h, first = T.shingles_of(data, off, k)
        yield a, [np.unique(h[first[i]:first[i + 1]]) for i in range(n)]
    T.give_back_memory()


def sketch(distinct: np.ndarray) -> bytes:
    """Shingles per hash group, cut at 255. The L1 distance of two sketches never
    exceeds the symmetric difference of the sets."""
    counts = np.bincount((T.mix(distinct) >> _U(65 - GROUPS.bit_length())).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_link(n1, sk1: np.ndarray, n2, sk2: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of sets (sizes, sketch rows) the sizes and sketches do not rule out."""
    total = n1 + n2
    most = total - 2 * -(-similarity * total // (100 + similarity))
    apart = np.abs(sk1.astype(np.int16) - sk2.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return (np.abs(n1 - n2) <= most) & (apart <= most)


def _describe(k: int):
    def run(batches):
        for batch in batches:
            sizes, classes, sketches = [], [], []
            for _, sets in _sets(batch, k):
                sizes += [len(x) for x in sets]
                sketches += [sketch(x) for x in sets]
                classes.append(np.array([class_hash(x) if len(x) else 0 for x in sets], np.uint64))
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(T.signed(np.concatenate(classes))),
                     pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "cls", "sk"])
    return run


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, cls, sk)``: set size, class hash and sketch of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _describe(k), f"doc_id {kind}, n_shingles long, cls long, sk binary")


def _index(k: int, similarity: int, parts: int):
    """Index rows of each slice, dealt by signature: one row per slice and part, owners as runs."""
    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, sets in _sets(batch, k):
                cls = [int(class_hash(x)) if len(x) else 0 for x in sets]
                fresh = []
                for c, x in zip(cls, sets):
                    if len(x) and c not in seen:
                        seen.add(c)
                        fresh.append((c, x))
                if not fresh:
                    continue
                _, where, counts = np.unique(np.concatenate([x for _, x in fresh]),
                                             return_inverse=True, return_counts=True)
                df, at, sig, own = counts[where], 0, [], []
                for c, x in fresh:
                    got = signatures(x, df[at:at + len(x)], similarity)
                    at += len(x)
                    sig.append(got)
                    own.append(np.full(len(got), c, np.uint64))
                sig, own = np.concatenate(sig), np.concatenate(own)
                part = ((sig >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
                order = np.lexsort((own, part))
                sig, own, part = T.signed(sig[order]), T.signed(own[order]), part[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
                one = np.concatenate([[0], np.flatnonzero((np.diff(part) != 0) | (np.diff(own) != 0)) + 1])
                offs = pa.array(np.append(cut, len(part)).astype(np.int32))
                owned = pa.array(np.append(np.searchsorted(one, cut), len(one)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut]), pa.ListArray.from_arrays(offs, pa.array(sig)),
                     pa.ListArray.from_arrays(owned, pa.array(own[one])),
                     pa.ListArray.from_arrays(owned, pa.array(np.diff(one, append=len(part)).astype(np.int32)))],
                    names=["part", "sigs", "owners", "runs"])
    return run


def _buckets(table: pa.Table) -> pa.Table:
    """Member lists of the signatures that at least two classes share; equal lists once."""
    sig = table.column("sigs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    own = np.repeat(*(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                      for c in ("owners", "runs")))
    order = np.argsort(sig, kind="stable")
    sig, own = sig[order], own[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    in_group = same.copy()
    in_group[:-1] |= same[1:]
    sig, own = sig[in_group], own[in_group]
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    if len(sig):
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[fresh], own[fresh]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [len(sig)]])).astype(np.int64)
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(T.mix(own.view(np.uint64)), out=total[1:])
    name = T.mix(total[start + size] - total[start] + size.astype(np.uint64)) if len(sig) else np.zeros(0, np.uint64)
    _, one = np.unique(name, return_index=True)
    one = one[size[one] >= 2]
    lists = [own[start[i]:start[i] + size[i]] for i in one]
    return pa.table({"bucket": pa.array(T.signed(name[one])),
                     "members": pa.array(lists, pa.list_(pa.int64()))})


def _packed_filter(ids: DataFrame, col: str) -> np.ndarray:
    """Fixed-size presence filter of a column, gathered as at most 2**18 words."""
    word = F.shiftrightunsigned(F.xxhash64(col), 64 - FILTER_BITS)
    rows = (ids.select(word.alias("w0")).groupBy(F.shiftright("w0", 6).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(w0 & 63 as int)))").alias("b")))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = rows.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out


def _pass_filter(docs: DataFrame, col: str, words: np.ndarray) -> DataFrame:
    """Rows whose id may be in the filter (its hash is made by Spark, looked up in Arrow batches)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            x = batch.column("_h").to_numpy().view(np.uint64) >> _U(64 - FILTER_BITS)
            held = (shared.value[(x >> _U(6)).astype(np.int64)] >> (x & _U(63)).astype(np.int64)) & 1 == 1
            yield batch.drop_columns(["_h"]).filter(pa.array(held))

    return docs.withColumn("_h", F.xxhash64(col)).mapInArrow(run, docs.schema)


def _shingle_arrays(k: int):
    def run(batches):
        for batch in batches:
            want = batch.column("cls").to_numpy().view(np.uint64)
            for a, sets in _sets(batch.drop_columns(["cls"]), k):
                # rows that repeat an id may hold another text
                own = [i for i, x in enumerate(sets) if len(x) and class_hash(x) == want[a + i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(want[[a + i for i in own]])),
                     pa.array([T.signed(sets[i]) for i in own], pa.list_(pa.int64()))], names=["cls", "sh"])
    return run


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``(a, b)`` that link, by intersecting whole sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("sh").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("sh").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(100 * shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _sets_for(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Shingle arrays of the classes in ``pairs``, from one text of each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = stage(classes.join(wanted, "cls").select("cls", F.col("rep").alias("_id")), "op9-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        texts = docs.join(F.broadcast(wanted), "_id")
    else:  # a shuffled join, of the rows that may match
        texts = _pass_filter(docs, "_id", _packed_filter(wanted, "_id")).join(wanted, "_id")
    texts = texts.select("text", "cls")
    return texts.mapInArrow(_shingle_arrays(k), "cls long, sh array<long>")


def _rows_of(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _plausible(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Drop pairs that sizes or sketches rule out."""
    def run(batches):
        for x in batches:
            if x.num_rows:
                ok = may_link(x.column("na").to_numpy(), _rows_of(x.column("ska")),
                              x.column("nb").to_numpy(), _rows_of(x.column("skb")), similarity)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    both = (pairs.join(classes.selectExpr("cls AS a", "n AS na", "sk AS ska"), "a")
            .join(classes.selectExpr("cls AS b", "n AS nb", "sk AS skb"), "b"))
    near = both.filter((100 * F.col("na") >= similarity * F.col("nb"))
                       & (100 * F.col("nb") >= similarity * F.col("na")))
    return near.mapInArrow(run, "a long, b long")


class _PlausiblePairs:
    """Distinct pairs of a family's tiles, which share most of theirs, tested by their sketches once.

    Tested and forgotten whenever ``PAIRS_HELD`` are held.
    """

    def __init__(self, similarity: int, members: list[tuple[int, int, bytes]]):
        members.sort()
        self.similarity = similarity
        self.cls, self.n = (np.array([m[i] for m in members], np.int64) for i in (0, 1))
        self.sk = np.frombuffer(b"".join(m[2] for m in members), np.uint8).reshape(-1, GROUPS)
        self.pairs, self.held = [], 0

    def add(self, a: list[np.ndarray], b: list[np.ndarray]):
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            self.pairs.append(np.vstack([np.minimum(a, b), np.maximum(a, b)]))
            self.held += len(a)
        if self.held >= PAIRS_HELD:
            self.pairs = [self._distinct()]
            self.held = self.pairs[0].shape[1]
            if self.held >= PAIRS_HELD // 2:
                yield from self.tested()

    def _distinct(self) -> np.ndarray:
        x = np.hstack(self.pairs)
        x = x[:, np.lexsort(x[::-1])]
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[:, 1:] != x[:, :-1]).any(axis=0)
        return x[:, new]

    def tested(self):
        if self.held:
            a, b = self._distinct()
            x, y = np.searchsorted(self.cls, a), np.searchsorted(self.cls, b)
            for i in range(0, len(a), 20_000):
                o = slice(i, i + 20_000)
                ok = may_link(self.n[x[o]], self.sk[x[o]], self.n[y[o]], self.sk[y[o]], self.similarity)
                if ok.any():
                    yield a[o][ok], b[o][ok]
        self.pairs, self.held = [], 0


def _tile_pairs(members: pa.Scalar, lo: int, hi: int, similarity: int) -> tuple[list, list]:
    """Pairs of a tile's members of different components whose sizes allow a link."""
    flat = members.values
    cls, comp, n, tile = (flat.field(f).to_numpy() for f in ("cls", "comp", "n", "_t"))
    order = np.argsort(n, kind="stable")
    cls, comp, n, tile = cls[order], comp[order], n[order], tile[order]
    to = np.searchsorted(n, 100 * n.astype(np.int64) // similarity, side="right")
    left, right = [], []
    for i in range(len(cls) - 1):
        o = slice(i + 1, to[i])
        ok = comp[o] != comp[i]
        if lo != hi:  # pairs within a tile are met where both tiles are the same
            ok &= tile[o] != tile[i]
        other = cls[o][ok]
        left.append(np.full(len(other), cls[i]))
        right.append(other)
    return left, right


def _cross_pairs(similarity: int):
    """Plausible pairs of each family: rows of its members' sketches come first, then its tiles."""
    def run(batches):
        key, members, pairs, out, held = None, [], None, [], 0

        def flush():
            a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("_least", "_lo", "_hi")])
            cls, n, sk, tiles = (batch.column(c) for c in ("cls", "n", "sk", "members"))
            for i, k in enumerate(keys):
                if k != key:
                    out += pairs.tested() if pairs else []
                    key, members, pairs = k, [], None
                if cls[i].is_valid:
                    members.append((cls[i].as_py(), n[i].as_py(), sk[i].as_py()))
                    continue
                pairs = pairs or _PlausiblePairs(similarity, members)
                out += pairs.add(*_tile_pairs(tiles[i], k[1], k[2], similarity))
                held = sum(len(a) for a, _ in out) if len(out) > 50 else 0
                if held > 100_000:
                    yield flush()
                    out = []
        out += pairs.tested() if pairs else []
        yield flush()
        T.give_back_memory()
    return run


def _pairs_with_hub(star: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of each row's hub and member."""
    return star.filter("hub != cls").select(
        F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()


def _mixed_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """``(bucket, cls, comp)`` of the buckets whose members lie in several components."""
    entries = (buckets.filter(F.size("members") > 2).select("bucket", F.explode("members").alias("cls"))
               .join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    mixed = entries.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return entries.join(mixed.select("bucket"), "bucket", "left_semi")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       similarity: int = 80, k: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: links' components, named by their smallest id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(spark, n_bytes)
    described = stage(describe(docs, "_id", "text", k), "op9-sets")
    classes = stage(described.filter("n_shingles > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sk").alias("sk")), "op9-classes")

    indexed = docs.select("text").mapInArrow(
        _index(k, similarity, parts), "part int, sigs array<long>, owners array<long>, runs array<int>")
    buckets = indexed.groupBy("part").applyInArrow(_buckets, "bucket long, members array<long>")
    hub = "array_min(transform(members, c -> named_struct('o', xxhash64(c, pmod(bucket, 2)), 'c', c))).c"
    buckets = stage(buckets.groupBy("bucket").agg(F.first("members").alias("members")).withColumn("hub", F.expr(hub)),
                    "op9-buckets")

    # Round 0: each bucket's members against one of them, by one of two fixed orders.
    star = buckets.select("hub", F.explode("members").alias("cls"))
    pairs = stage(_plausible(_pairs_with_hub(star), classes, similarity), "op9-pairs")
    edges = stage(_verify(pairs, _sets_for(pairs, classes, docs, k), similarity), "op9-edges")
    comps = _components(edges)
    # Hub rounds: in buckets that still hold several components, against the member with most links.
    for _ in range(HUB_ROUNDS):
        links = edges.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
        mixed = _mixed_buckets(buckets, comps).join(links, "cls", "left").fillna(0, ["links"])
        hubs = mixed.groupBy("bucket").agg(F.max(F.struct("links", "cls", "comp")).alias("hub"))
        star = (mixed.join(hubs, "bucket").filter(F.col("comp") != F.col("hub.comp"))
                .select(F.col("hub.cls").alias("hub"), "cls"))
        more = _pairs_with_hub(star).join(pairs, ["a", "b"], "left_anti")
        more = stage(_plausible(more, classes, similarity), "op9-pairs")
        new = stage(_verify(more, _sets_for(more, classes, docs, k), similarity), "op9-edges")
        pairs = pairs.union(more)
        if new.isEmpty():
            break
        edges = edges.union(new)
        comps = _components(edges)
    # What is left: every plausible pair of a bucket across components, in tiles of a bucket. Tiles of
    # equal place and smallest member are a family: they share most pairs, and meet in a task that takes
    # in each member's sketch once and hands on each pair once.
    sized = _mixed_buckets(buckets, comps).join(classes.select("cls", "n"), "cls")
    tiles = (tile_keys(sized, ["bucket"], "cls", ["comp", "n"], TILE).groupBy("bucket", "_lo", "_hi")
             .agg(F.collect_list(F.struct("cls", "comp", "n", "_t")).alias("members"), F.min("cls").alias("_least")))
    tiles = stage(tiles.select("_least", "_lo", "_hi", "members"), "op9-tiles")
    family = ["_least", "_lo", "_hi"]
    sketches = (tiles.select(*family, F.explode("members.cls").alias("cls")).distinct()
                .join(classes.select("cls", "n", "sk"), "cls"))
    rows = sketches.select(*family, "cls", "n", "sk").unionByName(tiles, allowMissingColumns=True)
    rest = (rows.repartition(*family).sortWithinPartitions(*family, F.col("cls").asc_nulls_last())
            .mapInArrow(_cross_pairs(similarity), "a long, b long").distinct())
    rest = stage(rest.join(pairs, ["a", "b"], "left_anti"), "op9-rest")
    new = stage(_verify(rest, _sets_for(rest, classes, docs, k), similarity), "op9-edges")
    if not new.isEmpty():
        comps = _components(edges.union(new))

    linked = classes.join(comps, "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    named = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = linked.join(named, "comp").select("cls", "component_id")
    return described.drop("sk").join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(edges: DataFrame) -> DataFrame:
    """``(cls, comp)`` of the classes that have links."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    e = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return stage(connected_components(nodes, e).select(
        F.col("id").alias("cls"), F.col("component").alias("comp")), "op9-components")
