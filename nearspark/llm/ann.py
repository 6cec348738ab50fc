"""Approximate nearest neighbours: one navigable small-world graph per shard.

Rows are dealt to shards of about ``SHARD_ROWS`` distinct vectors by a hash. A
shard's index is one row of flat arrays: ids, vectors, the base level's neighbour
array (``2 * M`` slots a node, -1 where unused), and the upper levels' nodes and
neighbours. The query set meets every shard in blocks; each pair of a block and a
shard gives its best rows, scored exactly in double precision, and a ranking per
query merges them.

Nearness is the largest inner product. The graph is built on vectors lengthened by
one component that makes all norms equal, which turns it into plain nearness.
Points enter in growing batches that are searched in step: every step expands one
node of each search, one NumPy call for all.

Equal vectors share a node, which carries the ``k + 1`` smallest ids (more can
never be among the ``k`` nearest, as ties go to the smaller id). Rows whose vector
is null, zero, or holds a null or a non-finite component take no part, nor do rows
with a null id or vectors of another length than most. An id that repeats is found
with each of its vectors, and asks with the smallest of them. Ties of what is found go
to the smaller id. Fewer candidates than ``k`` give fewer rows, an empty table none.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearspark.llm.staging import stage

SHARD_ROWS = 8192
M = 16
EF_BUILD = 96
EF_SEARCH = 160
QUERY_BLOCK = 1024
_STEP = 256  # searches in step


def _search(q: np.ndarray, entry: np.ndarray, x: np.ndarray, links: np.ndarray, ef: int):
    """Best ``ef`` nodes per query by best-first search: ``(nodes, nearness)``, -1 where fewer."""
    n_q = len(q)
    nodes = np.full((n_q, ef), -1, np.int64)
    near = np.full((n_q, ef), -np.inf, np.float32)
    done = np.ones((n_q, ef), bool)
    seen = np.zeros((n_q, len(x) + 1), bool)
    seen[:, -1] = True  # slot of -1
    entry = entry.reshape(n_q, -1)
    w = min(entry.shape[1], ef)
    nodes[:, :w] = entry[:, :w]
    near[:, :w] = np.where(entry[:, :w] >= 0, np.einsum("qd,qwd->qw", q, x[entry[:, :w]]), -np.inf)
    done[:, :w] = entry[:, :w] < 0
    seen[np.arange(n_q)[:, None], entry[:, :w]] = True
    rows = np.arange(n_q)
    while len(rows):
        open_near = np.where(done[rows], -np.inf, near[rows])
        best = open_near.argmax(axis=1)
        alive = open_near[np.arange(len(rows)), best] > -np.inf
        rows, best = rows[alive], best[alive]
        if not len(rows):
            break
        done[rows, best] = True
        new = links[nodes[rows, best]]
        fresh = ~seen[rows[:, None], new]
        seen[rows[:, None], new] = True
        score = np.where(fresh, np.einsum("qd,qwd->qw", q[rows], x[new]), -np.inf).astype(np.float32)
        all_near = np.concatenate([near[rows], score], axis=1)
        keep = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
        near[rows] = np.take_along_axis(all_near, keep, 1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], new], axis=1), keep, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], axis=1), keep, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, np.take_along_axis(nodes, order, 1), -1), near


def _choose(at: np.ndarray, cand: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Diverse neighbours: a candidate stays if it is nearer to the node than to any kept one."""
    same = (cand == at[:, None]) | (cand < 0)
    ordered = np.sort(np.where(same, -1, cand), axis=1)
    dup = np.zeros_like(same)
    dup[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    cand = np.where(dup, -1, ordered)
    v = x[cand]
    near = np.where(cand >= 0, np.einsum("nd,ncd->nc", x[at], v), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    v = x[cand]
    between = np.einsum("ncd,ned->nce", v, v)
    kept = np.zeros(cand.shape, bool)
    count = np.zeros(len(at), np.int64)
    for i in range(cand.shape[1]):
        closest = np.where(kept, between[:, i, :], -np.inf).max(axis=1)
        take = (cand[:, i] >= 0) & (near[:, i] > closest) & (count < most)
        kept[:, i] = take
        count += take
    # fill up with the nearest of the rest
    for i in range(cand.shape[1]):
        take = (cand[:, i] >= 0) & ~kept[:, i] & (count < most)
        kept[:, i] |= take
        count += take
    first = np.argsort(~kept, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(kept, cand, -1), first, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def _insert(batch: np.ndarray, found: np.ndarray, x: np.ndarray, links: np.ndarray) -> None:
    """Link the nodes of ``batch`` to the candidates found, and back."""
    width = links.shape[1]
    if len(batch) > 1:  # the nearest of the same batch are candidates as well
        among = x[batch] @ x[batch].T
        np.fill_diagonal(among, -np.inf)
        mates = np.argsort(-among, axis=1)[:, :min(width, len(batch) - 1)]
        found = np.concatenate([found, batch[mates]], axis=1)
    for i in range(0, len(batch), _STEP):
        part = batch[i:i + _STEP]
        links[part] = _choose(part, found[i:i + _STEP], x, width)
    src = np.repeat(batch, width)
    dst = links[batch].reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    target, start, n = np.unique(dst, return_index=True, return_counts=True)
    for i in range(0, len(target), _STEP):
        t, s, c = target[i:i + _STEP], start[i:i + _STEP], n[i:i + _STEP]
        back = np.full((len(t), int(c.max())), -1, np.int64)
        fill = np.arange(back.shape[1]) < c[:, None]
        back[fill] = np.concatenate([src[a:a + b] for a, b in zip(s, c)])
        links[t] = _choose(t, np.concatenate([links[t], back], axis=1), x, width)


def _levels(n: int) -> np.ndarray:
    draw = np.random.default_rng(7).random(n)
    return np.floor(-np.log(1 - draw) / np.log(M)).astype(int)


def build(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the base up: ``(nodes, links)``; links hold positions within ``nodes``."""
    norm = np.einsum("nd,nd->n", vectors, vectors)
    x = np.column_stack([vectors, np.sqrt(np.maximum(norm.max() - norm, 0))]).astype(np.float32)
    level = _levels(len(x))
    out = []
    for lv in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= lv)
        own = x[nodes]
        links = np.full((len(nodes), 2 * M if lv == 0 else M), -1, np.int64)
        at = 1
        while at < len(nodes):
            batch = np.arange(at, min(len(nodes), at + max(1, at // 4), at + 1024))
            found = []
            for i in range(0, len(batch), _STEP):
                part = batch[i:i + _STEP]
                # a few fixed entries among the nodes already in
                entry = np.tile(np.linspace(0, at - 1, min(at, 8)).astype(np.int64), (len(part), 1))
                entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
                found.append(_search(own[part], entry, own[:at], links[:at], EF_BUILD)[0])
            _insert(batch, np.concatenate(found), own, links)
            at = int(batch[-1]) + 1
        out.append((nodes, links))
    return out


def search(q: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], ef: int = EF_SEARCH):
    """Nodes of the base level for each query, nearest first (-1 where fewer)."""
    x, q = vectors.astype(np.float32), q.astype(np.float32)
    entry = np.zeros((len(q), 1), np.int64)
    for lv in range(len(levels) - 1, -1, -1):
        nodes, links = levels[lv]
        found = _search(q, entry, x[nodes], links, ef if lv == 0 else 8)[0]
        if lv == 0:
            return found
        below = levels[lv - 1][0]
        up = np.where(found >= 0, nodes[found], -1)
        entry = np.where(up >= 0, np.searchsorted(below, up), -1)


_INDEX = ("shard int, dim int, id_lists array<array<long>>, vectors array<double>, n_levels int, "
          "nodes array<int>, node_counts array<int>, links array<int>")


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    dim = table.column("dim")[0].as_py()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    levels = build(flat.reshape(-1, dim))
    nodes = np.concatenate([n for n, _ in levels]).astype(np.int32)
    links = np.concatenate([k.reshape(-1) for _, k in levels]).astype(np.int32)
    row = {"shard": [table.column("shard")[0].as_py()], "dim": [dim],
           "id_lists": [table.column("ids").to_pylist()], "vectors": [flat], "n_levels": [len(levels)],
           "nodes": [nodes], "node_counts": [np.array([len(n) for n, _ in levels], np.int32)], "links": [links]}
    types = {"shard": pa.int32(), "dim": pa.int32(), "id_lists": pa.list_(pa.list_(pa.int64())),
             "vectors": pa.list_(pa.float64()), "n_levels": pa.int32(), "nodes": pa.list_(pa.int32()),
             "node_counts": pa.list_(pa.int32()), "links": pa.list_(pa.int32())}
    return pa.table({c: pa.array(v, types[c]) for c, v in row.items()})


def _search_shard(k: int, ef: int):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and index.num_rows:
            index = index.combine_chunks()
            get = {c: index.column(c)[0] for c in index.schema.names}
            dim = get["dim"].as_py()
            vectors = get["vectors"].values.to_numpy().reshape(-1, dim)
            lists = get["id_lists"].values
            list_at, list_ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            base = list_at[0]
            nodes, links = get["nodes"].values.to_numpy().astype(np.int64), get["links"].values.to_numpy().astype(np.int64)
            levels, a, b = [], 0, 0
            for lv, n in enumerate(get["node_counts"].as_py()):
                width = 2 * M if lv == 0 else M
                levels.append((nodes[a:a + n], links[b:b + n * width].reshape(n, width)))
                a, b = a + n, b + n * width
            ids = queries.column("query_id").to_numpy()
            q = queries.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i in range(0, len(q), _STEP):
                found = search(q[i:i + _STEP], vectors, levels, ef)
                for j, hits in enumerate(found):
                    hits = hits[hits >= 0]
                    exact = vectors[hits] @ q[i + j]
                    order = np.lexsort((list_ids[list_at[hits]], -exact))[:k + 1]  # by score, then smallest id
                    cand = [(s, v) for s, h in zip(exact[order].tolist(), hits[order].tolist())
                            for v in list_ids[list_at[h]:list_at[h + 1]].tolist() if v != ids[i + j]]
                    for s, v in sorted(cand, key=lambda c: (-c[0], c[1]))[:k]:
                        out["query_id"].append(int(ids[i + j]))
                        out["vec_id"].append(v)
                        out["score"].append(s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})
    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, as doubles."""
    got = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)) & F.exists("v", lambda c: c != 0)
    got = got.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    most = got.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got.filter(F.size("v") == (most["n"] if most else 0))


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Shard indexes, one row each, over the rows of ``usable``."""
    # The window keeps k + 1 ids per vector before it shuffles; equal vectors share a node.
    lowest = Window.partitionBy("v").orderBy("vec_id")
    nodes = (vectors.distinct().withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= k + 1)
             .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    nodes = stage(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"),
                         F.size("v").alias("dim"), "v", "ids")
    return stage(dealt.groupBy("shard").applyInArrow(_build_shard, _INDEX), "ann-index")


def nearest(queries: DataFrame, shards: DataFrame, k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``queries(vec_id, v)`` against all shards."""
    # Query blocks are hash classes of a fixed mean size; every block meets every shard.
    n_shards = [r[0] for r in shards.select("shard").collect()]  # one small number a shard
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v",
                           F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in n_shards]).cast("array<int>")))
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(
        _search_shard(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search_table(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``."""
    vectors = stage(usable(rows, id_col, vector_col), "ann-vectors")
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return nearest(queries, index(vectors, k), k)
