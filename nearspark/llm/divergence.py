"""Divergence of the sources of each language, over run-length columns.

A term is a maximal run of letters of any script (bytes outside ``00-40 5B-60
7B-7F``), with A-Z folded. A language keeps the ``V`` terms that are in at least
``least_docs`` of its documents. A group is a (lang, source) that occurs, or a
language as a whole. It gives every kept term ``p = 1 + floor(10**9 * (count + 1) /
(N + V))``; ``f = floor((p - q) ** 2 / q)`` compares two of them. All integers exact.

Pairs of sources are compared over run-length columns. The vocabulary is reordered
so that equal counts stand together: terms with the same counts in all sources are
one row with a run length, and these rows are ordered by total count and first
source, over all tasks, cut into blocks and ordered by their counts. In a block each source's column is encoded as
runs of equal ``p``. For a pair the two columns' run boundaries are intersected and
``f`` of every stretch is multiplied by its length. A block's sums are added up per
pair. So the work follows the runs, not the vocabulary.

On Spark: tasks count terms per (lang, source) before anything is shuffled, so a
source or term that holds most rows sends one row per task. One shuffle by (lang,
term) gives counts and document numbers. What a block holds is bounded by
``BLOCK_ROWS`` and the number of sources of its language, of which the result holds
every pair. Top lists are windows that Spark cuts to ``top`` rows before it shuffles.

Odd rows: null text, lang or source is ''. Empty texts, texts without a term and very
long texts need no rule of their own (a text longer than a slice is a slice). Repeated
rows count as documents each. A language without kept terms has pairs of value 0.
Ties rank by the item's UTF-8 bytes. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearspark.llm import textops as T
from nearspark.llm.staging import stage

SCALE = 10 ** 9
BLOCK_ROWS = 4096
SLICE_BYTES = 4 << 20
HELD_ROWS = 400_000

_U = np.uint64


def _letters() -> np.ndarray:
    byte = np.arange(256, dtype=np.uint8)
    byte[65:91] += 32
    for a, b in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        byte[a:b + 1] = 32
    return byte


_LETTERS = _letters()
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("d", pa.int64())])


def _spans_as_strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    ends = np.cumsum(e - s)
    off = np.concatenate([[0], ends]).astype(np.int32)
    at = np.arange(off[-1], dtype=np.int64) + np.repeat(s - off[:-1], e - s)
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[at])))


def _slice_counts(data: np.ndarray, off: np.ndarray, group: np.ndarray):
    """``(group, term, occurrences, documents)`` of the terms of one slice."""
    data = _LETTERS[data]
    s, e, first = T.word_spans(data, off)
    h = T.word_hashes(data, s, e)
    doc = np.repeat(np.arange(len(group), dtype=np.int64), np.diff(first))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    at = order[at]  # one occurrence of every (document, term)
    g, h = group[doc[at]], h[at]
    order = np.lexsort((h, g))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return g, pa.array([], pa.string()), n, n
    docs = np.diff(np.append(starts, len(h)))
    total = np.add.reduceat(n[order], starts)
    one = order[starts]
    return g[one], _spans_as_strings(data, s[at[one]], e[at[one]]), total, docs


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables)
    t = t.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "d_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS)


def _count(batches):
    held, rows = [], 0
    for batch in batches:
        pairs = pa.table([batch.column(1), batch.column(2)], names=["lang", "source"])
        kinds = pairs.append_column("i", pa.array(range(len(batch)))).group_by(
            ["lang", "source"], use_threads=False).aggregate([("i", "list")])
        group = np.zeros(len(batch), np.int64)
        for g, rows_of in enumerate(kinds["i_list"].to_pylist()):
            group[rows_of] = g
        for a, n, data, off in T.text_slices(batch, "text", SLICE_BYTES):
            g, term, total, docs = _slice_counts(data, off, group[a:a + n])
            at = pa.array(g)
            held.append(pa.table([kinds["lang"].take(at), kinds["source"].take(at), term, pa.array(total, pa.int64()),
                                  pa.array(docs, pa.int64())], schema=_COUNTS))
            rows += len(term)
            if rows > HELD_ROWS:
                held = [_merged(held)]
                if len(held[0]) > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held = []
                rows = sum(map(len, held))
    if held:
        yield from _merged(held).to_batches(max_chunksize=50_000)
    T.give_back_memory()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, d)``: occurrences and documents; one row per task at least, not summed yet."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
             for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    return docs.select(*blank).mapInArrow(_count, "lang string, source string, term string, n long, d long")


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """``(lang, term, total, counts)`` of kept terms; counts: (source, n) by source."""
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"),
                                                                                    F.sum("d").alias("d"))
    return (each.groupBy("lang", "term")
            .agg(F.sum("d").alias("_d"), F.sum("n").alias("total"),
                 F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
            .filter(F.col("_d") >= least_docs).drop("_d"))


def group_totals(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, n, n_lang, v)`` of every group that occurs."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                           for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    own = (kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source")
           .agg(F.sum("c.n").alias("n")))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    zero = {c: 0 for c in ("n", "n_lang", "v")}
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(zero)


def _p(count: str, total: str) -> Column:
    """Exact share of ``count`` in parts of ``SCALE``; decimals where a long would overflow."""
    return F.expr(f"""1 + CASE WHEN {count} < 9000000000 THEN {SCALE}L * ({count} + 1) div ({total} + v)
        ELSE cast({SCALE} AS decimal(10, 0)) * cast({count} + 1 AS decimal(20, 0))
             div cast({total} + v AS decimal(20, 0)) END""")


def _runs(count: np.ndarray, ends: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """End positions and ``p`` of the runs of one source's column."""
    last = np.append(count[1:] != count[:-1], True)
    values, back = np.unique(count[last], return_inverse=True)
    p = np.array([1 + SCALE * (int(c) + 1) // (n + v) for c in values], np.int64)
    return ends[last], p[back]


def _pairs_of_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
    names = sorted(right["source"].to_pylist(), key=str.encode) if len(left) else []
    place = {s: i for i, s in enumerate(names)}
    totals = dict(zip(right["source"].to_pylist(), right["n"].to_pylist()))
    v = right["v"][0].as_py() if len(right) else 0
    rows = sorted(([(place[c["source"]], c["n"]) for c in counts], run)
                  for counts, run in zip(left["counts"].to_pylist(), left["run"].to_pylist()))
    ends = np.cumsum([run for _, run in rows], dtype=np.int64)
    columns = [[] for _ in names]
    for i, (counts, _) in enumerate(rows):
        for g, n in counts:
            columns[g].append((i, n))
    runs = []
    for name, held in zip(names, columns):
        count = np.zeros(len(rows), np.int64)
        if held:
            at, n = np.array(held, np.int64).T
            count[at] = n
        runs.append(_runs(count, ends, totals[name], v))
    out = ([], [], [])
    for a, (ends_a, p_a) in enumerate(runs):
        for b in range(a + 1, len(runs)):
            ends_b, p_b = runs[b]
            cut = np.union1d(ends_a, ends_b)
            length = np.diff(cut, prepend=0)
            p, q = p_a[np.searchsorted(ends_a, cut)], p_b[np.searchsorted(ends_b, cut)]
            square = (p - q) ** 2
            for x, y, f in ((a, b, square // q), (b, a, square // p)):
                out[0].append(names[x])
                out[1].append(names[y])
                out[2].append(int((f * length).sum()))
    lang = pa.array([key[0].as_py()] * len(out[0]), pa.string())
    return pa.table([lang, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                    names=["lang", "source", "item", "value"])


def pair_divergence(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each source and each other source of its language."""
    rows = stage(kept.groupBy("lang", "counts").agg(F.count("*").alias("run"), F.first("total").alias("total")),
                 "count-rows")
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    first = F.get("counts", F.lit(0))  # short sort keys: Spark samples them to the driver
    blocks = (rows.repartitionByRange(n_blocks, "lang", "total", first["source"], first["n"], F.xxhash64("counts"))
              .select("lang", (F.spark_partition_id() % n_blocks).alias("block"), "counts", "run"))
    sides = totals.select("lang", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "source", "n", "v")
    sums = (blocks.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block"))
            .applyInArrow(_pairs_of_block, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    every = (totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang")
             .filter("source <> item"))
    return every.join(sums, ["lang", "source", "item"], "left").fillna({"value": 0})


def term_divergence(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of the kept terms that a source has more of than its language."""
    each = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select(
        "lang", "term", "total", "c.source", F.col("c.n").alias("count"))
    both = (each.join(totals, ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), _p("count", "n").alias("p"),
                    _p("total", "n_lang").alias("q")).filter("p > q"))
    return both.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(w))
    rows = rows if most is None else rows.filter(F.col("rank") <= most)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources, and each source's ``top`` terms."""
    kept = stage(kept_terms(term_counts(docs), least_docs), "kept-terms")
    totals = stage(group_totals(docs, kept), "group-totals")
    return _ranked(pair_divergence(kept, totals), "pair").unionByName(
        _ranked(term_divergence(kept, totals), "term", top))
