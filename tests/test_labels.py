"""Label graph: equal bags without cliques, score bounds, components around a hub."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearspark.operators import cosine as CS
from nearspark.operators import graph as GR
from nearspark.operators import text as TX
from nearspark.operators import weights as WT


@pytest.fixture(scope="module")
def copies(spark, sf):
    """Documents of sf0.001, three texts copied under further ids, and one that is its text twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    few = docs.orderBy("doc_id").limit(3)
    steps = F.sequence(F.lit(1000), F.lit(40000), F.lit(1000))
    more = few.select("doc_id", "text", F.explode(steps).alias("k")).select((F.col("doc_id") + F.col("k")).alias("doc_id"), "text")
    twice = docs.orderBy(F.desc("doc_id")).limit(1).select(
        F.lit(99).cast("long").alias("doc_id"), F.concat("text", F.lit(" "), "text").alias("text"))
    return TX.bag_of_words(docs.filter("doc_id <> 99").unionByName(more).unionByName(twice)).cache()


def brute(bag, t, strict):
    rows = WT.tfidf_l2(bag).collect()
    ids, terms = sorted({r.doc_id for r in rows}), sorted({r.term for r in rows})
    ix, tx = {d: i for i, d in enumerate(ids)}, {w: i for i, w in enumerate(terms)}
    m = np.zeros((len(ids), len(terms)))
    for r in rows:
        m[ix[r.doc_id], tx[r.term]] = r.w
    s = m @ m.T
    return {(ids[i], ids[j]) for i, j in combinations(range(len(ids)), 2)
            if (s[i, j] > t if strict else s[i, j] >= t - 1e-12)}


@pytest.mark.parametrize("t,strict", [(0.8, False), (0.8, True), (0.4, False)])
def test_collapsed_join_equals_brute_force(copies, t, strict):
    classes = CS.equal_classes(copies).cache()
    assert classes.select("rep").distinct().count() < classes.count()
    vecs = WT.tfidf_l2(copies).cache()
    got = [(r.id1, r.id2) for r in CS.sparse_cosine_pairs(vecs, "doc_id", t, strict, classes=classes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(copies, t, strict)


def test_links_have_the_components_of_all_pairs(copies):
    vecs, classes = WT.tfidf_l2(copies).cache(), CS.equal_classes(copies).cache()
    links = CS.cosine_links(vecs, classes, "doc_id", 0.8, strict=True).cache()
    parent = {r.doc_id: r.doc_id for r in classes.collect()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(copies, 0.8, True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes, edges = GR.similarity_graph(links, classes, "doc_id", 0.8)
    got = {r.id: r.component for r in GR.connected_components(nodes, edges).collect()}
    assert got == {i: find(i) for i in parent}


def test_equal_documents_write_a_star_not_a_clique(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three words").alias("text"))
    bag = TX.bag_of_words(docs).cache()
    classes = CS.equal_classes(bag).cache()
    links = CS.cosine_links(WT.tfidf_l2(bag), classes, "doc_id", 0.8, strict=True).cache()
    assert links.count() == 4999
    nodes, edges = GR.similarity_graph(links, classes, "doc_id", 0.8)
    assert {r.component for r in GR.connected_components(nodes, edges).collect()} == {0}


def test_bounds_prune_candidates_but_no_pair(copies):
    vecs = WT.tfidf_l2(copies).cache()
    cands = {(r.id1, r.id2) for r in CS.candidates(vecs, "doc_id", 0.8).collect()}
    want = brute(copies, 0.8, False)
    assert want <= cands and len(cands) < 3 * len(want) + 100


def test_long_vectors_are_told_apart_by_wider_sketches(spark):
    rng = np.random.default_rng(7)
    rows = [(d, f"t{t}") for d in range(2200) for t in rng.choice(20_000, 12, replace=False)]
    rows += [(d, f"t{t}") for d in range(3000, 3200) for t in rng.choice(20_000, 900, replace=False)]
    rows += [(d + 1000, t) for d, t in rows if d >= 3190]  # ten long copies
    bag = spark.createDataFrame(rows, "doc_id long, term string").withColumn("w", F.lit(1.0))
    unit = F.col("w") / F.sqrt(F.sum("w").over(Window.partitionBy("doc_id")))
    vecs = bag.select("doc_id", "term", unit.alias("w")).cache()
    got = {(r.id1, r.id2) for r in CS.candidates(vecs, "doc_id", 0.8).collect()}
    assert {(d, d + 1000) for d in range(3190, 3200)} <= got and len(got) < 100


def test_vectors_are_stored_once_and_only_pairs_that_pass_leave_a_task(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{d:03}", f"t{t}", 0.25) for d in range(300) for t in rng.choice(24, 16, replace=False)]
    vecs = spark.createDataFrame(rows, "doc_id string, term string, w double").cache()
    pairs = CS.sparse_cosine_pairs(vecs, "doc_id", 0.85, block_docs=40)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan
    own = {}
    for d, t, _ in rows:
        own.setdefault(d, set()).add(t)
    want = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / 16 >= 0.85}
    got = pairs.collect()
    assert len(got) == len(want) > 20 and {(r.id1, r.id2) for r in got} == want
    assert all(abs(r.value - len(own[r.id1] & own[r.id2]) / 16) < 1e-12 for r in got)
    folder = CS._write_tiles(vecs, vecs.select("doc_id", F.lit(False).alias("_later")).distinct(), "doc_id", 5)
    assert spark.read.parquet(folder).count() == 300


def test_a_hub_takes_no_part_in_the_join(spark):
    leaves, chain = 60_000, 300
    star = spark.range(1, leaves + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    path = spark.range(100_000, 100_000 + chain).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    edges = star.unionByName(path).cache()
    both = edges.union(edges.select("dst", "src")).cache()
    n = both.count()
    got = {(r.src, r.dst): r._m for r in GR.with_least(both, n).collect()}
    assert len(got) == n and got[0, 5] == 1 and got[7, 0] == 0 and got[100_001, 100_002] == 100_000
    plan = GR.with_least(both, n)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan  # hubs leave the shuffled side
    assert both.groupBy("src").count().filter(F.col("count") <= n / GR.HUBS).count() > 0
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    comps = GR.connected_components(nodes, edges).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in comps} == {(0, leaves + 1), (100_000, chain + 1)}


def test_simhash_keys_grow_with_the_table():
    from nearspark.operators.simhash import blocks_for
    assert blocks_for(100, 32, 3) < blocks_for(10 ** 5, 32, 3) <= blocks_for(10 ** 9, 32, 3)
    for n in (100, 10 ** 4, 10 ** 5, 10 ** 6):
        k = blocks_for(n, 32, 3)
        assert k * 32 // (3 + k) >= n.bit_length() or k == blocks_for(10 ** 12, 32, 3)


@pytest.mark.parametrize("extra", [None, 1, 5])
def test_simhash_pairs_do_not_depend_on_the_blocks(spark, extra):
    from nearspark.operators import simhash as SH
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 32, 60)
    votes = [int(b) ^ (1 << int(x) if i % 3 else 0) ^ (1 << int(y) if i % 2 else 0)
             for b in base for i, (x, y) in enumerate(rng.integers(0, 32, (6, 2)))]
    fps = spark.createDataFrame([(i, v, i % 7 == 0) for i, v in enumerate(votes)], "doc_id long, votes long, tail boolean")
    got = {(r.id1, r.id2): r.value for r in SH.simhash_pairs(fps, "doc_id", 64, 3, extra_blocks=extra).collect()}
    want = {(i, j): d for i, j in combinations(range(len(votes)), 2)
            if (d := (votes[i] ^ votes[j]).bit_count() + 32 * ((i % 7 == 0) != (j % 7 == 0))) <= 3}
    assert got == want


def test_evaluate_pairs_without_closure(spark):
    from nearspark.operators import evaluate as EV
    labels = spark.createDataFrame([(1, 2), (3, 2), (5, 6)], "id1 long, id2 long")
    results = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 3, 0.5)], "id1 long, id2 long, value double")
    r = EV.evaluate_pairs(results, labels).first()
    assert (r.n_results, r.n_labels, r.hits, r.recall) == (3, 3, 1, pytest.approx(1 / 3))
    assert EV.evaluate_pairs(results, labels, None).first().hits == 2
    assert EV.evaluate_pairs(results.limit(0), labels.limit(0)).first().precision is None


def test_pairs_are_not_broadcast_by_a_guess(spark):
    rows = [(d, f"t{t}", 0.5) for d in range(60) for t in range(d % 3, d % 3 + 4)]
    vecs = spark.createDataFrame(rows, "doc_id long, term string, w double").cache()
    pairs = CS.sparse_cosine_pairs(vecs, "doc_id", 0.8)
    size = int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 1 << 40  # the tile pairs are few; how many rows they make is not known


def test_copies_of_a_class_are_spread_over_rows_and_tiles(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "one two three four").otherwise(
        F.concat(F.lit("one two three four five"), F.when(F.col("id") % 2 == 0, " six").otherwise(" seven"))).alias("text"))
    bag = TX.bag_of_words(docs).cache()
    classes, vecs = CS.equal_classes(bag).cache(), WT.tfidf_l2(bag).cache()
    got = [(r.id1, r.id2) for r in CS.sparse_cosine_pairs(vecs, "doc_id", 0.3, classes=classes, block_docs=2).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(bag, 0.3, False)
    dealt = CS._deal(vecs, classes, "doc_id", 0.3, 2)
    sizes = [len(r.members) for r in spark.read.parquet(dealt.folder).collect()]
    assert sum(sizes) == 700 and max(sizes) < 600 and len(dealt.widths) > 1


def test_links_leave_out_what_other_links_imply(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * g + d, f"g{g}t{t}", 30 ** -0.5) for g in range(3) for d in range(40)
            for t in rng.choice(32, 30, replace=False)]
    vecs = spark.createDataFrame(rows, "doc_id long, term string, w double").cache()
    classes = vecs.select("doc_id", F.col("doc_id").alias("rep")).distinct().cache()
    full = CS.sparse_cosine_pairs(vecs, "doc_id", 0.8, classes=classes).count()
    links = CS.cosine_links(vecs, classes, "doc_id", 0.8).collect()
    assert full == 3 * 40 * 39 // 2 and len(links) == 3 * 39 and all(r.value >= 0.8 for r in links)


def test_dense_vectors_are_stored_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400, [0.0] * 8), (401, None)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = CS.dense_cosine_pairs(vectors, "id", "v", 0.5, tile_size=40)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Explode" not in plan  # no vector is sent to each tile pair
    m = np.array([v for i, v in rows if i < 300])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    s = unit @ unit.T
    got = {(r.id1, r.id2): r.value for r in pairs.collect()}
    assert set(got) == {(i, j) for i, j in combinations(range(300), 2) if s[i, j] >= 0.5}
    assert all(abs(v - s[i, j]) < 1e-12 for (i, j), v in got.items())
