"""Operators on hand-made rows and on sf0.001, against brute force in numpy."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspark.operators import cosine as CS
from nearspark.operators import evaluate as EV
from nearspark.operators import graph as GR
from nearspark.operators import lsa as LS
from nearspark.operators import minhash as MH
from nearspark.operators import pairs as P
from nearspark.operators import simhash as SH
from nearspark.operators import text as TX
from nearspark.operators import weights as WT


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def bag_dict(bag):
    return {(r["doc_id"], r["term"]): r["tf"] for r in bag.collect()}


def test_tokens_cleaning_camel_contractions(spark):
    d = docs(spark, [(1, "fooBar HTMLParser cannot café 42x gonna Wanna")])
    b = bag_dict(TX.bag_of_words(d, stopwords=()))
    terms = {t for _, t in b}
    assert {"foo", "bar", "htmlparser", "can", "not", "caf", "x", "gon", "na", "wan"} <= terms


def test_empty_stopword_and_short_documents(spark):
    d = docs(spark, [(1, ""), (2, "the and of"), (3, "a b c"), (4, "real words here")])
    bag = TX.bag_of_words(d)
    ids = {r["doc_id"] for r in bag.select("doc_id").distinct().collect()}
    assert ids == {3, 4}                       # empty and all-stopword documents dropped
    vec_ids = {r["doc_id"] for r in WT.tfidf_l2(bag).select("doc_id").distinct().collect()}
    assert vec_ids == {4}                      # one-letter terms only -> zero vector, no row


def test_idf_zero_and_negative(spark):
    d = docs(spark, [(1, "common rare"), (2, "common zebra"), (3, "common zebra quartz")])
    idf = {r["term"]: r["idf"] for r in WT.idf_raw(TX.bag_of_words(d)).collect()}
    assert idf["common"] == pytest.approx(np.log(3 / 4))   # df = N -> negative
    assert idf["zebra"] == pytest.approx(0.0)              # df = N - 1 -> zero


def test_one_document_corpus_sets_tail_bits(spark):
    d = docs(spark, [(1, "alpha beta gamma alpha")])
    fp = SH.fingerprints(SH.weighted_features(TX.bag_of_words(d), hash_method="md5"), num_bits=64)
    row = fp.first()
    assert row["tail"] is True                            # every weight negative
    assert row["fingerprint"].endswith("ffffffff")


def _brute_simhash(fps, num_bits, t):
    rows = fps.collect()
    out = set()
    for a, b in combinations(rows, 2):
        d = bin(a["votes"] ^ b["votes"]).count("1")
        if num_bits > 32 and a["tail"] != b["tail"]:
            d += num_bits - 32
        if d <= t:
            out.add((min(a["doc_id"], b["doc_id"]), max(a["doc_id"], b["doc_id"]), d))
    return out


@pytest.mark.parametrize("num_bits,t", [(64, 0), (64, 3), (32, 5), (32, 6), (16, 4)])
def test_simhash_pigeonhole_equals_brute_force(spark, sf, num_bits, t):
    bag = TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet"))
    fps = SH.fingerprints(SH.weighted_features(bag, hash_method="md5"), num_bits=num_bits).cache()
    got = {(r["id1"], r["id2"], r["value"]) for r in
           SH.simhash_pairs(fps, num_bits=num_bits, hamming_threshold=t, tile_size=16).collect()}
    assert got == _brute_simhash(fps, num_bits, t)


def test_simhash_murmur_runs(spark, sf):
    bag = TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet"))
    fps = SH.fingerprints(SH.weighted_features(bag, hash_method="murmur3"))
    assert fps.count() == bag.select("doc_id").distinct().count()


def _py_signature(features, a, b):
    import hashlib
    xs = [int(hashlib.md5(f.encode()).hexdigest(), 16) for f in features]
    return [min((int(ai) * x + int(bi)) % ((1 << 32) - 1) for x in xs) for ai, bi in zip(a, b)]


def test_minhash_signature_matches_big_int_arithmetic(spark):
    from nearspark.functions.hashing import minhash_coefficients
    d = docs(spark, [(1, "apple apple banana cherry"), (2, "delta echo")])
    sigs = {r["doc_id"]: r["signature"] for r in MH.signatures(TX.bag_of_words(d), num_hashes=16).collect()}
    a, b = minhash_coefficients(16, 42)
    assert sigs[1] == _py_signature(["apple1", "apple2", "banana1", "cherry1"], a, b)
    assert sigs[2] == _py_signature(["delta1", "echo1"], a, b)


def test_minhash_leftover_hashes_and_identical_docs(spark):
    d = docs(spark, [(1, "same words in both docs"), (2, "same words in both docs"),
                     (3, "completely different text entirely")])
    pairs = MH.minhash_pairs(TX.bag_of_words(d), num_hashes=20, num_bands=3).collect()
    assert [(r["id1"], r["id2"], r["value"]) for r in pairs] == [(1, 2, 1.0)]


def test_group_self_pairs_tiling_is_exact(spark):
    rows = [(g, i) for g in range(3) for i in range(g * 100, g * 100 + 37 * (g + 1))]
    df = spark.createDataFrame(rows, "g long, id long")
    got = {(r["id1"], r["id2"]) for r in P.group_self_pairs(df, ["g"], "id", tile_size=5).collect()}
    want = set()
    for g in range(3):
        ids = [i for gg, i in rows if gg == g]
        want |= {(a, b) for a, b in combinations(sorted(ids), 2)}
    assert got == want


def _numpy_vectors(vecs):
    rows = vecs.collect()
    ids = sorted({r["doc_id"] for r in rows})
    terms = sorted({r["term"] for r in rows})
    ix, tx = {d: i for i, d in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    m = np.zeros((len(ids), len(terms)))
    for r in rows:
        m[ix[r["doc_id"]], tx[r["term"]]] = r["w"]
    return ids, m


@pytest.mark.parametrize("t,strict", [(0.8, False), (0.8, True), (0.5, False), (0.3, False)])
def test_prefix_cosine_equals_brute_force(spark, sf, t, strict):
    vecs = WT.tfidf_l2(TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet"))).cache()
    got = {(r["id1"], r["id2"]): r["value"] for r in
           CS.sparse_cosine_pairs(vecs, "doc_id", t, strict=strict, block_docs=64).collect()}
    ids, m = _numpy_vectors(vecs)
    sims = m @ m.T
    want = {}
    for i, j in combinations(range(len(ids)), 2):
        if (sims[i, j] > t) if strict else (sims[i, j] >= t - 1e-12):
            want[(ids[i], ids[j])] = sims[i, j]
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_dense_cosine_equals_numpy(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    got = {(r["id1"], r["id2"]) for r in
           CS.dense_cosine_pairs(e, "vec_id", "embedding", 0.3, tile_size=64).collect()}
    rows = e.collect()
    ids = np.array([r["vec_id"] for r in rows])
    m = np.array([r["embedding"] for r in rows])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = u @ u.T
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in combinations(range(len(ids)), 2)
            if s[i, j] >= 0.3}
    assert got == want


def test_components_and_closure_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "doc_id long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.85), (1, 3, 0.5), (5, 6, 0.95),
                                   (6, 7, 0.81)], "id1 long, id2 long, value double")
    _n, edges = GR.similarity_graph(pairs, nodes, "doc_id", 0.8)
    comps = {r["id"]: r["component"] for r in GR.connected_components(_n, edges).collect()}
    assert comps == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}
    labels = {(r["id1"], r["id2"]) for r in GR.pseudo_labels(GR.connected_components(_n, edges)).collect()}
    assert (1, 3) in labels and len(labels) == 6     # A-C labelled through B


def test_components_match_union_find(spark, sf):
    vecs = WT.tfidf_l2(TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet")))
    pairs = CS.sparse_cosine_pairs(vecs, "doc_id", 0.5).cache()
    nodes = vecs.select("doc_id").distinct()
    _n, edges = GR.similarity_graph(pairs, nodes, "doc_id", 0.5)
    got = {r["id"]: r["component"] for r in GR.connected_components(_n, edges).collect()}
    parent = {r["doc_id"]: r["doc_id"] for r in nodes.collect()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for r in edges.collect():
        a, b = find(r["src"]), find(r["dst"])
        parent[max(a, b)] = min(a, b)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    assert got == want


def test_evaluation_cut_and_empty_inputs(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, component long")
    res = spark.createDataFrame([(1, 2, 0.0), (1, 3, 1.0)], "id1 long, id2 long, value double")
    row = EV.evaluate(res, comps).first()
    assert (row["n_results"], row["n_labels"], row["hits"]) == (2, 1, 0)   # distance 0 not counted
    row = EV.evaluate(res, comps, min_value=None).first()
    assert row["hits"] == 1 and row["precision"] == 0.5 and row["recall"] == 1.0
    empty = spark.createDataFrame([], "id1 long, id2 long, value double")
    row = EV.evaluate(empty, spark.createDataFrame([], "id long, component long")).first()
    assert row["precision"] is None and row["recall"] is None


def test_lsa_full_rank_svd_preserves_cosines(spark, sf):
    bag = TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet").limit(40))
    vecs = WT.tfidf_l2(bag).cache()
    ids, m = _numpy_vectors(vecs)
    emb, sing = LS.lsa_embed(vecs, n_components=len(ids), oversample=5, n_iter=2)
    e = {r["doc_id"]: np.array(r["vec"]) for r in emb.collect()}
    got = np.array([e[i] for i in ids])
    assert np.allclose(got @ got.T, m @ m.T, atol=1e-6)


def test_lsa_truncated_matches_numpy_singular_values(spark, sf):
    bag = TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet"))
    vecs = WT.tfidf_l2(bag).cache()
    _ids, m = _numpy_vectors(vecs)
    k = 10
    emb, sing = LS.lsa_embed(vecs, n_components=k, oversample=10, n_iter=5)
    want = np.linalg.svd(m, compute_uv=False)[:k]
    assert np.allclose(sing, want, rtol=2e-2)
    assert emb.count() == m.shape[0]


def test_warc_roundtrip_counts_broken_records(spark, sf, tmp_path):
    from nearspark.sources import index as IX
    from nearspark.sources import warc as WA
    pages = spark.read.parquet(f"{sf}/pages.parquet").repartition(2)
    index = WA.write_warc(pages, str(tmp_path / "w"), broken_every=5).cache()
    plan = IX.byte_ranges(index)
    fetched = WA.fetch_records(plan)
    s = WA.fetch_summary(fetched, plan).first()
    n = pages.count()
    assert s["planned"] == 2 * n and s["pages"] + s["skipped"] == n and s["skipped"] > 0


def test_lsa_topics_and_explained_variance_match_numpy(spark, sf):
    bag = TX.bag_of_words(spark.read.parquet(f"{sf}/documents.parquet"))
    vecs = WT.tfidf_l2(bag).cache()
    ids, m = _numpy_vectors(vecs)
    terms = sorted({r["term"] for r in vecs.select("term").distinct().collect()})
    k = 6
    _emb, topics, var = LS.lsa_model(vecs, n_components=k, oversample=10, n_iter=6)
    _u, s, vt = np.linalg.svd(m, full_matrices=False)
    got_vt = np.zeros((k, len(terms)))
    tix = {t: i for i, t in enumerate(terms)}
    for r in topics.collect():
        got_vt[r["component"], tix[r["term"]]] = r["weight"]
    # rows of V^T agree up to sign
    for c in range(k):
        assert min(np.abs(got_vt[c] - vt[c]).max(), np.abs(got_vt[c] + vt[c]).max()) < 2e-2
    want = np.var(m @ vt[:k].T, axis=0) / np.var(m, axis=0).sum()
    got = np.array([r["explained_variance_ratio"] for r in var.orderBy("component").collect()])
    assert np.allclose(got, want, rtol=2e-2, atol=1e-4)


def test_tiled_pairs_come_once(spark):
    from nearspark.operators import pairs as P
    rows = spark.range(37).selectExpr("'g' AS g", "id")
    got = P.group_self_pairs(rows, ["g"], "id", tile_size=5)
    assert got.count() == 37 * 36 // 2 == got.distinct().count()


def test_malformed_url_is_no_error(spark):
    from nearspark.sources import index as I
    rows = spark.createDataFrame([("https://a.example.org/x y|z",), ("not a url",), ("https://b.org/",), (None,)], "url string")
    assert [r.url for r in I.domain_filter(rows, "example.org").collect()] == ["https://a.example.org/x y|z"]


def test_deep_page_is_read():
    from nearspark.functions.html import extract_fields
    assert extract_fields("<p>" * 5000 + "deep<h1>top</h1>") == ("top ", "deep")


def test_lsa_svd_takes_string_ids_and_needs_a_known_method(spark):
    rows = [("u/a", "red green blue cyan"), ("u/b", "red green blue cyan"), ("u/c", "one two three four"),
            ("u/d", "red green blue mauve")]
    d = spark.createDataFrame(rows, "url string, text string")
    bag = TX.bag_of_words(d, "url", "text")
    by_svd = {(r["id1"], r["id2"]): r["value"]
              for r in LS.lsa_pairs(bag, "url", n_components=50, cosine_threshold=0.3, n_iter=1).collect()}
    full = {(r["id1"], r["id2"]): r["value"]
            for r in LS.lsa_pairs(bag, "url", cosine_threshold=0.3, method="full_rank").collect()}
    assert by_svd.keys() == full.keys() == {("u/a", "u/b"), ("u/a", "u/d"), ("u/b", "u/d")}
    assert all(abs(by_svd[k] - full[k]) < 1e-6 for k in full)
    with pytest.raises(ValueError):
        LS.lsa_pairs(bag, "url", method="sparse")
    with pytest.raises(ValueError):
        LS.lsa_pairs(bag, "url", cosine_threshold=0.0, method="full_rank")


def test_lsa_queries_gather_no_matrix_as_wide_as_the_table(spark, sf, monkeypatch):
    from nearspark.plans import queries as Q
    widths, gram = [], LS._gram
    monkeypatch.setattr(LS, "_gram", lambda df, col, width: widths.append(width) or gram(df, col, width))
    got = {(r["id1"], r["id2"]): r["value"] for r in Q.QUERIES["lsa_pairs_svd"][0](spark, sf).collect()}
    assert widths == []  # full rank over a whole table: the sparse join
    rows = WT.tfidf_l2(Q.page_bag(spark, sf), "url").select("url", "term", "w").collect()
    urls, terms = sorted({r["url"] for r in rows}), {t: i for i, t in enumerate({r["term"] for r in rows})}
    at, a = {u: i for i, u in enumerate(urls)}, np.zeros((len({r["url"] for r in rows}), len(terms)))
    for r in rows:
        a[at[r["url"]], terms[r["term"]]] = r["w"]
    cos = a @ a.T
    want = {(u, v): cos[at[u], at[v]] for u in urls for v in urls if u < v and cos[at[u], at[v]] >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    few = Q.QUERIES["lsa_pairs_pages_k64"][0](spark, sf)
    assert few.columns == ["id1", "id2", "value"] and max(widths) <= 64 + 10


def test_signatures_hash_a_distinct_feature_once_and_match_plain_python(spark):
    import hashlib
    from nearspark.functions.hashing import minhash_coefficients
    rows = [(d, f"w{t}", 1 + (d * t) % 3) for d in range(40) for t in range(d % 7, 30 + d)]
    sigs = MH.signatures(spark.createDataFrame(rows, "doc_id long, term string, tf long"), "doc_id", 40, 7)
    assert "md5" not in sigs._jdf.queryExecution().executedPlan().toString()  # not per occurrence on the JVM
    a, b = (v.tolist() for v in minhash_coefficients(40, 7))
    for doc, sig in sigs.collect():
        xs = [int(hashlib.md5(f"{t}{k}".encode()).hexdigest(), 16) % (2 ** 32 - 1)
              for d, t, n in rows if d == doc for k in range(1, n + 1)]
        assert sig == [min((i * x + j) % (2 ** 32 - 1) for x in xs) for i, j in zip(a, b)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits,t", [(32, 6), (8, 8), (8, 3), (64, 9)])
def test_simhash_pairs_with_wide_thresholds_compare_tiles(spark, bits, t):
    rng = np.random.default_rng(5)
    votes = (rng.integers(0, 1 << min(bits, 32), 300) & rng.integers(0, 1 << min(bits, 32), 300)).tolist()
    rows = [(i, v, bits > 32 and i % 11 == 0) for i, v in enumerate(votes)]
    pairs = SH.simhash_pairs(spark.createDataFrame(rows, "doc_id long, votes long, tail boolean"), "doc_id", bits, t)
    assert "FlatMapGroupsInPandas" in plan_of(pairs)
    want = {(i, j, d) for (i, v, a), (j, w, b) in combinations(rows, 2)
            if (d := (v ^ w).bit_count() + (bits - 32 if a != b else 0)) <= t}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


def test_fingerprints_move_rows_not_partial_sums(spark):
    feats = spark.createDataFrame([(1, "a", 0.5, 3), (1, "b", -0.25, 5), (2, "a", 1.0, 3)],
                                  "doc_id long, term string, weight double, h long")
    below = plan_of(SH.fingerprints(feats, "doc_id", 64)).split("Exchange", 1)[1]
    assert "HashAggregate" not in below


@pytest.mark.parametrize("stem", [False, True])
def test_stored_bag_stays_dealt_by_id(spark, sf, stem):
    from nearspark.plans.queries import doc_bag
    bag = doc_bag(spark, sf, stem)
    assert "Exchange" not in plan_of(MH.signatures(bag, "doc_id"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
