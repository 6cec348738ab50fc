"""The dealt operators against brute force, exact round trips and held-out accuracy."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearspark.llm import (ann, decontam, idcodec, jaccard, langid, licenses, packing, quality, staging, toxicity, tokens,
                           warc_chunks)
from nearspark.llm.queries import PIECES, QUERIES, WORD_TOKENIZER

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "a b c d e f"), (6, "a b c d e f"),
       (None, "a b c d e f"), (7, "x " * 30000), (8, "12 345 !!")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0) for i, t in ODD], "doc_id long, text string, lang string, n_shingles int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, bool(words)))}


def test_jaccard_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    base = [t.text for t in rows if t.text][:40]
    extra = [(10_000 + i, " ".join(w for j, w in enumerate(t.split()) if j % 50 != i % 50)) for i, t in enumerate(base)]
    sets = {r[0]: shingles(r[1]) for r in [*rows, *extra]}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(both).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_schemes_cover_every_difference():
    for band in range(40):
        lo, hi = jaccard.band_edges(80)[band:band + 2]
        m, u = jaccard.scheme_for(band, 80)
        for s in {lo, hi - 1}:
            spare = max(0, (m + u - jaccard.set_difference_bound(s, band, 80) - 1) // 2)
            assert m + u - 2 * spare > jaccard.set_difference_bound(s, band, 80)


def test_jaccard_odd_rows(odd, none):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect())
    assert (4, 1, 4) in got and (5, 1, 4) in got and (1, 0, 1) in got and got.count((6, 2, 6)) == 2
    assert jaccard.jaccard_components(none).count() == 0


def test_containment_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one TWO"), (4, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, items).collect()}
    assert got == {(4, 3), (5, 3), (6, 4), (None, 4)}
    assert decontam.contaminated(none, items).count() == 0
    assert licenses.scan(odd, licenses.templates_table(spark)).count() == 0


def test_best_license_match_tells_versions_apart(spark):
    two, three = licenses.TEMPLATES["GPL-2.0"], licenses.TEMPLATES["GPL-3.0"]
    texts = {1: f"intro {three} end", 2: two, 3: f"{two} then {three}", 4: licenses.TEMPLATES["Apache-2.0 header"],
             5: f"{three} {licenses.TEMPLATES['MIT']}", None: three, 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs, licenses.templates_table(spark), best=True).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {1: {"GPL-3.0"}, 2: {"GPL-2.0"}, 3: {"GPL-2.0", "GPL-3.0"}, 4: {"Apache-2.0", "Apache-2.0 header"},
                   5: {"GPL-3.0", "MIT"}, None: {"GPL-3.0"}}


def test_words_give_the_tokenizer_s_ids():
    tok = tokens.tokenizer_at(WORD_TOKENIZER)
    for text in ("it's 3.5 and a,b. x.,", "<|startoftext|> hi", "", "\x1c a\u0301 \u03a3\u03b1\u03c2'll DON'T!!! don't,"):
        got, counts = tok.encode(pa.array([text, None]))
        assert got.tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids and counts[1] == 0


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (4096, 3), (4097, 49408), (9000, 40)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        row = idcodec.pack_chunk(ids)
        assert np.array_equal(idcodec.unpack_chunk(row), ids)
    row["payload"] = row["payload"][:8] + b"\0\1\2\3" + row["payload"][12:]
    with pytest.raises(ValueError):
        idcodec.unpack_chunk(row)


def test_ids_written_and_read(odd, none):
    tok = tokens.tokenizer_at(WORD_TOKENIZER).tokenizer
    got = idcodec.read_ids(idcodec.write_ids(odd, WORD_TOKENIZER, end_id=1)).orderBy("start").collect()
    assert len(got) == len(ODD) and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    texts = dict(ODD)
    for r in got:
        assert r.ids == tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert idcodec.read_ids(idcodec.write_ids(none, WORD_TOKENIZER)).count() == 0


def test_packing_is_whole_and_gapless(odd, none):
    got = packing.pack_documents(odd, WORD_TOKENIZER, capacity=64, keep_ids=True).toPandas()
    assert len(got) == packing.pieces(odd, WORD_TOKENIZER, capacity=64).count()
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 64
    assert got.sequence_id.nunique() == -(-got.length.sum() // 64)
    assert packing.pack_documents(none, WORD_TOKENIZER).count() == 0


def test_fullest_matches_exhaustive_search():
    from itertools import product
    counts = [0, 0, 1, 2, 0, 1, 0, 2]
    for room in range(8):
        best = max(s for c in product(*[range(n + 1) for n in counts]) if (s := sum(i * n for i, n in enumerate(c))) <= room)
        assert sum(k * n for k, n in packing.fullest(counts, room).items()) == best


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b" ", b"ab", b" a", b"ba"]
    vocabulary = langid.Vocabulary(sorted(pieces))
    p = np.random.default_rng(0).random(len(pieces))
    model = langid.Model(["x"], sorted(pieces), np.log(p)[:, None])
    of = dict(zip(sorted(pieces), p))

    def total(w):
        return 1.0 if not w else sum(of[w[:n]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in of)

    got = np.exp(langid.word_scores(["abab", "b", "baab"], vocabulary, model.scaled(vocabulary))[:, 0])
    want = [total(b" " + w) * langid.SCALE ** (len(w) + 1) for w in (b"abab", b"b", b"baab")]
    assert np.allclose(got, want)


def test_language_held_out_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, PIECES)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg(F.expr("cast(lang = lang_pred AS int)"))).first()[0] > 0.97
    undecided = {r.doc_id for r in langid.identify(odd, model).filter("lang_pred = 'und'").collect()}
    assert undecided == {1, 2, 3, 8}
    assert langid.identify(none, langid.fit(none, PIECES)).count() == 0


def test_a_rare_language_is_learned(spark):
    from nearspark.llm.sampling import bounded_ids_by, fair_share
    rows = [(i, f"the house of number {i} is near the river", "en") for i in range(3000)]
    rows += [(10_000 + i, f"šis nams ir pie upes un meža {i}", "lv") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, PIECES, most_docs=100)
    assert model.langs == ["en", "lv"]
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert {found[10_000 + i] for i in range(4)} == {"lv"} and {found[i] for i in range(3000)} == {"en"}
    got = bounded_ids_by(docs, "doc_id", "lang", 100, 2).collect()
    lv = [r for r in got if r.lang == "lv"]
    assert 0 < len(lv) <= 4 and len(got) == 100 and len(set(got)) == 100
    assert [fair_share(x, 10, 2) for x in ([], [3], [20, 1], [9, 9, 9, 9, 9, 9])] == [2, 3, 9, 2]


def test_quality_and_toxicity_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    crf = quality.fit(docs, labels)
    got = quality.score(docs, crf).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg(F.expr("cast(predicted = quality AS int)"))).first()[0] > 0.97
    assert {r.score for r in quality.score(odd, crf).filter("doc_id IN (1, 2, 3)").collect()} == {0.0}
    ordinal = toxicity.fit(docs, labels)
    assert (np.diff(ordinal.thresholds) > 0).all()
    got = toxicity.score(docs, ordinal).join(labels, "doc_id").groupBy("toxic").agg(
        F.avg(F.expr("cast(p_toxic >= 0.5 AS int)")).alias("flagged")).collect()
    flagged = {r.toxic: r.flagged for r in got}
    assert flagged[1] > 0.6 and flagged[0] < 0.01
    assert toxicity.score(odd, ordinal).count() == len(ODD) and toxicity.score(none, ordinal).count() == 0


def test_quality_of_lines_of_control_bytes(spark):
    clean, odd = "A clean line of plain words.\nAnd one more of them.", "A clean line.\n\x01\x02 \x7f\nAnd one more."
    texts = [clean, odd, clean, "\x01\x02", clean, "", clean]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert np.isfinite(model.weights).all() and np.isfinite(model.transition).all()
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    alone = {i: quality.score(docs.filter(F.col("doc_id") == i), model).first().score for i in (0, 1)}
    assert 0 < alone[1] < 1 and got[1] == pytest.approx(alone[1]) and got[3] == got[5] == 0
    assert 0 < alone[0] < 1 and [got[i] for i in (0, 2, 4, 6)] == pytest.approx([alone[0]] * 4)


def test_graph_search_recall(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    bad = spark.createDataFrame([(-1, None), (-20, [0.0] * 64), (-40, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    got = ann.search_table(rows.select("vec_id", "embedding").union(bad)).toPandas()
    full = rows.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(full.embedding).astype(float), full.vec_id.to_numpy()
    hits = []
    for q, part in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(part.vec_id)) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.95 and got["rank"].max() == 20


def test_warc_round_trip_with_chunks(spark):
    mark = "\r\n\r\nWARC/1.1\r\n"
    html = {1: None, 2: "", 3: "é" * 3000, 4: "é" * 3000, 5: "x" + mark * 400 + "y\r\n\r\n", 6: "s", 7: "s"}
    pages = spark.createDataFrame([(i, "http://x/ \r\n", h) for i, h in html.items()], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc_chunks.round_trip(pages, chunk_bytes=1001).collect()}
    import hashlib
    assert len(got) == len(html)
    for i, h in html.items():
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert got[3].record_type == "revisit" and got[3].refers_to == 4
    assert {got[i].record_type for i in (1, 2, 4, 5, 6, 7)} == {"response"}


def test_warc_repeated_rows_and_null_ids_of_several_chunks(spark, tmp_path):
    import hashlib
    rows = [(1, "a" * 3500), (1, "a" * 3500), (2, "b" * 2000), (2, "b" * 2000), (3, "c" * 900), (3, "c" * 900),
            (None, "d" * 3500), (None, "e" * 3500), (None, "f" * 3500)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    path = str(tmp_path / "warc")
    warc_chunks.write(pages, path, chunk_bytes=1000)
    got = [(r.page_id, r.payload_bytes, r.payload_digest) for r in warc_chunks.read_pages(spark, path).collect()]
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    chunks = warc_chunks.read_chunks(spark, path)
    for lost in (0, 1, 3):  # a record without one of its segments fails
        with pytest.raises(Exception, match="record <urn:page:1:"):
            warc_chunks.chunk_digests(chunks.filter(f"page_id = 1 AND chunk_no != {lost}")).collect()


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_small_batches_keep_smaller_settings_and_lower_larger_ones(spark):
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        spark.conf.set(rows, "10")
        spark.conf.set(size, "64MB")
        staging.small_batches(spark, rows=1000, n_bytes=4096)
        assert int(spark.conf.get(rows)) == 10
        texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
        sizes = texts.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
        got = [r["n"] for r in sizes.collect()]
        assert sum(got) == 100 and max(got) <= 2
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])


def test_warc_keeps_payloads_of_equal_ids(spark, none):
    a, b = "A" * 2000, "B" * 2000
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (1, a)]
    df = spark.createDataFrame([(i, h, 9, "x") for i, h in rows], "page_id long, html string, n int, sha1 string")
    import hashlib
    sha = {x: hashlib.sha1(x.encode()).hexdigest() for x in (a, b)}
    got = sorted(((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc_chunks.round_trip(df).collect()), key=str)
    assert got == sorted([(0, sha[a], "response", None), (1, sha[a], "revisit", 2), (1, sha[a], "revisit", 2),
                          (1, sha[b], "revisit", 3), (2, sha[a], "response", None), (3, sha[b], "response", None)], key=str)
    assert warc_chunks.round_trip(none.selectExpr("doc_id page_id", "text html")).collect() == []


def test_warc_long_payload_is_cut_once(spark):
    import hashlib
    text = ("é\r\n\r\nWARC/1.1\r\n" + "x" * 999) * 32_000  # 32 MB, a record mark every kilobyte
    df = spark.createDataFrame([(1, "short")], "page_id long, html string").union(
        spark.range(1).select(F.lit(2).cast("long"), F.expr("repeat('é\\r\\n\\r\\nWARC/1.1\\r\\n' || repeat('x', 999), 32000)")))
    got = {r.page_id: r for r in warc_chunks.round_trip(df).collect()}
    assert got[2].payload_bytes == len(text.encode())
    assert got[2].payload_digest == hashlib.sha1(text.encode()).hexdigest()
    assert got[1].payload_bytes == 5


def test_cuts_are_linear_and_whole():
    raw = memoryview(b"ab\r\n\r\nWARC/1.1\r\ncd" * 3 + b"x" * 100)
    ends = warc_chunks._cuts(raw, 7)
    assert ends[-1] == len(raw) and all(0 < b - a <= 7 for a, b in zip([0, *ends], ends))
    pieces = [bytes(raw[a:b]) for a, b in zip([0, *ends], ends)]
    assert b"".join(pieces) == bytes(raw) and not any(b"\r\n\r\nWARC/1.1" in x for x in pieces)


def test_every_letter_before_a_mark():
    import unicodedata
    letters = [c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c)[0] in "LN"]
    words = [w for c in letters for w in (c + "!!", "a" + c + "'s.")]
    tok = tokens.WordTokenizer(WORD_TOKENIZER)
    ids, counts = tok.encode(pa.array(words))
    plain = tok.tokenizer.encode_batch_fast(words, add_special_tokens=False)
    ends = np.cumsum(counts)
    assert [ids[b - n:b].tolist() for b, n in zip(ends.tolist(), counts.tolist())] == [x.ids for x in plain]


def test_nearest_breaks_ties_by_id_and_takes_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, v int, rank int"
    rows = [(i, [1.0, float(i)], 0, 0) for i in range(60)]  # the query is id 0: every inner product is 1
    got = ann.search_table(spark.createDataFrame(rows, schema), every=100, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r["rank"], r.score) for r in got] == [(i, i, 1.0) for i in range(1, 6)]
    few = [(0, [1.0, 0.0], 0, 0), (0, [3.0, 0.0], 0, 0), (None, [1.0, 1.0], 0, 0), (1, [2.0, 0.0], 0, 0), (2, None, 0, 0)]
    got = ann.search_table(spark.createDataFrame(few, schema), every=100, k=5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0)]
    assert ann.search_table(spark.createDataFrame([], schema), every=100, k=5).collect() == []


def test_codec_takes_any_vocabulary_and_id_type(spark):
    rng = np.random.default_rng(2)
    for ids in (np.arange(70_000), np.concatenate([rng.permutation(300_000), rng.integers(0, 50, 5000)]),
                np.array([2 ** 32 - 1, 0, 2 ** 32 - 1])):
        ids = ids.astype(np.uint32)
        assert np.array_equal(idcodec.unpack_chunk(idcodec.pack_chunk(ids)), ids)
    for kind in ("short", "string", "double"):
        df = spark.createDataFrame([(2, "b"), (1, "a"), (None, None)], "i long, text string").selectExpr(
            f"cast(i AS {kind}) AS doc_id", "text", "'x' AS part", "1 AS chunk")
        got = idcodec.read_ids(idcodec.write_ids(df, WORD_TOKENIZER)).orderBy("start").collect()
        assert [r.start for r in got] == [0, 1, 3] and got[0].doc_id is None


def test_piece_cache_cut_back_gives_the_same_ids(spark, sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    plain = tokens.WordTokenizer(WORD_TOKENIZER)
    want = [plain.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "MOST_PIECES", 500)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 3000)
    ids, counts = tokens.WordTokenizer(WORD_TOKENIZER).encode(pa.array(texts))
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_presence_filter_loses_no_row(spark):
    docs = spark.range(3000).selectExpr("id AS _id", "'t' AS text")
    wanted = docs.filter("_id % 50 = 7").selectExpr("_id")
    kept = jaccard._pass_filter(docs, "_id", jaccard._packed_filter(wanted, "_id"))
    assert kept.columns == ["_id", "text"] and kept.join(wanted, "_id").count() == wanted.count() and kept.count() < 100


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(3)
    for n in (6, 60, 600):
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        for swap in range(0, n // 2, max(n // 20, 1)):
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 2 ** 63, swap).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            links = 100 * both >= 80 * (len(a) + len(b) - both)
            sk = [np.frombuffer(jaccard.sketch(x), np.uint8)[None] for x in (a, b)]
            may = jaccard.may_link(np.array([len(a)]), sk[0], np.array([len(b)]), sk[1], 80)[0]
            assert may or not links
