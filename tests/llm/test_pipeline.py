"""The corpus pipeline, stage by stage, against plain Python on sf0.001 with odd rows."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from nearspark.llm import langid, toxicity
from nearspark.llm.queries import PIECES, WORD_TOKENIZER
from nearspark.llm.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, bool(words)))}


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """sf0.001 with nulls, empty and long texts, copies, repeated rows and a benchmark passage."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = max((r.text for r in bench.collect()), key=lambda t: len(t.split()))
    base = max((r.text for r in docs.collect() if r.text), key=len)
    near = " ".join(w for i, w in enumerate(base.split()) if i % 200)
    rows = [(100_001, None), (100_002, ""), (100_003, " \n"), (100_004, "123 456"), (100_005, base), (100_006, near),
            (100_007, "Before it. " + item + " After it."), (None, base), (100_008, base[:300]), (100_008, base[:300]),
            (100_009, "the of and to in a is that for " * 20_000)]
    odd = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], docs.schema)
    docs.unionByName(odd).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, step in C.STAGES:
        got = stage(step(spark, docs, folder), f"test-{name}")
        out[name] = (docs, got)
        docs = got
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def without(df, bad):
    """Rows whose id is not in ``bad``."""
    return [r for r in rows_of(df) if r[0] not in bad]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    assert all(got.columns == COLUMNS for n, (_, got) in stages.items() if n != "packing")


def test_language_stage(stages):
    docs, got = stages["language"]
    found = langid.identify(docs, langid.fit(docs, PIECES)).collect()
    bad = {r.doc_id for r in found if r.lang_pred == "und" or r.score < C.LEAST_LANGUAGE_POSTERIOR}
    assert {100_001, 100_002, 100_003, 100_004} <= bad and len(bad) < 20
    assert rows_of(got) == without(docs, bad)


def test_toxicity_stage(spark, stages, folder):
    docs, got = stages["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.p_toxic >= C.TOXIC_FROM}
    assert rows_of(got) == without(docs, bad)


def test_near_duplicates_stage(stages):
    docs, got = stages["near_duplicates"]
    rows = rows_of(docs)
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    bad = {r[0] for i, r in enumerate(rows) if r[0] is not None and least[find(i)] != r[0]}
    assert {100_005, 100_006} <= bad
    assert [r for r in rows_of(got) if r[0] is not None] == [r for r in rows if r[0] is not None and r[0] not in bad]


def test_decontamination_stage(spark, stages, folder):
    docs, got = stages["decontamination"]
    items = [shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0] for r in rows_of(docs) for x in items if x and 10 * len(x & shingles(r[1])) >= 8 * len(x)}
    assert 100_007 in bad
    assert rows_of(got) == without(docs, bad)


def test_packing_stage(stages):
    from tokenizers import Tokenizer
    docs, got = stages["packing"]
    tok = Tokenizer.from_file(WORD_TOKENIZER)
    want = []
    for r in rows_of(docs):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(ids[i:i + 2048].tobytes()))
                 for i in range(0, len(ids), 2048)]
    rows = got.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048


def test_run_is_the_stages_in_a_row(spark, folder, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    once = sorted((tuple(r) for r in C.run(spark, folder).select(*key).collect()), key=repr)
    assert once == sorted((tuple(r) for r in stages["packing"][1].select(*key).collect()), key=repr)


def test_empty_documents(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    assert C.run(spark, path).collect() == []
