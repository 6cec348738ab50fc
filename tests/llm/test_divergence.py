"""Source divergence: against plain Python, odd rows, exact arithmetic beyond 64 bits."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from nearspark.llm import divergence as D

SCHEMA = "text string, lang string, source string, value long, term string"


def expected(rows, least=3, top=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)))
            for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        count = defaultdict(Counter)
        for _, source, terms in mine:
            count[source].update(t for t in terms if t in set(kept))
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in count:
            pairs = {o: sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept)
                     for o in count if o != s}
            terms = {t: (p(count[s], t) - p(whole, t)) ** 2 // p(whole, t) for t in kept
                     if count[s][t] and p(count[s], t) > p(whole, t)}
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item] = (v, rank)
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "own") for r in rows], SCHEMA)
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in D.audit(df, **options).collect()}


def test_matches_plain_python_on_odd_rows(spark):
    rows = [("a b c", "en", "x"), ("A b é", "en", "y"), ("a b b b", "en", "y"), ("a-b9c É", "en", "z"), ("c é c", "en", "z"),
            ("a b c", "en", "x"), ("", "en", "empty"), (None, "en", None), ("eins zwei", "de", "x"),
            (None, "de", "y"), ("q w", None, None), ("q w", None, None), ("q W", None, "x"), ("q\x00w", "", "x"),
            ("x " * 30_000 + "ß", "fr", "x"), ("x ß", "fr", "y"), ("ß x 中文", "fr", "y"), ("中文", "fr", "x"), ("中文", "fr", "z")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, least_docs=1, top=2) == expected(rows, 1, 2)


def test_matches_plain_python_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert found(spark, rows) == expected(rows)


def test_many_blocks_give_the_same_sums(spark, sf, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    monkeypatch.setattr(D, "BLOCK_ROWS", 97)
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_slices_merge(sf):
    batch = pa.RecordBatch.from_pydict({"text": ["a b a", None, "b", "a"], "lang": ["en", "en", "", "en"],
                                        "source": ["s", "s", "t", "u"]})
    rows = [r for t in D._count(iter([batch, batch])) for r in t.to_pylist()]
    assert sorted(map(tuple, (r.values() for r in rows))) == [("", "t", "b", 2, 2), ("en", "s", "a", 4, 2),
                                                              ("en", "s", "b", 2, 2), ("en", "u", "a", 2, 2)]


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(9 * 10 ** 9 + 7, 10 ** 13, 12345), (10 ** 12 + 3, 3 * 10 ** 12, 999), (5, 77, 3)]
    df = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", D._p("c", "n").alias("p"))
    assert all(r.p == 1 + 10 ** 9 * (r.c + 1) // (r.n + r.v) for r in df.collect())
    ends, p = D._runs(np.array([0, 0, 5 * 10 ** 11, 7]), np.array([3, 5, 6, 9]), 10 ** 12, 9)
    assert ends.tolist() == [5, 6, 9]
    assert p.tolist() == [1 + 10 ** 9 * (c + 1) // (10 ** 12 + 9) for c in (0, 5 * 10 ** 11, 7)]
