"""Toxicity by cumulative-link ordinal regression.

``P(severity > k) = sigmoid(w . x - theta_k)`` for ``theta_0 < theta_1 < theta_2``:
all thresholds share the weights ``w``, and the expected severity is the sum of the
three probabilities. The features are sparse: which words and word beginnings (four
to six letters) a text holds, as ``log2(1 + occurrences)``; only features that go
with the toxic label significantly take part.

The labels mark toxic texts, not how toxic they are. Grades for the fit come from
the selected features: a text that is not toxic has grade 0, a toxic one grade 1, 2
or 3 by thirds of how often selected words occur in it. The fit uses a bounded sample
(``MOST_TRAINING_DOCS`` labelled documents); texts are scored whole.

Null and empty texts hold no feature and get the score of an empty vector, as all
texts do when no label is learnable. Repeated rows are scored alike; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.sampling import bounded_ids
from nearspark.llm.staging import stage
from nearspark.llm.textops import give_back_memory, keep_memory_low, mix

MOST_TRAINING_DOCS = 6000
GRADES = 3
LEAST_TEXTS = 8  # toxic training texts that must hold a feature
SLICE_BYTES = 2 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """Features of one white-space separated word: its letter runs and their beginnings."""
    out = []
    for w in _LETTERS.findall(word.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in (4, 5, 6) if len(w) > n]
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.array([3.0, 4.0, 5.0]))

    def exceed(self, z: np.ndarray) -> np.ndarray:
        """``P(severity > k)`` per text and threshold."""
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds)))


def _select(texts: list[Counter], toxic: np.ndarray, least: int = LEAST_TEXTS, z_least: float = 5.0) -> list[str]:
    """Features whose share of toxic texts is significantly above the base rate."""
    inside, outside = Counter(), Counter()
    for seen, t in zip(texts, toxic):
        (inside if t else outside).update(seen.keys())
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    out = []
    for f, a in inside.items():
        b = outside[f]
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        if a >= least and z >= z_least and a / n1 >= 10 * b / n0:
            out.append(f)
    return sorted(out)


def fit_grades(x_doc: np.ndarray, x_feature: np.ndarray, x_value: np.ndarray, grades: np.ndarray,
               n_features: int, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam; thresholds as a first value and positive steps."""
    n = len(grades)
    w, cut = np.zeros(n_features), np.array([2.0] + [0.0] * (GRADES - 1))
    m1, m2 = np.zeros(n_features + GRADES), np.zeros(n_features + GRADES)
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        z = np.bincount(x_doc, w[x_feature] * x_value, minlength=n)
        up = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-(z[:, None] - theta))), np.zeros((n, 1))])
        at = np.arange(n)
        p = np.maximum(up[at, grades] - up[at, grades + 1], 1e-12)
        slope = up * (1 - up)  # of each cumulative probability in z
        dz = (slope[at, grades] - slope[at, grades + 1]) / p
        d_theta = np.zeros((n, GRADES + 2))
        d_theta[at, grades] -= slope[at, grades] / p
        d_theta[at, grades + 1] += slope[at, grades + 1] / p
        g_theta = d_theta[:, 1:-1].sum(axis=0) / n
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_cut = np.concatenate([tail[:1], tail[1:] * np.exp(cut[1:])])
        g_w = np.bincount(x_feature, dz[x_doc] * x_value, minlength=n_features) / n - ridge * w
        g = np.concatenate([g_w, g_cut])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
        w, cut = w + step[:n_features], cut + step[n_features:]
    return w, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))


def learn(texts: list[Counter], toxic: np.ndarray) -> Model:
    chosen = _select(texts, toxic)
    if not chosen:
        return Model()
    at = {f: i for i, f in enumerate(chosen)}
    rows = [[(at[f], n) for f, n in seen.items() if f in at] for seen in texts]
    hits = np.array([sum(n for _, n in r) for r in rows])
    with_hits = hits[toxic & (hits > 0)]
    low, high = np.quantile(with_hits, [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (hits > low).astype(int) + (hits > high), 0)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([i for r in rows for i, _ in r], np.int64)
    value = np.log2(1 + np.array([n for r in rows for _, n in r], float))
    w, theta = fit_grades(doc, feature, value, grades, len(chosen))
    return Model(dict(zip(chosen, w.tolist())), theta)


def _bands(words: list[str], bands: int = 6, rows: int = 2) -> list[int]:
    """MinHash bands over three-word shingles: near copies share one, unlike texts hardly ever."""
    if not words:
        return []
    h = np.array([zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(len(words) - 2, 1))], np.uint64)
    low = [int(mix(h + np.uint64(j << 40)).min()) for j in range(bands * rows)]
    return [hash((j, *low[j:j + rows])) for j in range(0, bands * rows, rows)]


def _count(batches):
    for batch in batches:
        words = [(t or "").lower().split() for t in batch.column("text").to_pylist()]
        seen = [Counter(f for w in ws for f in features_of(w)) for ws in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("toxic"), pa.array([_bands(ws) for ws in words], pa.list_(pa.int64())),
             pa.array([list(s) for s in seen], pa.list_(pa.string())),
             pa.array([list(s.values()) for s in seen], pa.list_(pa.int32()))],
            names=["_id", "toxic", "bands", "feature", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", most_docs: int = MOST_TRAINING_DOCS) -> Model:
    """Learn from at most ``most_docs`` labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("toxic")).filter("toxic IS NOT NULL")
    ids = bounded_ids(known, "_id", most_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    sample = rows.join(F.broadcast(ids), "_id").dropDuplicates(["_id"]).select(
        "_id", F.expr("toxic > 0").alias("toxic"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    counted = stage(sample.mapInArrow(
        _count, f"_id {kind}, toxic boolean, bands array<long>, feature array<string>, n array<int>"), "toxic-sample")
    # A near copy of an earlier text of the sample is no evidence of its own.
    band = counted.select("_id", F.explode("bands").alias("band"))
    copies = band.join(band.groupBy("band").agg(F.min("_id").alias("first")), "band").filter("first < _id")
    counted = counted.join(copies.select("_id").distinct(), "_id", "left_anti")
    # Only features that can be chosen (see ``_select``) are gathered: the rest stays on the executors.
    n = {bool(r[0]): r[1] for r in counted.groupBy("toxic").count().collect()}
    n1, n0 = max(n.get(True, 0), 1), max(n.get(False, 0), 1)
    each = counted.select("_id", "toxic", F.explode(F.arrays_zip("feature", "n")).alias("x"))
    each = each.select("_id", "toxic", F.col("x.feature").alias("f"), F.col("x.n").alias("n"))
    common = (each.groupBy("f").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
              .filter((F.col("a") >= LEAST_TEXTS) & (F.col("a") * n0 >= F.col("b") * 10 * n1)).select("f"))
    got = (each.join(common, "f").groupBy("_id").agg(F.collect_list("f").alias("f"), F.collect_list("n").alias("n"))
           .join(counted.select("_id", "toxic"), "_id", "right").orderBy("_id").toPandas())
    texts = [Counter(dict(zip(f, n))) if f is not None else Counter() for f, n in zip(got["f"], got["n"])]
    return learn(texts, got["toxic"].to_numpy(bool))


def _score(shared):
    model = shared.value

    def of_texts(texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = pc.dictionary_encode(words.flatten())
        known = model.weights
        word, name = [], []
        names: dict[str, int] = {}
        for i, w in enumerate(coded.dictionary.to_pylist()):
            for f in features_of(w):
                if f in known:
                    word.append(i)
                    name.append(names.setdefault(f, len(names)))
        z = np.zeros(len(texts))
        if word:
            weight = np.array([known[f] for f in names])
            word, name = np.array(word), np.array(name)
            used = np.zeros(len(coded.dictionary), bool)
            used[word] = True
            code = coded.indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(used[code])
            first = words.offsets.to_numpy(zero_copy_only=False) - words.offsets[0].as_py()
            doc = np.searchsorted(first, at, side="right") - 1
            # occurrences of each (text, feature); a word may stand for several features
            lo, hi = np.searchsorted(word, code[at], side="left"), np.searchsorted(word, code[at], side="right")
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            key, n = np.unique(np.repeat(doc, hi - lo) * len(names) + name[pick], return_counts=True)
            z = np.bincount(key // len(names), weight[key % len(names)] * np.log2(1 + n), minlength=len(texts))
        return z

    def run(batches):
        keep_memory_low()
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, side="right")))
                exceed = model.exceed(of_texts(texts.slice(a, b - a)))
                grade = (exceed >= 0.5).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(exceed.sum(axis=1)), pa.array(exceed[:, 0]),
                     pa.array(grade)], names=["doc_id", "severity", "p_toxic", "grade"])
                a = b
            give_back_memory()
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, severity, p_toxic, grade)``: expected severity, P(severity > 0), most thresholds passed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _score(shared), f"doc_id {kind}, severity double, p_toxic double, grade int")
