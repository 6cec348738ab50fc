"""Document quality by a linear-chain conditional random field over lines.

Every non-empty line is good or bad. A line's features are byte-class shares,
word repetition and length, each also averaged over its two neighbouring lines;
transition weights tie neighbours together. Forward-backward gives each line's
marginal probability of being good, and a text's score is their mean weighted by
line length in bytes. Forward-backward runs over all texts of a slice in step.

Labels mark texts, not lines. The fit (a bounded sample of ``MOST_TRAINING_DOCS``
labelled documents) first gives each line its text's label, then once more labels
the lines of bad texts by the first fit (at least the worst line stays bad).

Null and empty texts (no line with a word) score 0, and so do texts of nothing but
control bytes: these are in no byte class, and a line of them alone has length 0. Repeated rows are scored
alike; other columns are ignored. Without learnable labels of both kinds every
text with a line scores 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from dataclasses import dataclass
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm import textops as T
from nearspark.llm.sampling import bounded_ids, held_out

MOST_TRAINING_DOCS = 3000
GOOD_FROM = 0.7


def _class_table() -> np.ndarray:
    """Byte class: 1 lower letter or non-ASCII, 2 capital, 3 digit, 4 sentence mark, 5 '!', 6 '|', 7 other mark."""
    t = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        t[b] = (1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:?'\"()-"
                else 5 if c == "!" else 6 if c == "|" else 7)
    t[128:] = 1
    return t


_CLASS = _class_table()
_OWN = 11  # features of a line itself
N_FEATURES = 2 * _OWN + 1


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, line lengths in bytes, index of each text's first line)``."""
    breaks = np.flatnonzero(data == 10)
    edge = np.unique(np.concatenate([breaks, off]))  # a line lies between two neighbouring edges
    s, e, _ = T.word_spans(data, off)
    word_line = np.searchsorted(edge, s, side="right") - 1
    lines = np.unique(word_line)  # those with a word
    words = np.bincount(word_line, minlength=len(edge))[lines]
    a, b = edge[lines], np.append(edge, len(data))[lines + 1]
    cls = _CLASS[data]
    count = {}
    for k in range(1, 8):
        total = np.concatenate([[0], np.cumsum(cls == k)])
        count[k] = (total[b] - total[a]).astype(float)
    marks = sum(count.values())
    shown = np.maximum(marks, 1)  # a line of control bytes has none
    h = T.word_hashes(data, s, e)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1])
    repeated = np.bincount(word_line, again, minlength=len(edge))[lines]
    letters = np.maximum(count[1] + count[2], 1)
    own = np.column_stack([
        count[2] / letters, count[3] / shown, count[4] / shown, count[5] / shown, count[6] / shown, count[7] / shown,
        repeated / np.maximum(words - 1, 1), np.log1p(marks) / 8, np.minimum(marks / words, 20) / 10,
        words < 4, np.isin(data[np.maximum(e[np.searchsorted(word_line, lines, side="right") - 1] - 1, 0)],
                           np.frombuffer(b".!?", np.uint8))]).astype(float)
    first = np.searchsorted(a, off)  # a line may start at its text's offset
    doc = np.searchsorted(off, a, side="right") - 1
    doc = np.minimum(doc, len(off) - 2)
    first = np.searchsorted(doc, np.arange(len(off)))
    near = np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    near[1:] += own[:-1] * same[:, None]
    near[:-1] += own[1:] * same[:, None]
    sides = np.zeros(len(own))
    sides[1:] += same
    sides[:-1] += same
    near = np.where(sides[:, None] > 0, near / np.maximum(sides, 1)[:, None], own)
    return np.column_stack([np.ones(len(own)), own, near]), marks, first


@dataclass
class Model:
    weights: np.ndarray  # log-odds of 'bad' from the features of a line
    transition: np.ndarray  # 2 x 2, row: label before


def forward_backward(score: np.ndarray, transition: np.ndarray, first: np.ndarray):
    """Marginals of 'bad', expected transition counts and log-partition of chains of lines.

    ``score`` is the log-potential of 'bad' against 'good' per line; chain ``d``
    owns the lines ``first[d]`` to ``first[d + 1]``. Chains advance in step.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
    up = np.exp(transition)
    # log-potentials may be large: messages are normalised, their scale is kept as a log
    local = np.column_stack([np.zeros(len(score)), np.clip(score, -30, 30)])
    local -= local.max(axis=1, keepdims=True)
    local, shift = np.exp(local), np.maximum(np.clip(score, -30, 30), 0)
    f, b = np.zeros((len(score), 2)), np.ones((len(score), 2))
    log_z = np.zeros(len(n))
    for t in range(longest):
        k = active[t]
        at = start[:k] + t
        m = local[at] if t == 0 else (f[at - 1] @ up) * local[at]
        z = m.sum(axis=1)
        f[at] = m / z[:, None]
        log_z[:k] += np.log(z) + shift[at]
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[:active[t]] + t
        m = local[at] * b[at]
        joint = f[at - 1][:, :, None] * up[None] * m[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        m = m @ up.T
        b[at - 1] = m / m.sum(axis=1, keepdims=True)
    p = f * b
    return p[:, 1] / p.sum(axis=1), pairs, log_z.sum()


def fit_lines(x: np.ndarray, first: np.ndarray, bad: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> Model:
    """Maximum conditional likelihood by Adam."""
    same = np.ones(len(x), bool)
    same[first[:-1][np.diff(first) > 0]] = False
    y = bad.astype(int)
    seen = np.zeros((2, 2))
    follow = np.flatnonzero(same)
    np.add.at(seen, (y[follow - 1], y[follow]), 1)
    theta, m1, m2 = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for t in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / max(len(x), 1) - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + 0.1 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def learn(x: np.ndarray, first: np.ndarray, bad_doc: np.ndarray) -> Model:
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    bad = bad_doc[doc]
    if bad.all() or not bad.any():
        return Model(np.concatenate([[-30.0], np.zeros(N_FEATURES - 1)]), np.zeros((2, 2)))
    model = fit_lines(x, first, bad)
    p, _, _ = forward_backward(x @ model.weights, model.transition, first)
    worst = np.zeros(len(n))
    np.maximum.at(worst, doc, p)
    return fit_lines(x, first, bad & ((p >= 0.5) | (p >= worst[doc])))


def _features(batches):
    for batch in batches:
        for a, n, data, off in T.text_slices(batch):
            x, _, first = line_features(data, off)
            rows = [x[first[i]:first[i + 1]].ravel() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality").slice(a, n), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", most_docs: int = MOST_TRAINING_DOCS) -> Model:
    """Learn from at most ``most_docs`` labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("quality")).filter("quality IS NOT NULL")
    ids = bounded_ids(known, "_id", most_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    sample = rows.join(F.broadcast(ids), "_id").dropDuplicates(["_id"]).select(F.col("quality").cast("int"), "text")
    got = sample.mapInArrow(_features, "quality int, x array<double>").toPandas()
    x = [np.asarray(r, float).reshape(-1, N_FEATURES) for r in got["x"]]
    first = np.concatenate([[0], np.cumsum([len(r) for r in x])]).astype(int)
    x = np.concatenate(x) if x else np.zeros((0, N_FEATURES))
    return learn(x, first, (got["quality"] == 0).to_numpy(bool)) if len(x) else learn(x, first, np.zeros(0, bool))


def _score(shared):
    model = shared.value

    def run(batches):
        for batch in batches:
            for a, n, data, off in T.text_slices(batch):
                x, length, first = line_features(data, off)
                p, _, _ = forward_backward(x @ model.weights, model.transition, first)
                doc = np.repeat(np.arange(n), np.diff(first))
                size = np.bincount(doc, length, minlength=n)
                score = np.bincount(doc, (1 - p) * length, minlength=n) / np.maximum(size, 1)
                score = np.clip(np.where(size > 0, score, 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column("held_out").slice(a, n), pa.array(score),
                     pa.array((score >= GOOD_FROM).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
