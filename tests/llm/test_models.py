"""Chain marginals against enumerated labellings, gradients against finite differences, ordinal likelihood."""

import itertools

import numpy as np
import pytest

from nearspark.llm import langid
from nearspark.llm import quality as Q
from nearspark.llm import toxicity as X


def enumerated(score, transition):
    """Marginals of label 1, expected transitions and log partition of one chain, over all labellings."""
    n = len(score)
    paths = list(itertools.product((0, 1), repeat=n))
    logs = np.array([sum(s for s, y in zip(score, p) if y) + sum(transition[a, b] for a, b in zip(p, p[1:])) for p in paths])
    z = np.logaddexp.reduce(logs)
    w = np.exp(logs - z)
    pairs = np.zeros((2, 2))
    for p, x in zip(paths, w):
        for a, b in zip(p, p[1:]):
            pairs[a, b] += x
    return np.array(paths, float).T @ w if n else np.zeros(0), pairs, z


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = [3, 0, 8, 1, 5, 2, 0]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, transition = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    p, pairs, log_z = Q.forward_backward(score, transition, first)
    each = [enumerated(score[a:b], transition) for a, b in zip(first, first[1:])]
    assert np.allclose(p, np.concatenate([e[0] for e in each]))
    assert np.allclose(pairs, sum(e[1] for e in each))
    assert log_z == pytest.approx(sum(e[2] for e, n in zip(each, lengths) if n))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(9)
    lengths = [4, 6, 1, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    x, y = rng.normal(0, 1, (first[-1], 3)), rng.integers(0, 2, first[-1])
    follow = [i for a, b in zip(first, first[1:]) for i in range(a + 1, b)]

    def likelihood(theta):
        score, t = x @ theta[:3], theta[3:].reshape(2, 2)
        return score[y == 1].sum() + sum(t[y[i - 1], y[i]] for i in follow) - Q.forward_backward(score, t, first)[2]

    theta = rng.normal(0, 0.5, 7)
    p, pairs, _ = Q.forward_backward(x @ theta[:3], theta[3:].reshape(2, 2), first)
    seen = np.zeros((2, 2))
    for i in follow:
        seen[y[i - 1], y[i]] += 1
    gradient = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()])
    numeric = [(likelihood(theta + e) - likelihood(theta - e)) / 2e-6 for e in np.eye(7) * 1e-6]
    assert np.allclose(gradient, numeric, atol=1e-4)


def test_fitted_chain_is_a_maximum():
    rng = np.random.default_rng(2)
    first = np.arange(0, 401, 8)
    x = np.column_stack([np.ones(400), rng.normal(0, 1, 400)])
    bad = x[:, 1] + rng.normal(0, 1.5, 400) > 0
    m = Q.fit_lines(x, first, bad, rounds=1500, ridge=0.0)
    p, pairs, _ = Q.forward_backward(x @ m.weights, m.transition, first)
    assert np.abs(x.T @ (bad - p)).max() / 400 < 2e-3


def test_score_is_the_length_weighted_share_of_good_lines():
    from nearspark.llm import textops as T
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [False], "text": ["one two.\n\n###\nthree"]})

    class Shared:
        value = Q.Model(np.linspace(-1, 1, Q.N_FEATURES), np.array([[0.4, -0.2], [0.1, 0.7]]))
    got = next(iter(Q._score(Shared)(iter([batch]))))["score"][0].as_py()
    _, _, data, off = next(iter(T.text_slices(batch)))
    x, length, first = Q.line_features(data, off)
    p = enumerated(np.clip(x @ Shared.value.weights, -30, 30), Shared.value.transition)[0]
    assert got == pytest.approx(((1 - p) * length).sum() / length.sum())


def grades_objective(w, theta, doc, feature, value, grades, ridge):
    z = np.bincount(doc, w[feature] * value, minlength=len(grades))
    up = np.hstack([np.ones((len(z), 1)), 1 / (1 + np.exp(-(z[:, None] - theta))), np.zeros((len(z), 1))])
    at = np.arange(len(z))
    return np.log(up[at, grades] - up[at, grades + 1]).mean() - ridge / 2 * (w ** 2).sum()


def test_ordinal_fit_is_a_maximum_with_ordered_thresholds():
    rng = np.random.default_rng(4)
    n = 300
    dense = rng.random((n, 3)) * (rng.random((n, 3)) < 0.7)
    doc, feature = np.nonzero(dense)
    value, z = dense[doc, feature], dense @ np.array([3.0, 1.0, 0.0])
    grades = np.minimum((z + rng.logistic(0, 0.7, n) > np.array([[0.8], [1.8], [2.8]])).sum(axis=0), X.GRADES)
    w, theta = X.fit_grades(doc, feature, value, grades, 3, rounds=6000, ridge=1e-3)
    assert (np.diff(theta) > 0).all()
    best = grades_objective(w, theta, doc, feature, value, grades, 1e-3)
    for i, step in itertools.product(range(3), (1e-3, -1e-3)):
        for dw, dt in ((np.eye(3)[i] * step, 0), (0, np.eye(len(theta))[i % len(theta)] * step)):
            assert grades_objective(w + dw, theta + dt, doc, feature, value, grades, 1e-3) <= best + 1e-6


def test_expected_severity_is_the_sum_over_grades():
    m = X.Model({"bad": 2.0}, np.array([0.5, 1.5, 3.0])[:X.GRADES])
    up = m.exceed(np.array([-5.0, 0.0, 2.0, 9.0]))
    assert np.allclose(up, 1 / (1 + np.exp(-(np.array([-5.0, 0.0, 2.0, 9.0])[:, None] - m.thresholds))))
    p = np.hstack([np.ones((4, 1)), up]) - np.hstack([up, np.zeros((4, 1))])
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p @ np.arange(p.shape[1]), up.sum(axis=1))


def test_words_that_a_task_remembers_are_summed_once(monkeypatch):
    pieces = sorted({bytes([b]) for b in range(1, 256)} | {b" th", b" the", b"ing", b"re", b"str"})
    rng = np.random.default_rng(5)
    log_p = np.log(rng.dirichlet(np.ones(len(pieces)), 3).T)
    vocabulary = langid.Vocabulary(pieces)
    p = langid.Model(["a", "b", "c"], pieces, log_p).scaled(vocabulary)
    words = ["the", "thing", "string", "x" * 100, "resting", "é" * 30, "a", "then"]
    want, plain, asked = langid.word_scores(words, vocabulary, p), langid.word_scores, []
    monkeypatch.setattr(langid, "word_scores", lambda w, v, q: asked.extend(w) or plain(w, v, q))
    for most in (0, 3, 100):
        scores = langid.WordScores(vocabulary, p, most)
        for _ in range(3):
            np.testing.assert_allclose(scores(words), want, rtol=1e-12)
            np.testing.assert_allclose(scores(words[::-1][:5]), want[::-1][:5], rtol=1e-12)
            assert len(scores.place) == len(scores.rows) <= most
    asked.clear()
    scores = langid.WordScores(vocabulary, p)
    scores(words), scores(words)
    assert sorted(asked) == sorted([*words, "x" * 100, "é" * 30])  # long words are not kept
