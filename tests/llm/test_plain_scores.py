"""Operators 4, 5 and 7 against plain versions: one text, one window, one step, one centroid, one grade at a time."""
import math

import numpy as np
import pytest

from geoping.llm import language_id, quality_grade, toxicity

TEXTS = ["one two three", "A longer text, with some more words in it! " * 9, "ça va très bien 123", "x", "", None, "the end | of | it #", "word " * 200]
DOCS = list(enumerate(TEXTS))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def raw_of(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.array([0, len(raw)]), raw


def test_ordinal_grades(frame):
    rng = np.random.default_rng(1)
    model = quality_grade.CumulativeLink(4)
    model.w = rng.standard_normal(len(model.w))
    model.free = np.array([-0.7, 0.3, -0.4])
    cuts = [-0.7, -0.7 + math.exp(0.3), -0.7 + math.exp(0.3) + math.exp(-0.4)]
    got = {r.row.doc_id: r for r in quality_grade.grade(frame(DOCS), model, ["doc_id"]).collect()}
    for i, text in DOCS:
        _, columns, values, words = quality_grade.features(*raw_of(text))
        z = sum(float(v) * float(model.w[c]) for c, v in zip(columns.tolist(), values.tolist(), strict=True))
        upto = [0.0] + [sigmoid(c - z) for c in cuts] + [1.0]
        p = [b - a for a, b in zip(upto, upto[1:], strict=False)]
        if not words[0]:
            p = [0.0] * 4
        assert got[i].expected_grade == pytest.approx(sum(k * v for k, v in enumerate(p)), abs=1e-5)
        assert got[i].tail_probability == pytest.approx(p[3], abs=1e-5)
        assert got[i].grade_pred == (p.index(max(p)) if words[0] else 0) and got[i].selected == (got[i].tail_probability >= quality_grade.SELECT)


def test_a_stray_grade_is_an_error(frame):
    rated = frame([(1, "a b c"), (2, "d e f")]).selectExpr("doc_id AS id", "text", "CASE WHEN doc_id = 1 THEN 0 ELSE 1000000000 END AS grade")
    with pytest.raises(ValueError):
        quality_grade.train(rated)


def plain_network(net, batch, inputs, index):
    """Probability of one window: a GRU each way, word by word, then attention."""
    h_size, p = toxicity.HIDDEN, net.p
    places = [k for k in index.tolist() if k >= 0]
    sides = []
    for side in "fb":
        h, out = np.zeros(h_size), {}
        for t in range(len(places)) if side == "f" else reversed(range(len(places))):
            g = inputs[places[t]] @ p[f"W{side}"] + p[f"b{side}"]
            z = [sigmoid(g[k] + h @ p[f"U{side}"][:, k]) for k in range(h_size)]
            r = [sigmoid(g[h_size + k] + h @ p[f"U{side}"][:, h_size + k]) for k in range(h_size)]
            new = [math.tanh(g[2 * h_size + k] + r[k] * (h @ p[f"U{side}"][:, 2 * h_size + k])) for k in range(h_size)]
            h = np.array([(1 - z[k]) * new[k] + z[k] * h[k] for k in range(h_size)])
            out[t] = h
        sides.append(out)
    states = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(places))]
    weights = [math.exp(float(np.tanh(s @ p["A"] + p["a"]) @ p["v"])) for s in states]
    pooled = sum(w * s for w, s in zip(weights, states, strict=True)) / sum(weights)
    return sigmoid(float(pooled @ p["o"] + p["c"][0]))


def test_toxicity_scores(frame):
    rng = np.random.default_rng(2)
    odds = tuple((0.3 * rng.standard_normal(toxicity.BUCKETS)).astype(np.float32) for _ in range(2))
    net = toxicity.Network(seed=11)
    got = {r.row.doc_id: r for r in toxicity.score(frame(DOCS), (odds, net, 0.25), ["doc_id"]).collect()}
    for i, text in DOCS:
        batch = toxicity.Batch(*raw_of(text))
        words = int(batch.counts[0])
        windows = math.ceil(max(0, words - toxicity.WINDOW) / toxicity.STRIDE) + 1 if words else 0
        assert got[i].n_windows == windows == len(batch.index)
        fixed = toxicity.prior(batch, odds)
        word, char = toxicity._ids(batch)
        inputs = [np.concatenate([0.5 * fixed[k], net.p["words"][word[k]], net.p["chars"][char[batch.ptr[k]:batch.ptr[k + 1]]].mean(axis=0)]) for k in range(len(word))]
        want = max((plain_network(net, batch, inputs, index) for index in batch.index), default=0.25)
        assert got[i].score == pytest.approx(want, abs=2e-5)


def test_nearest_centroid(frame):
    rng = np.random.default_rng(3)
    centres = np.abs(rng.standard_normal((5, language_id.DIMENSIONS))).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    idf = np.abs(rng.standard_normal(language_id.DIMENSIONS)) + 0.1
    model = language_id.Centroids(idf, ["aa", "bb", "cc"], centres, np.array([0, 0, 1, 2, 2]), np.array([0.2, 0.9, 0.99, 0.5, 0.95]))
    got = {r.row.doc_id: r for r in language_id.identify(frame(DOCS), model, ["doc_id"]).collect()}
    for i, text in DOCS:
        x, count = language_id.vectors(*raw_of(text), idf)
        if not count[0]:
            assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
            continue
        live = np.flatnonzero(x[0]).tolist()
        cosine = [sum(float(x[0][k]) * float(c[k]) for k in live) for c in centres]
        best = max(range(5), key=cosine.__getitem__)
        assert got[i].lang_pred == model.languages[model.owner[best]] and got[i].score == pytest.approx(cosine[best], abs=1e-4)
        assert got[i].rejected == (1 - cosine[best] > model.radius[best])
