"""The positive-unlabelled risk by numeric gradients, and fingerprints by sets of word chains: nothing here calls what it judges by."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from folioloom.llm import spotsigs, toxicity  # noqa: E402


def dense(lists, width):
    x = np.zeros((len(lists), width))
    for k, row in enumerate(lists):
        for f in row:
            x[k, f] += 1
    return x


def softplus(z):
    return np.logaddexp(0, z)


def numeric_fit(p, u, prior, seed):
    """Adam on central differences of the non-negative risk, by the same draws of batches."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(p.shape[1] + 1)
    m, v, t, turned = np.zeros(len(theta)), np.zeros(len(theta)), 0, 0

    def negative(th, pb, ub):
        return softplus(ub @ th[:-1] + th[-1]).mean() - prior * softplus(pb @ th[:-1] + th[-1]).mean()

    def positive(th, pb):
        return prior * softplus(-(pb @ th[:-1] + th[-1])).mean()

    for _ in range(toxicity.EPOCHS):
        parts = np.array_split(rng.permutation(len(p)), toxicity.BATCHES), np.array_split(rng.permutation(len(u)), toxicity.BATCHES)
        for a, b in zip(*parts, strict=True):
            pb, ub = p[a], u[b]
            below = negative(theta, pb, ub) < 0
            turned += below
            goal = (lambda th, pb=pb, ub=ub: -negative(th, pb, ub)) if below else (lambda th, pb=pb, ub=ub: positive(th, pb) + negative(th, pb, ub))
            g = np.zeros(len(theta))
            for k in range(len(theta)):
                step = np.zeros(len(theta))
                step[k] = 1e-5
                g[k] = (goal(theta + step) - goal(theta - step)) / 2e-5
            g[:-1] += toxicity.DECAY * theta[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta, turned


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_risk_and_gradient(monkeypatch, prior):
    monkeypatch.setattr(toxicity, "EPOCHS", 12)
    monkeypatch.setattr(toxicity, "BATCHES", 3)
    rng = np.random.default_rng(4)
    p = [sorted({int(f) for f in rng.choice(6, 3)} | {0}) for _ in range(30)]
    u = [sorted({int(f) for f in rng.choice(6, 3)} - ({0} if rng.random() < 0.7 else set())) for _ in range(50)]
    vocabulary = np.arange(6)
    rows = [toxicity._Rows([np.array(x, np.int64) for x in part], vocabulary) for part in (p, u)]
    w, b = toxicity.nnpu_fit(rows[0], len(p), rows[1], len(u), 6, prior, 7)
    # the features' weights within a row are the module's own; take them from it
    x = [np.zeros((len(part), 6)) for part in (p, u)]
    for k, part in enumerate((p, u)):
        columns, at = rows[k].some(np.arange(len(part)))
        np.add.at(x[k], (at, columns), 1)
    assert all((x[k] == dense(part, 6)).all() for k, part in enumerate((p, u)))
    theta, turned = numeric_fit(x[0], x[1], prior, 7)
    assert np.allclose(np.append(w, b), theta, atol=2e-3)
    assert turned or prior < 0.5  # with a large prior the risk of the negatives goes below zero, and the step turns
    assert w[0] > max(w[1:])


def chains(text):
    """The set of chains of a text, as tuples of words."""
    words = re.findall(r"\w+", text.lower())
    found = set()
    for i, word in enumerate(words):
        if word in spotsigs.ANCHORS:
            after = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if after:
                found.add((word, *after))
    return found or {("", *words) if words else ("", text)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_fingerprints_by_chains(spark):
    rng = random.Random(12)
    common, other = ["the", "is", "der", "and", "a"], [f"w{k}" for k in range(25)]

    def prose(n):
        return " ".join(rng.choice(common if rng.random() < 0.4 else other) for _ in range(n))

    texts = [(k * 2, prose(rng.randrange(60))) for k in range(40)]
    texts += [(200, None), (201, ""), (202, "!!"), (203, "?"), (204, "only content here"), (205, "the"), (206, "the end"), (207, texts[5][1]), (208, prose(20_000))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, bucket string, ahead string")
    rows = {r["doc_id"]: r for r in spotsigs.fingerprints(df).collect()}
    assert len(rows) == len(texts)
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(chains(text), chains(edited))) and r["near_next"] == pytest.approx(jaccard(chains(text), chains(following)))
        assert len(r["fingerprint"]) == 16 * len(chains(text)) and len(r["edited_fingerprint"]) == 16 * len(chains(edited))
    assert rows[207]["fingerprint"] == rows[10]["fingerprint"] and rows[200]["fingerprint"] == rows[201]["fingerprint"] != rows[202]["fingerprint"]
