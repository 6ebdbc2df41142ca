"""The language model's steps against plain ones, and what they hash."""

import numpy as np
import pytest

from kgspark.llm import language_model as lm


@pytest.fixture(scope="module")
def block():
    rnd = np.random.default_rng(3)
    sizes = np.concatenate(([1, 2, 1], rnd.integers(3, 900, 60)))
    ids = np.minimum(rnd.zipf(1.4, sizes.sum()) - 1, 499)
    names = np.sort(rnd.integers(1, 1 << 63, 500).astype(np.uint64))
    kinds = (rnd.integers(0, lm.CLASSES - lm.TOP, 500) + lm.TOP).astype(np.uint8)
    none = np.zeros(len(sizes), bool)
    return lm.Block(np.arange(len(sizes)), none, none | (np.arange(len(sizes)) % 10 == 0), sizes, names, kinds, ids.astype(np.int32))


def plain_features(b, classes):
    rows = []
    for ids in np.split(b.ids, np.cumsum(b.sizes)[:-1]):
        names, kinds = [2, 1, *b.names[ids].tolist()], [lm.CLASSES] * 2 + classes[ids].tolist()
        for t in range(len(ids)):
            one = names[t + 1] if t else 1
            two = names[t] if t > 1 else 2
            pair = kinds[t + 1] * (lm.CLASSES + 1) + kinds[t]
            rows.append((one, two, pair))
    one, two, pair = (np.array(x, np.uint64) for x in zip(*rows))
    return np.stack([lm.mix(x, salt) for x, salt in ((one, 31), (two, 37), (pair, 41))], axis=1) % np.uint64(lm.FEATURES - 1) + np.uint64(1)


def test_features_hash_names_not_tokens(block, monkeypatch):
    classes = block.kinds.astype(np.int64)
    want = plain_features(block, classes)
    hashed, mix = [], lm.mix
    monkeypatch.setattr(lm, "mix", lambda x, salt=0: hashed.append(len(x)) or mix(x, salt))
    rows, kinds = lm.features(block, classes)
    assert (rows == want).all() and (kinds == classes[block.ids]).all()
    assert sum(hashed) <= 2 * (len(block.names) + 2) + (lm.CLASSES + 1) ** 2 < len(block.ids)


def test_steps_equal_plain_ones(block):
    classes = block.kinds.astype(np.int64)
    rnd = np.random.default_rng(1)
    start = rnd.normal(scale=0.5, size=(lm.FEATURES, lm.CLASSES)).astype(np.float32)
    weights, power, uses = start.copy(), np.zeros(lm.FEATURES), np.zeros(lm.FEATURES)
    lm.descend(weights, block, classes, power, uses)
    used = np.repeat(~block.held_out, block.sizes)
    rows, kinds = plain_features(block, classes)[used].astype(int), classes[block.ids][used]
    w, p, u = start.astype(float), np.zeros(lm.FEATURES), np.zeros(lm.FEATURES)
    for at in range(0, len(kinds), lm.BATCH):
        r, k = rows[at : at + lm.BATCH], kinds[at : at + lm.BATCH]
        z = np.exp(w[r].sum(axis=1) + w[lm.BIAS])
        g = z / z.sum(axis=1, keepdims=True)
        g[np.arange(len(k)), k] -= 1
        for column in (*r.T, np.full(len(k), lm.BIAS)):
            step, times = np.zeros_like(w), np.bincount(column, minlength=lm.FEATURES)
            np.add.at(step, column, g)
            on = times > 0
            step[on] /= np.sqrt(times[on])[:, None]
            p += (step * step).mean(axis=1)
            w[on] -= (lm.RATE / np.sqrt(p[on] + 1e-3))[:, None] * step[on]
            u += times
    assert (uses == u).all() and np.allclose(power, p, rtol=1e-3, atol=1e-6) and np.allclose(weights, w, atol=2e-3)


@pytest.mark.parametrize("size", [1, 7, 8, 9, 700])
def test_grouped(size):
    rnd = np.random.default_rng(size)
    g, key = rnd.normal(size=(size, 4)), np.sort(rnd.integers(0, 1 + size // 5, size))
    order = rnd.permutation(size)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    assert np.allclose(lm.grouped(g, order, first), np.add.reduceat(g[order], first, axis=0))


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_far_weights(scale):
    """Sums beyond the range of float32's exponential still give probabilities."""
    rnd = np.random.default_rng(0)
    weights = rnd.normal(scale=scale, size=(lm.FEATURES, lm.CLASSES)).astype(np.float32)
    rows, kinds = rnd.integers(1, lm.FEATURES, (50, 3)), rnd.integers(0, lm.CLASSES, 50)
    z = weights[rows].sum(axis=1, dtype=float) + weights[lm.BIAS]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(lm.log_of(weights, rows, kinds), z[np.arange(50), kinds], atol=1e-3) and np.allclose(lm.softmax(weights, rows), np.exp(z), atol=1e-4)
