"""The features and scores of the quality classifier against a plain version."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from movelines.llm import quality
from movelines.llm.common import mix, span_hashes, utf8

BUCKETS = 1 << 17
M = 1 << 32


def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def bag(text):
    """Buckets of words, pairs of neighbours and n-grams inside words, counted one by one."""
    out, words = Counter(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    top = lambda h: int(h >> np.uint64(64 - 17))
    hashes = [word_hash(w) for w in words]
    out.update(map(top, hashes))
    out.update(top(mix(np.array([a ^ b]))[0]) for a, b in zip(hashes, hashes[1:]))
    for w in words:
        padded = f" {w} "
        for n in quality.GRAMS:
            for k in range(len(padded) - n + 1):
                h = 0
                for c in padded[k : k + n]:
                    h = (h * 0x01000193 + ord(c)) % M
                out[((h ^ (h >> 15)) * 0x9E3779B1 % M) >> (32 - 17)] += 1
    return out


TEXTS = st.lists(st.none() | st.lists(st.sampled_from(["a", "bcd", "größe", "的文", "\U0001f600", " ", "\n", "\t ", "x" * 9, "b b b"]), max_size=9).map("".join), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_features(texts):
    buf, offsets = utf8(pa.array(texts, pa.string()))
    got = [Counter() for _ in texts]
    for ids, a, b in quality.features(buf, offsets, BUCKETS):
        for k in range(len(texts)):
            got[k].update(ids[a[k] : b[k]].tolist())
    assert got == [bag(t) for t in texts]


def test_scores_are_the_softmax_of_averages():
    good, bad = ["a fine day in the old town", "the old town has a fine bridge"], ["zz qq zz qq", "qq zz $$ qq"]
    bags = []
    for t in good + bad:
        n = bag(t)
        bags.append((np.array(list(n)), np.array(list(n.values())) / sum(n.values())))
    y = np.array([1, 1, 0, 0])
    model = quality.fit_embeddings(bags, y, np.ones(4), BUCKETS, steps=400)
    texts = [*good, *bad, "a fine town", "", None]
    for t, s in zip(texts, model.scores(pa.array(texts))):
        n = bag(t)
        mean = sum(model.table[k] / (1 << 20) * v for k, v in n.items()) / max(1, sum(n.values()))
        two = np.exp([0.0, mean + model.bias])
        assert abs(s - two[1] / two.sum()) < 1e-6
    s = model.scores(pa.array(texts))
    assert s[:2].min() > 0.9 and s[2:4].max() < 0.1


def test_the_learned_table_is_the_vectors_times_the_output():
    """One step by hand: a single text of label 1 moves its buckets only."""
    ids, share = np.array([3, 5]), np.array([0.25, 0.75])
    model = quality.fit_embeddings([(ids, share)], np.array([1]), np.ones(1), 1 << 4, dims=4, epochs=1, steps=1, rate=1.0, seed=9)
    rng = np.random.default_rng(9)
    v, out, bias = rng.uniform(-1 / 4, 1 / 4, (16, 4)), np.zeros((4, 2)), np.zeros(2)
    out[:, 1] = rng.uniform(-1 / 4, 1 / 4, 4)
    mean = share @ v[ids]
    p = np.exp(mean @ out + bias)
    p /= p.sum()
    grad = p - np.array([0.0, 1.0])
    back = out @ grad
    new_out, new_bias = out - 0.05 * np.outer(mean, grad), bias - 0.05 * grad
    v[ids] -= share[:, None] * back
    want = np.rint(v @ (new_out[:, 1] - new_out[:, 0]) * (1 << 20))
    assert np.array_equal(model.table, want.astype(np.int64)) and np.isclose(model.bias, new_bias[1] - new_bias[0])
