"""Near copies planted at known similarities, against all pairs."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from movelines.llm import neardup


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def planted():
    """Groups of copies of one text with some words changed, of 60 to 600 words."""
    rng = np.random.default_rng(11)
    out = []
    for group in range(60):
        n = int(rng.integers(60, 600))
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        for copy in range(40 if group == 0 else 3):
            words = list(base)
            for at in rng.integers(0, n, int(n * rng.choice([0.0, 0.01, 0.02, 0.03, 0.05]))):
                words[at] = f"x{rng.integers(0, 1 << 40)}"
            out.append(" ".join(words))
    return [*out, "", " ", "two words", "Two  WORDS", "two words more"]


def wanted(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or (len(sets[i] | sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(texts))]


def test_shingle_sets_are_sets_of_shingles():
    texts = ["a b c d e f a b c d e f", "A  b\tc D e F a b c d e f", "a b", "b a", "", None, "a b c d e"]
    got = neardup.shingle_sets(pa.array(texts), 5)
    assert [len(x) for x in got] == [len(shingles(t or "")) for t in texts]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() != got[3].tolist() and got[6][0] in got[0]


def test_near_copies_are_one_group(spark):
    texts = planted()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = defaultdict(set)
    for k, g in enumerate(wanted(texts)):
        groups[g].add(k)
    assert any(len({texts[k] for k in g}) > 1 for g in groups.values())
    found = defaultdict(set)
    for r in neardup.near_components(docs, "doc_id").collect():
        found[r["component"]].add(r["row"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
    kept = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(map(min, groups.values()))


def test_one_id_with_two_texts(spark):
    first = " ".join(f"w{k}" for k in range(100))
    near, other = first + " end", " ".join(f"v{k}" for k in range(100))
    docs = spark.createDataFrame([(1, first), (2, near), (2, other), (2, other)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, kept)) == [(1, first), (2, other)]


def test_the_stage_finds_near_copies_by_simhash(spark, monkeypatch):
    """the stage linked by MinHash alone. Now the Gray-order index proposes nearly all links, and each is decided exactly."""
    texts = planted()
    seen, found = [], neardup.near_pairs
    monkeypatch.setattr(neardup, "near_pairs", lambda sets, *a: seen.append((sets, found(sets, *a))) or seen[-1][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001").collect()
    assert corpus_pipeline.STAGES[1][0] == "simhash near-dedup" and len(seen) == 1
    prints = {r["node"]: np.array(r["prints"], np.int64).view(np.uint64) for r in seen[0][0].collect()}
    parent = {n: n for n in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in seen[0][1].collect():
        assert np.bitwise_count(prints[a] ^ prints[b]).sum() <= 58
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = len({g for g, t in zip(wanted(texts), texts) if t.strip()})
    assert len({root(n) for n in prints}) <= 1.1 * groups


def test_fingerprints_of_a_set_are_majorities():
    from movelines.llm import simhash

    hashes = np.random.default_rng(3).integers(0, 1 << 63, 9001, dtype=np.uint64)
    got = simhash.set_fingerprints(hashes)
    for seed, fp in zip(simhash._SEEDS, got.tolist()):
        bits = simhash.mix(hashes ^ seed)
        assert fp == sum(1 << k for k in range(64) if 2 * int(((bits >> np.uint64(k)) & np.uint64(1)).sum()) > len(hashes))
