"""Cases that earlier versions got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from movelines.llm import embeddings, neardup, pii, quality, substrings, tokens


def brute_links(x, threshold):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        low = np.array([min(label[k], label[link[k]].min(initial=len(x))) for k in range(len(x))])
        if (low == label).all():
            return link.sum(axis=1), label
        label = low


@pytest.mark.parametrize("tile", [64, 1024])
@pytest.mark.parametrize("dims", [256, 1100])
def test_links_with_uneven_errors(spark, tile, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    x = np.repeat(base, 10, axis=0) + rng.normal(size=(600, dims)) * rng.uniform(0.2, 0.36, size=(600, 1))
    x[::97, 0] += 60  # large components: rough codes
    # pairs close to the threshold on either side
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, label = brute_links(x, 0.9)
    got = {r["vec_id"]: r for r in embeddings.embedding_dedup(d, threshold=0.9, block_rows=150, tile=tile).collect()}
    assert links.sum() > 500
    assert [got[k]["n_links"] for k in range(len(x))] == links.tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == label.tolist()


def test_bounds_do_not_depend_on_the_tile():
    rng = np.random.default_rng(1)
    for dims in (64, 3000):
        x = rng.normal(size=(200, dims)) + rng.normal(size=(1, dims))
        x[::17, 0] *= 50
        codes = embeddings.Codes(*embeddings.quantise(x / np.linalg.norm(x, axis=1)[:, None]))
        kinds = []
        for rows, tile in ((np.arange(200), 1024), (np.arange(200), 32), (np.arange(0, 200, 3), 1024)):
            kind = np.zeros((200, 200), int)
            for ra, rb, certain, maybe in embeddings.tile_bounds(codes[rows], codes[rows], 0.5, tile):
                kind[np.ix_(rows[ra], rows[rb])] = certain + 2 * maybe
            kinds.append(kind)
        assert (kinds[0] == kinds[1]).all()
        some = np.ix_(np.arange(0, 200, 3), np.arange(0, 200, 3))
        assert (kinds[0][some] == kinds[2][some]).all()


def test_words_that_a_polynomial_confuses_stay_apart(spark):
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, thue), (2, other), (3, thue)], "doc_id long, text string")
    got = {r["row"]: r["component"] for r in neardup.near_components(d, "doc_id").collect()}
    assert got[1] == got[3] != got[2]


def test_many_rows_of_one_labelled_id_send_one(spark, monkeypatch):
    texts = [(7, f"word{k % 50} text") for k in range(3000)] + [(k, f"good text number {k}") for k in range(100, 160)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 0)] + [(k, k % 2) for k in range(100, 160)], "doc_id long, quality int")
    seen = []
    real = quality.fit_embeddings
    monkeypatch.setattr(quality, "fit_embeddings", lambda bags, *a, **k: seen.append(len(bags)) or real(bags, *a, **k))
    one, two = (quality.train(docs, labels, per_class=20, buckets=1 << 10, steps=50) for _ in range(2))
    assert seen[0] == seen[1] <= 40
    assert (one.table == two.table).all()


def test_rows_without_an_id_are_dealt_over_tasks(spark):
    import public_tokenizers

    rows = [(None if k % 3 == 0 else k, f"text {k % 40}" if k % 3 == 0 else f"other {k}") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from movelines.sources.scratch import scratch_dir

    path, model = scratch_dir(spark), public_tokenizers.path("byte_bpe_50k.json")
    tokens.write_tokens(d, path, model, range_bytes=4096)
    per_part = {}
    for r in spark.read.parquet(path).collect():
        null = np.frombuffer(r["null_ids"], np.uint8)
        per_part[r["part"]] = per_part.get(r["part"], 0) + int(null.sum())
    assert sum(per_part.values()) == 1000 and max(per_part.values()) < 500
    got = tokens.read_tokens(spark, path).collect()
    assert len(got) == 3000
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[:1000] == [None] * 1000 and order[1000:] == sorted(order[1000:])


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("social security 219-09-9999 on file", {"ssn"}),
        ("my ssn: 219-09-9999", {"ssn"}),
        ("part 219-09-9999 of a list", set()),
        ("code 000-12-3456 ssn", set()),
        ("visa card 4222222222222", {"card13"}),
        ("number 4222222222222 of things", set()),
        ("visa card 4222222222223", set()),
    ],
)
def test_added_kinds(spark, text, kinds):
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["pii"]
    assert {s["kind"] for s in got} == kinds


def repeats_by_hand(texts, length):
    """Runs of windows whose first holder and place go on together."""
    words = {d: t.split() for d, t in texts}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][k : k + length]), (d, k))
    out = {}
    for d, w in words.items():
        runs = []
        for k in range(len(w) - length + 1):
            s, p = first[tuple(w[k : k + length])]
            if s < d:
                if runs and runs[-1][1] == k + length - 1 and runs[-1][2] == s and runs[-1][3] + k - runs[-1][0] == p:
                    runs[-1][1] += 1
                else:
                    runs.append([k, k + length, s, p])
        out[d] = [tuple(r) for r in runs]
    return out


def test_repeats_have_one_source_each(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 13), ("b", 13), ("c", 40)))
    texts = [(1, a), (2, f"x {b}"), (3, f"{a} {b}"), (4, f"{c}"), (5, f"y {c} z"), (6, f"{a} {c} {c}")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for options in ({}, {"chunk_bytes": 200, "range_keys": 4}):
        got = {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in substrings.substring_dedup(d, **options).collect()}
        assert got == repeats_by_hand(texts, 13)
    assert got[3] == [(0, 13, 1, 0), (13, 26, 2, 1)] and got[5] == [(1, 41, 4, 0)] and got[6] == [(0, 13, 1, 0), (13, 53, 4, 0), (53, 93, 4, 0)]


def test_repeats_of_random_texts(spark):
    import random

    rnd = random.Random(6)
    passages = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 30))) for _ in range(12)]
    texts = [(k, " ".join(rnd.choice(passages) for _ in range(rnd.randint(1, 6)))) for k in range(80)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in substrings.substring_dedup(d, length=5, seed=2, chunk_bytes=500, range_keys=16).collect()}
    assert got == repeats_by_hand(texts, 5) and sum(map(len, got.values())) > 100
