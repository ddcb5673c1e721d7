"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and
extra columns with clashing names, for every corpus operator and pipeline stage."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from movelines.llm import components, embeddings, langid, mixing, packing, pii, quality, rules, simhash, substrings, tokens

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use themselves
    "id string, _id string, _text string, chunk string, bucket string, group string, key string, node string, fp string, size int, score string, copy int, start int, words string, range string"
)
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and then it goes home to sleep for the night in the den", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\r\x0b\x0c ", "de", "b"),
    (None, "the row without an id has a text that nobody else has at all in this table of ours", "en", "b"),
    (None, None, None, None),
    (5, LONG, "en", "a"),
    (6, LONG + " tail", "en", None),
    (7, "same row", "fr", "c"),
    (7, "same row", "fr", "c"),
    (8, "Überraschung für die schöne grüne Wiese und den großen alten Baum im Garten der Stadt", "de", "b"),
    (9, "123 456 !!! ???", None, "c"),
    (10, "x" * 50_000, "en", "c"),
    (11, "﻿​\U0001f600 \u0085   a b <|endoftext|> \x00 \x1c\x1d y", "es", "c"),
]
NO_ROWS: list = []


def frame(spark, texts):
    return spark.createDataFrame([(d, t, g, s, len(t or ""), *["?"] * 9, 1, "?", 1, 1, "?", "?") for d, t, g, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, NO_ROWS)


WORDS_JSON, BYTES_JSON = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS_JSON, BYTES_JSON)}
LIBRARY_AS_TEXT = {p: Tokenizer.from_file(p) for p in (WORDS_JSON, BYTES_JSON)}
for t in LIBRARY_AS_TEXT.values():
    t.encode_special_tokens = True


def labelled(df):
    from pyspark.sql import functions as F

    return df.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 0).when(F.col("doc_id") < 11, 1))


OPERATORS = {
    "language": lambda d: langid.predict_language(d, langid.train(d)),
    "substrings": lambda d: substrings.substring_dedup(d),
    "rules": lambda d: rules.quality_rules(d),
    "quality": lambda d: quality.score_quality(d, quality.train(d, labelled(d), steps=300)),
    "simhash": lambda d: simhash.simhash_dedup(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "tokens": lambda d: tokens.round_trip(d, BYTES_JSON),
    "pii": lambda d: pii.find_pii(d, with_text=True),
    "packing": lambda d: packing.pack_documents(d, WORDS_JSON),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, odd, empty):
    assert OPERATORS[name](empty).collect() == []
    got = OPERATORS[name](odd).collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    if name == "packing":  # long documents come in pieces
        assert set(ids) == {str(x[0]) for x in TEXTS}
    else:
        assert ids == sorted(str(x[0]) for x in TEXTS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_defined_results(odd):
    got = by_id(OPERATORS["language"](odd))
    assert [got[k]["lang_pred"] for k in (2, 3, 4, 9)] == ["und"] * 4 and got[8]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(odd):
    model = langid.train(odd.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.predict_language(odd, model).collect()} == {"und"}


def test_substrings_defined_results(odd):
    got = by_id(substrings.substring_dedup(odd))
    assert got[2]["n_words"] == got[3]["n_words"] == got[4]["n_words"] == 0
    assert got[5]["n_removed"] == 0  # it repeats itself, and only other documents count
    assert (got[6]["n_removed"], got[6]["kept_text"]) == (60_000, "tail")
    assert got[7]["n_removed"] == 0 and got[None]["n_removed"] == 0
    assert got[6]["repeats"][0]["start"] == 0 and got[6]["repeats"][-1]["end"] == 60_000 and got[1]["repeats"] == []


def test_substrings_tell_similar_words_apart(spark):
    morse = ["a"]
    for _ in range(10):  # the word that defeats polynomial hashes modulo a power of two
        morse = [x + x.translate(str.maketrans("ab", "ba")) for x in morse]
    words = [f"w{k}" for k in range(12)]
    one, two = " ".join([*words, morse[0]]), " ".join([*words, morse[0].translate(str.maketrans("ab", "ba"))])
    nul = " ".join([*words, "x"]), " ".join([*words, "x\x00"])
    got = by_id(substrings.substring_dedup(frame(spark, [(k, t, None, None) for k, t in enumerate([one, two, *nul, "new " + one + " end"])])))
    assert [got[k]["n_removed"] for k in range(5)] == [0, 0, 0, 0, 13]
    assert [tuple(r)[:2] for r in got[4]["repeats"]] == [(1, 14)] and got[4]["kept_text"] == "new end"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=3), st.integers(1, 17))
def test_runs_are_equal_for_equal_values_only(values, length):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    seen = {}
    for v in values:
        if len(v) >= length:
            for k, x in enumerate(substrings.runs(h[np.asarray(v)], length).tolist()):
                assert seen.setdefault(x, v[k : k + length]) == v[k : k + length]
    assert len(set(map(tuple, seen.values()))) == len(seen)


def test_simhash_defined_results(odd):
    rows = simhash.simhash_dedup(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["fp"] == got[4]["fp"] == got[2]["fp"] == 0
    assert got[3]["component_id"] == got[4]["component_id"] == 2
    assert got[6]["component_id"] == 5 and not got[6]["kept"]
    assert sum(r["kept"] for r in rows if r["doc_id"] == 7) == 2  # repeated rows are one class


def test_quality_with_one_label_or_none(odd):
    q = labelled(odd)
    assert {r["score"] > 0.9 for r in quality.score_quality(odd, quality.train(odd, q.filter("quality = 1"))).collect()} == {True}
    assert {r["score"] for r in quality.score_quality(odd, quality.train(odd, q.filter("quality > 1"))).collect()} == {0.5}


def test_rules_defined_results(odd):
    got = by_id(rules.quality_rules(odd))
    assert all(got[k]["base_failed"] and not got[k]["kept"] for k in (2, 3, 4, 7, 9))
    assert got[1]["kept"] and got[5]["n_words"] == 60_000


def test_mixing_defined_results(odd):
    got = mixing.mix_sources(odd).collect()
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert all(r["taken"] == r["whole"] * r["size"] + r["part"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 4))


def words_by_source(df):
    return {r[0]: r[1] for r in df.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").sum("n").collect()}


def taken_by_source(df):
    return {r[0]: r[1] for r in df.groupBy("source").sum("taken").collect() if r[1]}


def test_mixing_takes_words(spark):
    d = frame(spark, [(k, " ".join(["w"] * (k % 7 + 1)), "en", f"s{k % 4}") for k in range(200)])
    assert words_by_source(mixing.mixed_documents(d)) == taken_by_source(mixing.mix_sources(d))


def test_mixing_of_repeated_rows_and_null_ids(spark):
    same = [(1, " ".join(["w"] * 10), "en", "A")] * 40 + [(1, "other text of one id", "en", "A")] * 3
    nulls = [(None, " ".join(["v"] * 10), "en", "B")] * 50 + [(None, f"text {k}", "de", "B") for k in range(50)]
    d = frame(spark, [*same, *nulls, *[(k, " ".join(["u"] * (k % 5 + 1)), "en", "C") for k in range(2, 400)], (900, "x y", "en", None)])
    rows = mixing.mix_sources(d).collect()
    assert len(rows) == d.count()
    taken, made = taken_by_source(mixing.mix_sources(d)), words_by_source(mixing.mixed_documents(d))
    assert made == taken
    target = {r["source"]: r["target"] for r in rows}
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_water_filling(spark):
    sizes = {"a": 10, "b": 1, "c": 100, "d": 2, "e": 0}
    s = spark.createDataFrame([(k, n, float(w)) for (k, n), w in zip(sizes.items(), (1, 2, 3, 4, 5))], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["b"] == 3 and got["d"] == 6 and got["e"] == 0
    assert got["a"] == pytest.approx(104 / 4) and got["c"] == pytest.approx(104 * 3 / 4)
    low = {r["source"]: r["target"] for r in mixing.targets(s, 0.5).collect()}
    assert low == {k: 0.5 * n for k, n in sizes.items()}
    assert mixing.targets(s.limit(0)).collect() == []


def test_places_of_many_sources(spark):
    names = [None, *sorted(f"s{k}" for k in range(700)), ""]
    got = mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string")).collect()
    assert sorted((r["place"], r["source"]) for r in got)[:-1] == [(k, n) for k, n in enumerate(sorted(x for x in names if x is not None))]
    assert max(got, key=lambda r: r["place"])["source"] is None and len(got) == 702


def test_pii_defined_results(spark):
    d = frame(spark, [(1, "pay to IBAN DE89 3704 0044 0532 0130 00 NOW, call tel. 030 1234 5678", None, None), (2, "code GB00 1234 and 030 1234 5678", None, None), (3, None, None, None), (4, "7536784127813050 4845168114407329 x", None, None)])
    got = by_id(pii.find_pii(d, with_text=True))
    assert [s["kind"] for s in got[1]["pii"]] == ["iban", "local_phone"] and got[2]["pii"] == []
    assert [(s["kind"], s["start"], s["end"]) for s in got[4]["pii"]] == [("card_group", 0, 16), ("card_group", 17, 33)]
    assert got[1]["redacted"] == "pay to IBAN [IBAN] NOW, call tel. [LOCAL_PHONE]" and got[3]["redacted"] is None


def test_embeddings_defined_results(spark):
    v = [0.6, 0.8, 0.0]
    nan, inf = float("nan"), float("inf")
    table = [(1, v), (2, v), (2, v), (None, v), (3, [1.2, 1.6, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, -0.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, None, 0.0]), (10, [0.6, 0.8]), (None, None), (11, [1e-300, 1e-300, 0.0]), (12, [1e300, 1e300, 0.0])]
    d = spark.createDataFrame([(*r, 0, "?") for r in table], "vec_id long, embedding array<double>, links int, node string")
    rows = embeddings.embedding_dedup(d).collect()
    got = {r["vec_id"]: r for r in rows}
    assert (got[1]["n_links"], got[1]["component_id"], got[1]["kept"]) == (4 + 2, 1, True)
    assert got[3]["component_id"] == 1 and got[11]["component_id"] == 1 and not got[12]["kept"]
    for k in (4, 5, 6, 7, 8, 9, 10):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert len(rows) == len(table) and sum(r["vec_id"] is None and r["component_id"] is None for r in rows) == 1
    assert embeddings.embedding_dedup(d.limit(0)).collect() == []


def test_embedding_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 48))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.2, 0.23, 0.25, 0.5)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set(zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1))))
    codes = embeddings.Codes(*embeddings.quantise(embeddings._unit(x)))
    sure, got = set(), set()
    for ra, rb, certain, maybe in embeddings.tile_bounds(codes, codes, 0.95, tile=64, same=True):
        sure |= {(i + ra.start, j + rb.start) for i, j in zip(*np.nonzero(certain))}
        i, j = np.nonzero(maybe)
        got |= {(a, b) for p, q in embeddings.exact_links(u, u, i + ra.start, j + rb.start, 0.95) for a, b in zip(p, q)}
    assert sure <= want and sure and got and not sure & got
    got |= sure
    assert got == want and want


def test_several_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base + rng.normal(scale=0.1, size=base.shape)])
    d = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, embeddings.embedding_dedup(d, block_rows=n).collect())) for n in (6144, 17))
    assert one == many and sum(r[1] for r in one)


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_by_key_splits(spark, limit):
    rng = np.random.default_rng(4)
    fps = {0, (1 << 64) - 1}
    for c in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        fps |= {c ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(e)) for a, b, e in rng.integers(0, 64, (60, 3))} | {c}
    fps = sorted(fps)
    d = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = components.connected_components(simhash.link(d, 2, limit), "a", "b").collect()
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 2 and root(a) != root(b):
                parent[root(b)] = root(a)
    want, got = {}, {}
    for x in fps:
        want.setdefault(root(x), set()).add(x)
    for r in found:
        got.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (None, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in range(7, 60)}}


PIECES = ["a", "B", " ", "  ", "\n", "\t", "\u00e9", "e\u0301", "'s", "don't", "1", "23", "!!", ",", "\u00a0", "\x1c", "\u2003", "的", "<|endoftext|>", "<|startoftext|>", "<|endof", "İ", "ß", "-", "\r\n", " \n "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6), st.booleans())
def test_encoder_is_the_library(texts, as_text):
    for path in (WORDS_JSON, BYTES_JSON):
        t = (LIBRARY_AS_TEXT if as_text else LIBRARY)[path]
        ids, offsets = tokens.encoder(path, as_text).encode(pa.array(texts, pa.string()), 7)
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in texts]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
        ids, offsets = tokens.encoder(path, as_text).encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [w[:-1] for w in want]


def test_encoder_forgets_and_relearns():
    own = tokens.Encoder(WORDS_JSON, memory=3)
    for round in range(3):
        texts = [f"word{k} of {round}, and x{'y' * 300}" for k in range(9)]
        ids, offsets = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [LIBRARY[WORDS_JSON].encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60), max_size=8), st.integers(1, 40), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_segments_round_trip(documents, block, share):
    whole = np.asarray([x for d in documents for x in d], "<u4")
    offsets = np.cumsum([0, *map(len, documents)])
    raw = tokens.encode_segment(whole, offsets, block, share)
    ids, at = tokens.decode_segment(raw)
    assert ids.tolist() == whole.tolist() and at.tolist() == offsets.tolist()
    for k in range(-(-len(whole) // block)):
        assert tokens.read_block(raw, k).tolist() == whole[k * block : (k + 1) * block].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30))
def test_packing_covers_every_token(lengths):
    bins = packing.pack(lengths, 16)
    seen = sorted((d, s + k) for b in bins for d, s, n in b for k in range(n))
    assert seen == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
    assert all(0 < sum(n for _, _, n in b) <= 16 for b in bins) and len(bins) == -(-sum(lengths) // 16)


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300).tolist()
    free, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
        free += [100] * (b == len(free))
        free[b] -= sizes[k]
        want[k] = b
    assert packing.first_fit_decreasing(sizes, 100) == [want[k] for k in range(len(sizes))]


def test_js_distance(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    d = lambda p, q: one.select(rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert d([1.0, 0.0], [0.0, 3.0]) == pytest.approx(1) and d([1.0, 2.0], [2.0, 4.0]) == pytest.approx(0)
    p, q = np.array([0.25, 0.75]), np.array([0.5, 0.5])
    m = (p + q) / 2
    assert d([1.0, 3.0], [1.0, 1.0]) == pytest.approx(np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2))
    assert d([0.0, 0.0], [1.0, 1.0]) == 1.0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, odd, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    folder = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        got = stage(spark, docs, folder)
        if k < 4:
            assert got.columns == docs.columns
        rows = got.collect()
        assert (len(rows) == 0) == (docs is empty)
    if name.startswith("simhash"):
        ids = [r["doc_id"] for r in stage(spark, odd, folder).collect()]
        assert len(ids) == len(set(ids)) and 6 not in ids and {1, 5, 7, 8} <= set(ids)


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 < r["length"] <= 4096 for r in rows)
