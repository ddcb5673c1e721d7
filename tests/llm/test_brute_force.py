"""Each query of the corpus operators against a plain version of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_language(spark, docs):
    got = rows(spark, "op1_language")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""):
            assert r["lang_pred"] == "und"
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.95 * len(held)


def test_substrings(spark, docs):
    words = {d: WORD.findall(r["text"] or "") for d, r in docs.items()}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][k : k + 13]), d)
    for r in rows(spark, "op2_substrings"):
        w = words[r["doc_id"]]
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r["doc_id"]:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in table]
    x = np.asarray([r["embedding"] for r in table], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    links = [(ids[a], ids[b]) for a, b in zip(i, j)]
    n = Counter(y for pair in links for y in pair)
    want = components(ids, links)
    got = rows(spark, "op3_embeddings")
    assert len(got) == len(ids)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])


def test_rules(spark, docs):
    for r in rows(spark, "op4_rules"):
        text = docs[r["doc_id"]]["text"] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        twice = {k + o for v in at.values() if len(v) > 1 for k in v for o in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(twice) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_packing(spark, docs):
    t = library("word_bpe_49k.json")
    ids = {d: np.asarray([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for d, r in docs.items()}
    got, seen, bins = rows(spark, "op5_packing"), defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces, size in [*((seen[d], len(ids[d])) for d in docs), *((b, None) for b in bins.values())]:
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == size if size is not None else at <= 4096
    total = sum(map(len, ids.values()))
    assert len(bins) * 4096 <= total * 1.02 + 4096


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    ids = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = entry.queries()["op6_quality"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in got if r["doc_id"] in labels and r["held_out"]]
    good = [r for r in held if labels[r["doc_id"]] == 1]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)


def naive_simhash(text, shingle):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(lower)
    shingles = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    fps = {d: naive_simhash(r["text"], 3) for d, r in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(ids, links)
    got = rows(spark, "op7_simhash")
    assert len(got) == len(ids)
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])


def test_mixing(spark, docs):
    size = {d: len(WORD.findall(r["text"] or "")) for d, r in docs.items()}
    by = Counter()
    for d, r in docs.items():
        by[r["source"]] += size[d]
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target = sum(by.values()), dict.fromkeys(names, 0.0)
    free, left = set(names), float(total)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * by[s]}
        for s in over or free:
            target[s] = 3.0 * by[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    got, taken = rows(spark, "op8_mixing"), Counter()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by[s])
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "op8_mixing")))


def test_tokens(spark, docs):
    t, at, got = library("byte_bpe_50k.json"), 0, {r["doc_id"]: r for r in rows(spark, "op9_tokens")}
    assert sorted(got) == sorted(docs)
    for d in sorted(docs):
        own = np.asarray([*t.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def naive_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    out = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    return [x[2] for x in sorted(out)]


def test_pii(spark, docs):
    found = 0
    for r in rows(spark, "op10_pii"):
        want = naive_pii(docs[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(x.startswith(kind + ":") for x in want)
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        found += len(want)
    assert found


@pytest.mark.parametrize(
    "text",
    ["a@b.c", "x+a@b@c.de.fg..h", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.4", "4111 1111-1111 1111x", "+1 (555) 010-9999+44 20 7946 0958", "é@a.b é 4111111111111111 1", "@@a.b@c.d@", "a.@-.-", "+1+2+3 44 5555 6666 77", "0000000000256.1.1.1 00000001.2.3.4"],
)
def test_pii_base_spans(text):
    from movelines.llm import pii

    assert [f"{k}:{s}:{e}" for k, s, e, _ in pii.find(text) if k in pii.BASE_KINDS] == naive_pii(text)
