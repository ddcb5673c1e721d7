"""The conversation trie against dictionaries, and the double array by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from movelines.llm import trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for k in children[p]:
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for p, m in members.items():
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), *below(p), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[k] for k in NAMES) for r in df.collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(entry.queries()["op12_trie"](spark, SF)) == by_hand(rows)


@pytest.mark.parametrize("options", [{}, {"block": 2, "prefix": 1, "shard_rows": 3}, {"block": 3, "shard_rows": 7}])
def test_shared_and_repeated_conversations(spark, options):
    rnd = random.Random(3)
    rows = []
    for c in range(-12, 60):
        hot = rnd.random() < 0.4  # a third and more begin alike
        n = rnd.randint(1, 12)
        for t in range(n):
            text = f"hello {t}" if hot and t < 9 else rnd.choice(["yes", "no", "é漢", None, ""])
            rows.append((c, t, rnd.choice(["user", "user", None]) if not hot else "user", text))
    rows += [(100, t, "user", f"long {t // 7}") for t in range(150)]  # much longer than a block
    rows += [(c, t, "user", f"hello {t}") for c in range(200, 230) for t in range(11)]  # copies
    rows += [(None, 1, "user", "nobody's"), (300, None, "user", "first"), (300, 0, "user", "then")]
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(trie.conversation_trie(d, **options)) == by_hand(rows)


def test_a_conversation_may_be_left_without_turns(spark):
    rows = [(c, 0, "user", "x") for c in (2, 3, 4)]  # no conversation 0, and fewer turns than are replaced
    assert all(zlib.crc32(str(c).encode()) % 9 for c in (2, 3, 4))
    d = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.conversation_trie(d)) == by_hand(rows) and len(by_hand(rows)) == 1
    assert trie.conversation_trie(d.limit(0)).collect() == []


def test_columns_with_clashing_names(spark):
    rows = [(c, t, "user", f"t{t}", 1, 2, "3") for c in range(6) for t in range(10)]
    d = spark.createDataFrame(rows, SCHEMA + ", conv int, place int, key string")
    assert got(trie.conversation_trie(d)) == by_hand([r[:4] for r in rows])


def test_repeated_rows_are_turns(spark):
    rows = [(5, 1, "user", "a")] * 3 + [(5, 2, "user", "b")] * 12
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_double_array():
    rnd = random.Random(2)
    sequences = [[rnd.randint(1, 40) for _ in range(rnd.randint(0, 9))] for _ in range(500)]
    t = trie.DoubleArray(sequences)
    prefixes = {tuple(s[:k]) for s in sequences for k in range(len(s) + 1)}
    states = {p: t.walk(list(p)) for p in prefixes}
    assert all(len(s) == len(p) + 1 for p, s in states.items())
    assert len({s[-1] for s in states.values()}) == len(prefixes)
    assert sorted(t.states()) == sorted({s[-1] for p, s in states.items() if p})
    for _ in range(500):  # nothing else is found
        p = [rnd.randint(1, 45) for _ in range(rnd.randint(1, 9))]
        n = max(k for k in range(len(p) + 1) if tuple(p[:k]) in prefixes)
        assert len(t.walk(p)) == n + 1
    for s, parent in enumerate(t.check):
        if parent and s > 1:
            assert t.check[parent] and t.base[parent] < s
    assert trie.DoubleArray([]).walk([1]) == [1]
