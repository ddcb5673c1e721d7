"""Prefix trie of rebuilt conversations: double arrays in shards of bounded size, merged globally.

Turns are numbered in sorted runs that no conversation has to fit in: a range exchange deals rows
by conversation and order, each task numbers its own, and where a conversation goes on from one
task to the next the counts so far are added (one row a task comes to the driver). The same pass
gives every turn its prefix: a polynomial of the turns' SHA-256 up to it, modulo 2**127 - 1, which
can be carried from task to task too.

Conversations are cut into blocks of a fixed number of turns. Equal blocks after equal prefixes
become one row. A shard holds the blocks that share a prefix of a few turns; a prefix with more
than shard_rows of them is dealt over several shards, small ones share one. A shard numbers its
turns densely, packs its trie into BASE and CHECK arrays, and traverses them for its nodes. Nodes
that several shards met are summed by prefix.

Sums over subtrees need no second walk: each node belongs to its smallest member, so a member owns
the end of its path; what it owns is a constant of the conversation, and a node's subtree is the
sum of its members' constants, corrected for the node's own smallest member.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, session_ready

PRIME = (1 << 127) - 1
FACTOR = 0x1F83D9ABFB41BD6B5BE0CD19137E2179 % PRIME  # any fixed number does
ROOT = bytes(16)


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart: the length of the role keeps role and text from mixing."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def _int(key: bytes) -> int:
    return int.from_bytes(key, "big")


def extend(path: int, key: bytes) -> int:
    return (path * FACTOR + _int(key) + 1) % PRIME


# ---- numbering -------------------------------------------------------------------------

_RUN = "conv long, place long, key binary, bytes long, path binary, before long, part int"


def _runs(batches):
    """Numbers the rows of each conversation in a sorted task, from 1; path and bytes so far too."""
    from pyspark import TaskContext

    part, last, place, path, total = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        convs, keys, sizes = (batch.column(c).to_pylist() for c in ("conv", "key", "bytes"))
        places, paths, before = [], [], []
        for c, k, b in zip(convs, keys, sizes):
            if c != last:
                last, place, path, total = c, 0, 0, 0
            place, path = place + 1, extend(path, k)
            places.append(place)
            paths.append(path.to_bytes(16, "big"))
            before.append(total)
            total += b
        columns = [batch.column("conv"), pa.array(places, pa.int64()), batch.column("key"), batch.column("bytes"), pa.array(paths, pa.binary()), pa.array(before, pa.int64()), pa.array([part] * len(places), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "place", "key", "bytes", "path", "before", "part"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """(conv, place, key, bytes, path, before): rows (conv, key, bytes and the columns of `order`)
    of each conversation numbered from 1 in that order, ties by key; path of the conversation up to
    the row, and the bytes before it."""
    spark = session_ready(rows.sparkSession)
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", *order, "key").sortWithinPartitions("conv", *order, "key")
    runs = materialise(ranged.select("conv", "key", "bytes").mapInArrow(_runs, _RUN))
    last = F.max(F.struct("conv", "place", "path", (F.col("before") + F.col("bytes")).alias("total"))).alias("last")
    ends = runs.groupBy("part").agg(F.min("conv").alias("first"), last).collect()  # one row for each task
    carried, conv, place, path, total = {}, None, 0, 0, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        if r["first"] == conv:
            carried[r["part"]] = (conv, place, path, total)
        own = r["last"]
        if own["conv"] != conv:
            conv, place, path, total = own["conv"], 0, 0, 0
        path = (path * pow(FACTOR, own["place"], PRIME) + _int(own["path"])) % PRIME
        place, total = place + own["place"], total + own["total"]
    if not carried:
        return runs.drop("part")

    def carry(batches):
        for batch in batches:
            part, convs = batch.column("part").to_pylist(), batch.column("conv").to_pylist()
            places, paths, before = (batch.column(c).to_pylist() for c in ("place", "path", "before"))
            for k, (p, c) in enumerate(zip(part, convs)):
                if p in carried and carried[p][0] == c:
                    _, place, path, total = carried[p]
                    paths[k] = ((path * pow(FACTOR, places[k], PRIME) + _int(paths[k])) % PRIME).to_bytes(16, "big")
                    places[k] += place
                    before[k] += total
            columns = [batch.column("conv"), pa.array(places, pa.int64()), batch.column("key"), batch.column("bytes"), pa.array(paths, pa.binary()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "place", "key", "bytes", "path", "before"])

    return materialise(runs.mapInArrow(carry, "conv long, place long, key binary, bytes long, path binary, before long"))


def rebuilt(turns: DataFrame, ids: DataFrame, own: Column, span: int = 5) -> DataFrame:
    """(conv, key, bytes, tail, place): the first `own` turns of conversation conv - conv % span
    (tail 0), then conv's own from there on (tail 1). own: at most 8, from the column conv."""
    heads = turns.filter((F.col("conv") % span == 0) & (F.col("place") <= 8)).select(F.col("conv").alias("base"), "place", "key", "bytes")
    wanted = ids.select("conv", (F.col("conv") - F.col("conv") % span).alias("base"), own.alias("own")).filter("own > 0")
    first = wanted.join(heads, "base").filter("place <= own").select("conv", "key", "bytes", F.lit(0).alias("tail"), "place")
    return first.union(turns.filter(F.col("place") > own).select("conv", "key", "bytes", F.lit(1), "place"))


# ---- double arrays ---------------------------------------------------------------------


class DoubleArray:
    """A trie over sequences of symbols 1..n, packed into two arrays: the child of state s by symbol
    c is base[s] + c, and check there says s. State 1 is the root; 0 is no state."""

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check = [0, 0], [1, 1]
        self._next = [2, 2]  # leads to the first free place from here on
        rows = sorted(sequences)
        pending = [(1, 0, len(rows), 0)]  # state, the rows below it, its depth
        while pending:
            state, a, b, depth = pending.pop()
            while a < b and len(rows[a]) == depth:  # sequences that end here sort first
                a += 1
            groups = []
            while a < b:
                e, c = a, rows[a][depth]
                while e < b and rows[e][depth] == c:
                    e += 1
                groups.append((c, a, e))
                a = e
            if groups:
                base = self.base[state] = self._fit([g[0] for g in groups])
                for c, s, e in groups:
                    self.check[base + c], self._next[base + c] = state, base + c + 1
                    pending.append((base + c, s, e, depth + 1))

    def _grow(self, size: int) -> None:
        if (n := len(self.check)) < size:
            size = max(size, n + n // 2)
            self.base += [0] * (size - n)
            self.check += [0] * (size - n)
            self._next += range(n, size)

    def _free(self, place: int) -> int:
        self._grow(place + 1)
        while (after := self._next[place]) != place:
            self._grow(after + 1)
            self._next[place] = self._next[after]  # halves the way of the next who comes
            place = self._next[place]
            self._grow(place + 1)
        return place

    def _fit(self, symbols: list[int]) -> int:
        """The least base under which the places of all symbols (in order) are free."""
        low, high = symbols[0], symbols[-1]
        place = self._free(low + 1)
        while True:
            base = place - low
            self._grow(base + high + 1)
            if not any(self.check[base + c] for c in symbols):
                return base
            place = self._free(place + 1)

    def child(self, state: int, symbol: int) -> int:
        """The state that a symbol leads to, 0 if none."""
        at = self.base[state] + symbol
        return at if self.base[state] and 0 < at < len(self.check) and self.check[at] == state else 0

    def walk(self, sequence: list[int]) -> list[int]:
        """The states along a sequence, the root's first, as far as it goes."""
        states = [1]
        for c in sequence:
            if not (s := self.child(states[-1], c)):
                break
            states.append(s)
        return states

    def states(self):
        """All states but the root, each after its parent's place was given."""
        return (s for s, parent in enumerate(self.check) if parent and s > 1)


_NODES = "path binary, parent binary, depth long, bytes long, before long, n long, least long, total decimal(38,0)"
_SUMS = "path binary, owned decimal(38,0), leaves long"


def _shard(table: pa.Table):
    """The double array of a shard, and the states along each row's block."""
    rows = table.to_pylist()
    number: dict[bytes, int] = {}
    dense = lambda key: number.setdefault(key, len(number) + 1)
    # the prefix before a block is its first symbol
    sequences = [[dense(b"p" + r["start"]), *(dense(b"t" + t["key"]) for t in r["turns"])] for r in rows]
    trie = DoubleArray(sequences)
    paths: dict[int, tuple] = {}  # state: path, parent's path, depth, bytes, bytes before
    along = []
    for r, sequence in zip(rows, sequences):
        states = trie.walk(sequence)[2:]
        path, before = _int(r["start"]), r["before"]
        for k, (s, t) in enumerate(zip(states, r["turns"])):
            if s not in paths:
                paths[s] = (extend(path, t["key"]), path, r["block"] + k + 1, t["bytes"], before)
            path, before = paths[s][0], before + t["bytes"]
        along.append(states)
    return trie, rows, paths, along


def _found(table: pa.Table) -> pa.Table:
    trie, rows, paths, along = _shard(table)
    n, total, least = dict.fromkeys(paths, 0), dict.fromkeys(paths, 0), {}
    for r, states in zip(rows, along):
        for s in states:
            n[s] += r["n"]
            total[s] += int(r["total"])
            least[s] = min(least.get(s, r["least"]), r["least"])
    own = [s for s in trie.states() if s in paths]
    info = [paths[s] for s in own]
    raw = lambda k: pa.array([i[k].to_bytes(16, "big") for i in info], pa.binary())
    columns = [raw(0), raw(1), *(pa.array([i[k] for i in info], pa.int64()) for k in (2, 3, 4)), *(pa.array([x[s] for s in own], pa.int64()) for x in (n, least)), _decimals([total[s] for s in own])]
    return pa.table(columns, ["path", "parent", "depth", "bytes", "before", "n", "least", "total"])


def _decimals(values: list[int]) -> pa.Array:
    return pa.array(map(Decimal, values), pa.decimal128(38, 0))


def _summed(table: pa.Table) -> pa.Table:
    _, rows, paths, along = _shard(table)
    owned, leaves = dict.fromkeys(paths, 0), dict.fromkeys(paths, 0)
    for r, states in zip(rows, along):
        for s in states:
            owned[s] += int(r["owned"])
            leaves[s] += r["leaves"]
    path = pa.array([i[0].to_bytes(16, "big") for i in paths.values()], pa.binary())
    return pa.table([path, _decimals(list(owned.values())), pa.array(list(leaves.values()), pa.int64())], ["path", "owned", "leaves"])


# ---- members that end at a node --------------------------------------------------------


def _joined(batches, limit: int = 1 << 16):
    """Rows (path, conv) in order: their numbers joined by commas, in pieces of bounded size."""
    path, first, parts, size = None, None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for p, c in zip(batch.column("path").to_pylist(), batch.column("conv").to_pylist()):
            if p != path or size > limit:
                if parts:
                    out.append((path, first, ",".join(parts)))
                path, first, parts, size = p, c, [], 0
            parts.append(str(c))
            size += len(parts[-1]) + 1
        yield pa.RecordBatch.from_pydict(dict(zip(("path", "first", "text"), map(list, zip(*out)) if out else ([], [], []))), pa.schema([("path", pa.binary()), ("first", pa.int64()), ("text", pa.string())]))
        out = []
    if parts:
        yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "text": [",".join(parts)]}, pa.schema([("path", pa.binary()), ("first", pa.int64()), ("text", pa.string())]))


def _hashed(batches):
    """The SHA-256 of each path's pieces, which come in order, joined by commas."""
    path, digest = None, None
    schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for p, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            if p != path:
                if digest:
                    out.append((path, digest.hexdigest()))
                path, digest = p, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pa.RecordBatch.from_pydict(dict(zip(("path", "ends_sha256"), map(list, zip(*out)) if out else ([], []))), schema)
    if digest:
        yield pa.RecordBatch.from_pydict({"path": [path], "ends_sha256": [digest.hexdigest()]}, schema)


def end_hashes(members: DataFrame) -> DataFrame:
    """(path, ends_sha256) of (path, conv): members in ascending order, joined by commas. The
    numbers of one node may lie in many tasks; only their text passes through one, in pieces."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.repartitionByRange(tasks, "path", "conv").sortWithinPartitions("path", "conv").mapInArrow(_joined, "path binary, first long, text string")
    return pieces.repartition(tasks, "path").sortWithinPartitions("path", "first").mapInArrow(_hashed, "path binary, ends_sha256 string")


# ---- the operator ----------------------------------------------------------------------


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = 5, block: int = 32, prefix: int = 2, shard_rows: int = 5_000
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is the first h = crc32(c) % 9 turns of conversation c - c % span, then its own
    after the first h. Turns come in order of turn, null first, ties by a hash of role and text;
    null role or text counts as empty. Rows without a conversation id belong to none and are left
    out. Repeated rows are turns of their own. A conversation that is left without turns is a member
    of the root only. An empty table has no nodes. Other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes")).filter("conv is not null")
    turns = numbered(rows, ["turn"])
    ids = turns.filter("place = 1").select("conv")
    own = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9)).cast("int")
    walks = numbered(rebuilt(turns, ids, own, span), ["tail", "place"])

    # one row for each conversation: its last prefix, and all its bytes
    end = F.max(F.struct("place", "path", (F.col("before") + F.col("bytes")).alias("total"))).alias("e")
    lasts = walks.groupBy("conv").agg(end)
    convs = materialise(ids.join(lasts, "conv", "left").select("conv", F.coalesce("e.path", F.lit(ROOT)).alias("path"), F.coalesce("e.place", F.lit(0)).alias("turns"), F.coalesce("e.total", F.lit(0)).alias("total")))

    # blocks of turns; a block knows the prefix before it as the path of the row that ends the one before
    at = F.floor((F.col("place") - 1) / block) * block
    held = walks.groupBy("conv", at.alias("block")).agg(
        F.min("before").alias("before"),
        F.max(F.struct("place", "path"))["path"].alias("end"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "bytes"))), lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"),
    )
    starts = walks.filter(F.col("place") % block == 0).select("conv", F.col("place").alias("block"), F.col("path").alias("start"))
    held = held.join(starts, ["conv", "block"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT)))
    held = materialise(held.join(convs.select("conv", "total"), "conv"))
    # equal blocks after equal prefixes are one; the prefix at a block's end names both
    merged = held.groupBy("block", "end").agg(F.first("start").alias("start"), F.first("turns").alias("turns"), F.first("before").alias("before"), F.count("*").alias("n"), F.min("conv").alias("least"), F.sum(F.col("total").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))
    few = F.struct("start", F.slice(F.transform("turns", lambda t: t["key"]), 1, prefix))
    merged = materialise(merged.withColumn("prefix", F.xxhash64(few)))
    counts = merged.groupBy("prefix").count().filter(F.col("count") > shard_rows)
    salt = F.pmod(F.xxhash64("end"), F.coalesce(F.ceil(F.col("count") / shard_rows), F.lit(1)))
    shards = max(1, -(-merged.count() // shard_rows), int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = merged.join(counts, "prefix", "left").withColumn("shard", F.pmod(F.xxhash64("prefix", salt), F.lit(shards))).drop("prefix", "count")
    dealt = materialise(dealt)

    group = dealt.select("shard", "block", "start", "turns", "before", "n", "least", "total").groupBy("shard").applyInArrow(_found, _NODES)
    same = lambda c: F.first(c).alias(c)
    nodes = group.groupBy("path").agg(same("parent"), same("depth"), same("bytes"), same("before"), F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").cast("decimal(38,0)").alias("total"))
    nodes = materialise(nodes)
    children = materialise(nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children")))

    # what each conversation owns: the nodes that it is the smallest member of, a leaf among them or not
    leaf = nodes.join(children, "path", "left").select("least", "bytes", F.col("n_children").isNull().cast("long").alias("leaf"))
    owned = leaf.groupBy(F.col("least").alias("conv")).agg(F.sum("bytes").alias("owned"), F.sum("leaf").alias("leaves"))
    convs = materialise(convs.join(owned, "conv", "left").fillna(0, ["owned", "leaves"]))
    weights = held.select("conv", "block", "end").join(convs.select("conv", "owned", "leaves").filter("owned > 0 or leaves > 0"), "conv")
    weights = weights.groupBy("block", "end").agg(F.sum(F.col("owned").cast("decimal(38,0)")).cast("decimal(38,0)").alias("owned"), F.sum("leaves").alias("leaves"))
    weighed = dealt.select("shard", "block", "end", "start", "turns", "before").join(weights, ["block", "end"])
    sums = weighed.select("shard", "block", "start", "turns", "before", "owned", "leaves").groupBy("shard").applyInArrow(_summed, _SUMS)
    sums = sums.groupBy("path").agg(F.sum("owned").alias("owned_below"), F.sum("leaves").alias("n_leaves"))

    # the root: all conversations, with or without turns
    top = convs.agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.sum(F.col("total").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.sum(F.col("owned").cast("decimal(38,0)")).alias("owned_below"), F.sum("leaves").alias("n_leaves")).filter("n > 0")
    top = top.select(F.lit(ROOT).alias("path"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("before"), "n", "least", "total", "owned_below", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"))
    every = materialise(nodes.join(sums, "path").unionByName(top))

    # a node below one with the same smallest member needs no look-up of its parent's
    lower = every.select(F.col("path").alias("parent"), F.col("least").alias("parent_conv_id"))
    tops = every.groupBy("least").agg(F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("parent"))
    tops = tops.join(lower, "parent").select("least", "depth", "parent_conv_id")
    constants = convs.select(F.col("conv").alias("least"), F.col("total").alias("own_total"), F.col("owned").alias("own_owned"))
    out = every.join(children, "path", "left").join(constants, "least").join(tops, ["least", "depth"], "left").join(end_hashes(convs.select("path", "conv")), "path", "left")
    all_bytes = F.col("total") - F.col("n") * F.col("before")
    once = F.col("owned_below") - F.col("own_owned") + F.col("own_total") - F.col("before")
    return out.select(
        F.col("least").alias(conv_col),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "least")).alias(f"parent_{conv_col}"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        (all_bytes - once).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
