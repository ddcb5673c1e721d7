"""SimHash near-dedup: fingerprints of word shingles, a Gray-order hierarchical index over
the distinct fingerprints, and the components of all links within a Hamming distance.

Distribution is exact by pigeonhole. Three fields of a fingerprint are keys; of two fingerprints
that differ in at most 2 bits one field at least agrees. The fields are as narrow as the number
of fingerprints allows (some `per_group` to a key on average, at most 21 bits), so that within a
key the index has to prune. A key that more than `group_limit` fingerprints share is split again:
the remaining bits fall into three parts, one of which must agree, and so on until at most 15
bits can differ. So no group can exceed 32,768 distinct fingerprints however the data are skewed,
and nothing is dropped.

In each group the fingerprints are sorted by Gray rank. Runs of them form the nodes of a tree:
a node holds the bits that all its members share, its parent the ones shared more widely, so a
query adds up differences on the way down, each bit once, and drops a whole subtree when the
sum passes the distance. Only a spanning forest of the links leaves the group.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialise, mix, session_ready
from .components import connected_components

_U = np.uint64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # highest bit first


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of one text: bit set where over half the shingle hashes have it set."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = len(words) - shingle + 1
    starts, ends = (end - size)[:n].tolist(), end[shingle - 1 :].tolist()
    hashes = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, map(slice, starts, ends)), repeat(42)), _U, n)
    parts = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id_col, fp) for each row; fp is the 64-bit fingerprint as a signed long."""
    session_ready(docs.sparkSession)

    def run(batches):
        for block in blocks(batches, "_text"):
            fps = np.fromiter((fingerprint(x, shingle) for x in block.column("_text").to_pylist()), _U, block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("_id"), pa.array(fps.view(np.int64))], ["_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, "_id long, fp long").withColumnRenamed("_id", id_col)


# ---- the index -------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(s))
    return x


class GrayIndex:
    """A hierarchical index over the fingerprints of many groups at once. Rows are sorted by
    group and Gray rank; a node covers up to fan**level rows of one group."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, fan: int = 8):
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.fp, self.group = order, fp[order], group[order]
        n = len(fp)
        start = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
        sizes = np.diff([*start, n])
        self.root = np.repeat(np.arange(len(start)), sizes)  # of each row: its group's number
        # bottom-up: levels[0] are the rows themselves
        zero = ~_U(0)
        self.levels = [(np.full(n, zero, _U), self.fp, np.arange(n), np.arange(1, n + 1))]
        count, first = sizes, start
        while True:
            mask, pattern, _, _ = self.levels[-1]
            inside = np.arange(len(mask)) - np.repeat(first, count)
            lead = np.flatnonzero(inside % fan == 0)
            ones = np.bitwise_and.reduceat(np.where(mask == zero, pattern, pattern & mask), lead)
            low = np.bitwise_and.reduceat(~pattern & mask, lead)  # bits that are shared zeros
            shared = ones | low
            self.levels.append((shared, ones, lead, np.concatenate((lead[1:], [len(mask)]))))
            count = -(-count // fan)
            first = np.cumsum(count) - count
            if np.all(count == 1):
                break

    def pairs(self, distance: int, frontier: int = 1 << 21):
        """Batches of (i, j) of rows in one group that differ in at most `distance` bits, i < j.
        The batches are so small that even an unpruned descent stays below `frontier` pairs."""
        n = len(self.fp)
        batch = max(1, frontier // max(1, np.bincount(self.root).max(initial=1)))
        top = len(self.levels) - 1
        for s in range(0, n, batch):
            q = np.arange(s, min(n, s + batch))
            node = self.root[q]
            mask, pattern, lo, hi = self.levels[top]
            acc = np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node]).astype(np.int64)
            for level in range(top, 0, -1):
                keep = acc <= distance
                q, node, acc = q[keep], node[keep], acc[keep]
                mask, _, lo, hi = self.levels[level]
                width = hi[node] - lo[node]
                child = np.repeat(lo[node] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                known = np.repeat(mask[node], width)
                q, acc = np.repeat(q, width), np.repeat(acc, width)
                mask, pattern, _, _ = self.levels[level - 1]
                if level == 1:
                    later = child > q
                    q, acc, child, known = q[later], acc[later], child[later], known[later]
                acc = acc + np.bitwise_count((self.fp[q] ^ pattern[child]) & (mask[child] & ~known))
                node = child
            keep = acc <= distance
            yield q[keep], node[keep]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j in place; label holds each class's smallest row."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _forest(distance: int):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(_U)
        group = np.unique(table.column("key").to_numpy(), return_inverse=True)[1]
        index = GrayIndex(group, fp)
        label = np.arange(len(fp))
        for i, j in index.pairs(distance):
            _hook(label, i, j)
        off = np.flatnonzero(label != np.arange(len(fp)))
        values = index.fp.view(np.int64)
        return pa.table({"a": values[off], "b": values[label[off]]})

    return run


def _field(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _parts(bits: list[int]) -> list[list[int]]:
    """Three nearly equal parts of the given bit positions."""
    n = len(bits)
    return [bits[round(n * k / 3) : round(n * (k + 1) / 3)] for k in range(3)]


def _value(fp, bits: list[int]):
    """The bits of fp at these positions, as one number; runs of positions move together."""
    out, place, k = F.lit(0).cast("long"), 0, 0
    while k < len(bits):
        e = k
        while e + 1 < len(bits) and bits[e + 1] == bits[e] + 1:
            e += 1
        out = out.bitwiseOR(F.shiftleft(_field(fp, bits[k], e - k + 1), place))
        place, k = place + e - k + 1, e + 1
    return out


def _keys(width: int) -> list[list[tuple[str, list[int]]]]:
    """By depth: each key's name and the bit positions that it fixes."""
    out = [[(str(k), list(range(21 * k, 21 * k + width))) for k in range(3)]]
    while 64 - min(len(bits) for _, bits in out[-1]) > 15:
        out.append([(f"{name}.{k}", bits + part) for name, bits in out[-1] for k, part in enumerate(_parts([x for x in range(64) if x not in bits]))])
    return out


def link(distinct: DataFrame, distance: int = 2, group_limit: int = 4096, per_group: int = 64, bucket_rows: int = 200_000) -> DataFrame:
    """(a, b): a spanning forest of all pairs of the column fp within `distance` (at most 2)."""
    if not 0 <= distance <= 2:
        raise ValueError("the key scheme is exact up to a distance of 2")
    session_ready(distinct.sparkSession)
    fp, edges = F.col("fp"), []
    rows, n = distinct.select("fp", F.lit("").alias("under")), distinct.count()
    keys = _keys(min(21, max(1, math.ceil(math.log2(max(2.0, n / per_group))))))
    for depth, level in enumerate(keys):
        parts = [
            F.struct(F.lit(name).alias("name"), F.xxhash64(F.lit(name), _value(fp, bits)).alias("key"), F.lit(name.rpartition(".")[0]).alias("under"))
            for name, bits in level
        ]
        spread = rows.select("fp", "under", F.explode(F.array(*parts)).alias("k")).filter(F.col("k.under") == F.col("under"))
        spread = spread.select("fp", F.col("k.name").alias("under"), F.col("k.key").alias("key"))
        counts = spread.groupBy("key").count().filter("count > 1")
        spread = spread.join(counts, "key")
        last = depth == len(keys) - 1
        small = spread if last else spread.filter(F.col("count") <= group_limit)
        # each row has three keys at a depth
        buckets = F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(max(_buckets(distinct.sparkSession), math.ceil(3 * n / bucket_rows))))
        edges.append(small.select("fp", "key", buckets.alias("bucket")).groupBy("bucket").applyInArrow(_forest(distance), "a long, b long"))
        if not last:
            rows = materialise(spread.filter(F.col("count") > group_limit).select("fp", "under"))
            n = rows.count()
            if not n:
                break
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


# ---- wider distances, by several fingerprints -------------------------------------------

#: Fingerprints of one set; the index finds pairs by each of them, all together decide.
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, 4, dtype=_U)
FIELDS = 5
#: Two sets of Jaccard similarity 0.8 differ in 9.7 of 64 bits (standard deviation 2.9), in 38.8 of 256 (5.7).
NEAR, NEAR_ALL = 16, 58


def set_fingerprints(hashes: np.ndarray, tile: int = 4096) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes under each seed."""
    ones = np.zeros(64 * len(_SEEDS), np.int64)
    for s in range(0, len(hashes), tile):
        seeded = mix(hashes[s : s + tile, None] ^ _SEEDS).astype(">u8")
        ones += np.unpackbits(seeded.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(_U)


def _nearest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Joins the classes of i and j in place, as _hook does, and returns which pairs did it: a forest
    that takes earlier pairs first."""
    used, at = [], np.arange(len(i))
    while len(at):
        a, b = label[i[at]], label[j[at]]
        differ = a != b
        at, a, b = at[differ], a[differ], b[differ]
        if not len(at):
            break
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used.append(at[first])
        label[high] = np.minimum(a, b)[first]
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
    return used


def _near_forest(group_limit: int):
    def run(table: pa.Table) -> pa.Table:
        key, node, which = (table.column(c).to_numpy() for c in ("key", "node", "which"))
        prints = table.column("prints").combine_chunks().flatten().to_numpy().view(_U).reshape(-1, len(_SEEDS))
        fp = prints[np.arange(len(node)), which]
        # runs of a key in Gray order: one, where the key has no more than group_limit rows
        order = np.lexsort((gray_rank(fp), key))
        place, new = np.arange(len(order)), np.concatenate(([True], np.diff(key[order]) != 0))
        inside = place - np.maximum.accumulate(np.where(new, place, 0))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(inside % group_limit == 0)
        some = np.bincount(group)[group] > 1
        node, fp, group, prints = node[some], fp[some], group[some], prints[some]
        out = [np.zeros((0, 2), np.int64)]
        if len(node):
            index = GrayIndex(group, fp)
            own, whole = node[index.order], prints[index.order]
            names, row = np.unique(own, return_inverse=True)
            label = np.arange(len(names))
            for i, j in index.pairs(NEAR):
                apart = np.bitwise_count(whole[i] ^ whole[j]).sum(axis=1, dtype=np.int64)
                close = np.argsort(apart, kind="stable")[: np.count_nonzero(apart <= NEAR_ALL)]
                i, j = row[i[close]], row[j[close]]
                for used in _nearest(label, i, j):
                    out.append(np.stack((names[i[used]], names[j[used]]), axis=1))
        pairs = np.sort(np.concatenate(out), axis=1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_pairs(sets: DataFrame, n: int, per_group: int = 64, group_limit: int = 4096, bucket_rows: int = 100_000) -> DataFrame:
    """(a, b) with a < b: pairs of the n rows of `sets` (node, and prints from set_fingerprints) within NEAR bits
    of one fingerprint, with which they share a field, and NEAR_ALL bits of all. Each task gives a
    spanning forest of the pairs it finds, the nearest first. Fields are as wide as in `link`, so groups
    stay small as the rows grow; a larger group is searched in runs of group_limit rows in Gray order.
    Some pairs share no field: these are candidates for an exact check, not all links."""
    spark = session_ready(sets.sparkSession)
    width = min(24, max(1, math.ceil(math.log2(max(2.0, n / per_group)))))
    starts = [k * (64 - width) // (FIELDS - 1) for k in range(FIELDS)]
    keys = F.array(*[F.struct(F.lit(s).alias("which"), F.xxhash64(F.lit(s), F.lit(low), _field(F.get("prints", F.lit(s)), low, width)).alias("key")) for s in range(len(_SEEDS)) for low in starts])
    rows = sets.select("node", "prints", F.explode(keys).alias("k")).select("node", "prints", "k.which", "k.key")
    bucket = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(_buckets(spark), -(-n * FIELDS * len(_SEEDS) // bucket_rows))))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_near_forest(group_limit), "a long, b long").distinct()


def _buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 2) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id (the smallest id that links
    reach, its own included) and kept (true for one row of each component).

    Null and empty texts have fingerprint 0 and link like any other. Rows with equal ids and
    texts are one class. A component in which every id is null has component_id null; a row
    with a null id is kept only in such a component. Other columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    members = connected_components(link(distinct.select("fp"), distance), "a", "b")
    classes = distinct.join(members, distinct.fp == members.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = materialise(classes.join(smallest, "component").select("fp", "component_id"))
    return rows.join(labels, "fp").select(
        id_col, "fp", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )
