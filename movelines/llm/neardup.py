"""Near-duplicates by word shingles: pairs whose sets of shingles have a Jaccard similarity of at
least `threshold`, and the components of all such pairs.

Rows with equal sets are one class. Near classes are found by SimHash: four fingerprints of each set in the
Gray-order index (simhash.near_pairs), every pair decided on the whole sets. A fingerprint is no bound on
the similarity, so what this leaves apart is looked at once more: classes that agree on a band of MinHash values
(20 bands of 5: at similarity 0.8, 1 - (1 - 0.8**5)**20 = 99.96 % of pairs share one) and whose 128
values, a byte of each, agree as often as similar sets do (at 0.8, all but some 30 in a million do).
Every candidate is decided on the whole sets.

A group of n similar rows has n * n / 2 pairs, but its component needs few of them. So the index gives
forests of the nearest pairs, and in each band only the pairs whose ends are still in
different components are looked at. These never leave their band: it names the members that have such pairs, gets
their whole sets, and sends back a spanning forest of the links. Nothing is dropped: a pair of one
component changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BLOCK, blocks, materialise, mix, session_ready, utf8, word_spans
from .components import connected_components
from .simhash import near_pairs, set_fingerprints
from .substrings import word_hashes

_U = np.uint64
VALUES, BANDS, WIDTH = 128, 20, 5
MARKS = 1 << 25
_SEEDED = np.random.default_rng(7)
_FLIP = _SEEDED.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]
_TIMES = _SEEDED.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None] | np.uint32(1)
_PLACE = _SEEDED.integers(0, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)


def shingle_sets(column: pa.Array | pa.ChunkedArray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles. Words are separated by white
    space and compared without the case of ASCII letters; fewer than `shingle` words are one."""
    buf, offsets = utf8(column)
    buf = np.where((buf >= 65) & (buf <= 90), buf | np.uint8(32), buf)
    starts, ends, first = word_spans(buf, offsets)
    one, two = word_hashes(buf, starts, ends, b"near-dedup")  # no two words share both halves
    word = mix(one + mix(two))
    n = max(0, len(word) - shingle + 1)
    line = np.zeros(n, _U)
    for k in range(shingle):
        line += word[k : k + n] * _PLACE[k]
    line, out = mix(line), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(line[a : b - shingle + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _PLACE[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def minima(hashes: np.ndarray, tile: int = 2048) -> np.ndarray:
    """The MinHash values of one set."""
    low = np.full(VALUES, (1 << 32) - 1, np.uint32)
    short = (hashes >> _U(32)).astype(np.uint32)
    for s in range(0, len(short), tile):
        np.minimum(low, ((short[None, s : s + tile] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    return low


def _sketches(shingle: int):
    def run(batches):
        for block in blocks(batches, "text", SMALL_BLOCK):
            sets = shingle_sets(block.column("text"), shingle)
            low = np.stack([minima(s) for s in sets])
            bands = low[:, : BANDS * WIDTH].astype(_U).reshape(-1, BANDS, WIDTH)
            keys = mix((bands * _PLACE[:WIDTH]).sum(axis=2, dtype=_U) + _PLACE[WIDTH : WIDTH + BANDS])
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            one = np.fromiter((s.sum(dtype=_U) for s in sets), _U, len(sets))
            two = np.fromiter((np.bitwise_xor.reduce(mix(s), initial=_U(0)) for s in sets), _U, len(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.column(k) for k in ("row", "text_hash")),
                    *(pa.array(x.view(np.int64)) for x in (one, two)),
                    pa.array(size),
                    pa.array([k if n else [] for k, n in zip(keys.view(np.int64).tolist(), size.tolist())], pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in low.astype(np.uint8)], pa.binary()),
                    pa.array([set_fingerprints(x).view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                ["row", "text_hash", "one", "two", "size", "keys", "values", "prints"],
            )

    return run


def _sets(shingle: int, marks):
    """The sets of the texts whose hash is marked; some more may be."""

    def run(batches):
        for block in blocks(batches, "text", SMALL_BLOCK):
            place = block.column("text_hash").to_numpy() & (MARKS - 1)
            marked = (marks.value[place >> 6] >> (place & 63).astype(_U)) & _U(1) != 0
            block = block.filter(pa.array(marked))
            if block.num_rows:
                sets = shingle_sets(block.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([*(block.column(k) for k in ("row", "text_hash")), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["row", "text_hash", "shingles"])

    return run


def _marks(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, in a table of MARKS bits. At most that comes to the driver."""
    place = F.col("text_hash").bitwiseAND(F.lit(MARKS - 1))
    bits = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(text_hash & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, _U)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return out


def _grouped(table: pa.Table) -> tuple[pa.Table, list[int]]:
    """The table with rows of one key together, and where each key begins and the last one ends."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    return table.take(pa.array(order)), [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]


def _similar_values(table: pa.Table, cuts: list[int], threshold: float):
    """Batches of rows (i, j) of one key, whose sets may be similar and whose labels differ."""
    # 4.2 standard deviations below what is expected at the threshold
    least = VALUES * (threshold + (1 - threshold) / 256) - 4.2 * np.sqrt(VALUES * threshold * (1 - threshold)) - 0.5
    size, label = table.column("size").to_numpy(), table.column("label").to_numpy()
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint8).reshape(-1, VALUES)
    for s, e in zip(cuts[:-1], cuts[1:]):
        own = np.arange(s, e)
        names, inverse, count = np.unique(label[own], return_inverse=True, return_counts=True)
        if len(names) == 1:
            continue
        rest = inverse != count.argmax()
        own = np.concatenate((own[rest], own[~rest]))
        asked = int(rest.sum())
        step = max(1, (1 << 24) // (len(own) * VALUES))
        for t in range(0, asked, step):
            left, right = own[t : min(asked, t + step), None], own[None, t + 1 :]
            ok = np.maximum(size[left], size[right]) * threshold <= np.minimum(size[left], size[right])
            ok &= np.arange(t, t + len(left))[:, None] < np.arange(t + 1, len(own))[None, :]
            ok &= label[left] != label[right]
            if ok.any():
                ok &= (values[left] == values[right]).sum(axis=2) >= least
                i, j = np.nonzero(ok)
                yield left[i, 0], right[0, j]


def _undecided(threshold: float):
    """The members that may be similar to one in another component."""

    def run(table: pa.Table) -> pa.Table:
        table, cuts = _grouped(table)
        some = np.zeros(table.num_rows, bool)
        for i, j in _similar_values(table, cuts, threshold):
            some[i], some[j] = True, True
        return table.select(["bucket", "band", "key", "node", "size", "label", "values"]).filter(pa.array(some))

    return run


def _decided(threshold: float):
    """A spanning forest of the links between components, by the whole sets of undecided members."""

    def run(table: pa.Table) -> pa.Table:
        table, cuts = _grouped(table)
        node = table.column("node").to_numpy()
        classes = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        root = np.arange(classes.max(initial=0) + 1)
        shingles = table.column("shingles").combine_chunks()
        size = np.asarray(pa.compute.list_value_length(shingles)).astype(np.int64)
        flat = np.unique(shingles.flatten().to_numpy(), return_inverse=True)[1]
        begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        mark, out = np.zeros(flat.max(initial=0) + 1, bool), []
        for i, j in _similar_values(table, cuts, threshold):
            for row in np.unique(i).tolist():
                others = j[i == row]
                others = others[root[classes[others]] != root[classes[row]]]
                if not len(others):
                    continue
                low, high = others.min(), others.max() + 1
                mark[flat[begin[row] : begin[row + 1]]] = True
                common = np.add.reduceat(mark[flat[begin[low] : begin[high]]].astype(np.int64), begin[low:high] - begin[low])[others - low]
                mark[flat[begin[row] : begin[row + 1]]] = False
                for other in others[common / (size[row] + size[others] - common) >= threshold].tolist():
                    a, b = root[classes[row]], root[classes[other]]
                    if a != b:
                        out.append((node[row], node[other]))
                        root[root == max(a, b)] = min(a, b)
        return pa.table([[int(a) for a, _ in out], [int(b) for _, b in out]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_components(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bucket_rows: int = 20_000) -> DataFrame:
    """(row, text_hash, component) of each row: the id, the xxhash64 of the text, and a number that
    rows share if and only if links reach from one to the other. Null and empty texts link with
    each other and nothing else. Other columns are ignored."""
    spark = session_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("row"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = materialise(source.mapInArrow(_sketches(shingle), "row long, text_hash long, one long, two long, size long, keys array<long>, values binary, prints array<long>"))
    # rows of one class have the same keys and values
    classes = rows.groupBy("one", "two").agg(F.min(F.struct("row", "text_hash")).alias("r"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in ("keys", "values", "prints")])
    classes = materialise(classes.select("one", "two", "r.row", "r.text_hash", "size", "keys", "values", "prints").withColumn("node", F.monotonically_increasing_id()))
    keys = classes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("key").count().filter("count > 1").select("key")
    bands = materialise(keys.join(shared, "key").join(classes.select("node", "size", "values"), "node"))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bands.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(buckets))

    def sets_of(nodes: DataFrame) -> DataFrame:
        ends = classes.select("node", "row", "text_hash").join(nodes.distinct(), "node")
        # whole texts are not shuffled: the workers leave out nearly all that are in no pair
        marks = spark.sparkContext.broadcast(_marks(ends))
        sets = source.mapInArrow(_sets(shingle, marks), "row long, text_hash long, shingles array<long>")
        return materialise(sets.join(ends, ["row", "text_hash"]).dropDuplicates(["row", "text_hash"]).select("node", "shingles"))

    bands = bands.withColumn("bucket", bucket)
    full = classes.filter("size > 0")  # the empty set is one class and links with no other
    pairs = materialise(near_pairs(full.select("node", "prints"), classes.count()))
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    links = materialise(both.filter(F.col("common") / (F.size("of_a") + F.size("of_b") - F.col("common")) >= threshold).select("a", "b"))
    members = connected_components(links, "a", "b")
    labelled = bands.join(members, "node", "left").select("bucket", "band", "key", "node", "size", "values", F.coalesce("component", "node").alias("label"))
    rest = materialise(labelled.groupBy("bucket").applyInArrow(_undecided(threshold), "bucket long, band int, key long, node long, size long, label long, values binary"))
    if not rest.isEmpty():
        whole = rest.join(sets_of(rest.select("node")), "node")
        more = materialise(whole.groupBy("bucket").applyInArrow(_decided(threshold), "a long, b long"))
        if not more.isEmpty():
            members = connected_components(links.union(more), "a", "b")
    labels = materialise(classes.join(members, "node", "left").select("one", "two", F.coalesce("component", "node").alias("component")))
    return rows.join(labels, ["one", "two"]).select("row", "text_hash", "component")
