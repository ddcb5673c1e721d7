"""Embedding near-dedup with int8 tile products and rigorous error bounds.

Each unit vector x is stored as scale * q + e with q in int8 and the length of e known exactly.
For two vectors, |x.y - sx*sy*qx.qy| <= |x||ey| + |ex||y'| where y' = y - ey, so the int8
product and two scalars bound the cosine from both sides. Tiles of int8 products run as matrix
products of at most 1,024 dimensions at once (exact: the integers stay below 2**24). The bounds of
a pair are made of its own two vectors only, number by number, so they are the same in whatever
tile the pair comes up. A pair whose lower bound reaches the
threshold is a link, one whose upper bound doesn't is none, and only the pairs in between are
computed again, from the stored values, in double precision.

Equal vectors are one class with a multiplicity, so copies cost nothing. Classes are dealt into
blocks, and each pair of blocks is one group: two blocks of bounded size, however many vectors
there are. Only codes, scales and errors go to every group; a group names the vectors that it
needs whole, and these alone follow in a second round. A group sends back link counts and a
spanning forest of its links, never the links themselves, so a dense cluster cannot grow the
output with the square of its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, session_ready
from .components import connected_components
from .simhash import _hook

_FIRST = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("side", pa.int32()), ("dims", pa.int32()), ("cell", pa.int64())])
_FIRST_SQL = "node long, links long, other long, side int, dims int, cell long"
_SECOND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and an upper bound of each residual's length, for rows of length 1."""
    top = np.abs(unit).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error * (1 + 1e-9) + 1e-12


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square over- or underflows
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Codes:
    """Quantised vectors of one length."""

    values: np.ndarray  # int8
    scale: np.ndarray
    error: np.ndarray

    def __getitem__(self, rows) -> Codes:
        return Codes(self.values[rows], self.scale[rows], self.error[rows])


def _exact_product(a: np.ndarray, b: np.ndarray, dims: int = 1024) -> np.ndarray:
    """The products of rows of int8 values, as float32 rounded once, whatever the matrices' shapes."""
    if a.shape[1] <= dims:
        return a @ b.T
    total = np.zeros((len(a), len(b)))
    for s in range(0, a.shape[1], dims):
        total += a[:, s : s + dims] @ b[:, s : s + dims].T
    return total.astype(np.float32)


def tile_bounds(left: Codes, right: Codes, threshold: float, tile: int = 1024, same: bool = False):
    """(rows of left, rows of right, certain, open): for each tile, which pairs are links for
    certain and which may be. Of a block against itself each pair comes once, i < j, if `same`."""
    slack = np.float32(1e-5)  # of the float32 arithmetic after the integer product
    fl, fr = left.values.astype(np.float32), right.values.astype(np.float32)
    for a in range(0, len(fl), tile):
        ra = slice(a, min(len(fl), a + tile))
        for b in range(a if same else 0, len(fr), tile):
            rb = slice(b, min(len(fr), b + tile))
            product = _exact_product(fl[ra], fr[rb])
            product *= left.scale[ra, None].astype(np.float32) * right.scale[None, rb].astype(np.float32)
            # |x||ey| + |ex||y'|, with |x| = 1 and |y'| <= 1 + ey
            er = right.error[None, rb].astype(np.float32)
            away = left.error[ra, None].astype(np.float32) * (er + np.float32(1)) + (er + slack)
            maybe = product + away >= threshold
            if same and a == b:
                maybe &= np.arange(a, ra.stop)[:, None] < np.arange(b, rb.stop)[None, :]
            certain = maybe & (product - away >= threshold)
            yield ra, rb, certain, maybe & ~certain


def exact_links(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, at_once: int = 1 << 16):
    """Those of the pairs i, j with cosine >= threshold in double precision, in batches."""
    for s in range(0, len(i), at_once):
        x, y = i[s : s + at_once], j[s : s + at_once]
        ok = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
        yield x[ok], y[ok]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _encode(batches):
    """Codes of the vectors, in batches of rows of one length."""
    for batch in batches:
        size = np.asarray(pa.compute.list_value_length(batch.column("vector")))
        for n in np.unique(size).tolist():
            own = batch.filter(pa.array(size == n))
            codes, scale, error = quantise(_unit(_matrix(pa.chunked_array([own.column("vector")]))))
            yield pa.RecordBatch.from_arrays(
                [*(own.column(k) for k in ("node", "least", "weight", "vector")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error), pa.array(np.full(len(codes), n, np.int32))],
                ["node", "least", "weight", "vector", "codes", "scale", "error", "dims"],
            )


class _Cell:
    """The two blocks of a group: rows in order of side and node, the left one first."""

    def __init__(self, table: pa.Table):
        side = table.column("side").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), side))
        self.table = table.take(pa.array(order))
        self.node, self.weight = self.table.column("node").to_numpy(), self.table.column("weight").to_numpy().astype(np.float64)
        cut = int(np.searchsorted(side[order], 1))
        self.same = cut == len(side)  # a block against itself comes once, as the left side
        self.left, self.right = slice(0, cut), slice(0, cut) if self.same else slice(cut, len(side))
        self.links, self.label = np.zeros(len(side)), np.arange(len(side))

    def bounds(self, codes: Codes, threshold: float, tile: int):
        """tile_bounds, with rows counted over the whole group."""
        for ra, rb, certain, maybe in tile_bounds(codes[self.left], codes[self.right], threshold, tile, same=self.same):
            yield ra, slice(rb.start + self.right.start, rb.stop + self.right.start), certain, maybe

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links += np.bincount(i, self.weight[j], len(self.node)) + np.bincount(j, self.weight[i], len(self.node))
        _hook(self.label, i, j)

    def found(self) -> list:
        some = self.links > 0
        return [self.node[some], self.links[some].astype(np.int64), self.node[self.label[some]]]


def _codes(table: pa.Table) -> Codes:
    values = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(table.num_rows, -1)
    return Codes(values, table.column("scale").to_numpy(), table.column("error").to_numpy())


def _by_codes(threshold: float, tile: int):
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        needed = np.zeros(len(cell.node), bool)
        for ra, rb, certain, maybe in cell.bounds(_codes(cell.table), threshold, tile):
            if certain.any():
                i, j = np.nonzero(certain)
                cell.link(i + ra.start, j + rb.start)
            if maybe.any():
                needed[ra] |= maybe.any(axis=1)
                needed[rb] |= maybe.any(axis=0)
        n, ask = cell.found(), np.flatnonzero(needed)
        linked = pa.table([*n, *(pa.nulls(len(n[0]), f.type) for f in list(_FIRST)[3:])], schema=_FIRST)
        side, dims, own = cell.table.column("side").to_numpy()[ask], table.column("dims")[0].as_py(), table.column("cell")[0].as_py()
        asked = pa.table([cell.node[ask], pa.nulls(len(ask), pa.int64()), pa.nulls(len(ask), pa.int64()), side, np.full(len(ask), dims, np.int32), np.full(len(ask), own)], schema=_FIRST)
        return pa.concat_tables([linked, asked])

    return run


def _by_vectors(threshold: float, tile: int):
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        unit = _unit(_matrix(cell.table.column("vector")))
        for ra, rb, _, maybe in cell.bounds(_codes(cell.table), threshold, tile):
            i, j = np.nonzero(maybe)
            for x, y in exact_links(unit, unit, i + ra.start, j + rb.start, threshold):
                cell.link(x, y)
        return pa.table(cell.found(), schema=_SECOND)

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block_rows: int = 6144, tile: int = 1024) -> DataFrame:
    """Link vectors with cosine >= threshold. One row per input row: id, n_links (other rows
    linked directly), component_id (smallest id that links reach), kept (id = component_id).

    A vector that is null or empty, has only zeros, or holds a null or non-finite component
    links with nothing and is its own component. Vectors of different lengths never link.
    Equal vectors link with each other. Rows with a null id count as rows but name no
    component: theirs is null if no id is reachable, and they are never kept. Rows that share
    an id are separate rows. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    session_ready(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    plain = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    valid = plain & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    clean = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.when(valid, clean).alias("vector"))
    good = rows.filter("vector is not null")
    classes = good.groupBy("vector").agg(F.min("_id").alias("least"), F.count("*").alias("weight"))
    # the numbers are stored with the classes, so every later read sees the same ones
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    columns = "node long, least long, weight long, vector array<double>, codes binary, scale double, error double, dims int"
    classes = materialise(classes.select("node", "least", "weight", "vector").mapInArrow(_encode, columns))
    # by length: so many blocks that none has more than block_rows vectors, and some tasks more if they are few
    blocks = F.greatest(F.ceil(F.col("count") / block_rows), F.least(F.lit(12), F.ceil(F.col("count") / 1024))).cast("int")
    sizes = classes.groupBy("dims").count().select("dims", blocks.alias("n"))
    own = classes.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"), (F.col("block") > o).cast("int").alias("side")))
    cells = own.select("node", "weight", "codes", "scale", "error", "dims", "n", F.explode(ends).alias("c"))
    cells = cells.select("node", "weight", "codes", "scale", "error", "dims", "c.side", (F.col("c.p").cast("long") * F.col("n") + F.col("c.q")).alias("cell"))
    # a number of tasks is given, since few bytes of codes mean much work
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = materialise(cells.repartition(tasks, "dims", "cell").groupBy("dims", "cell").applyInArrow(_by_codes(threshold, tile), _FIRST_SQL))
    asked = first.filter("cell is not null").select("dims", "cell", "node", "side").join(classes.select("node", "weight", "vector", "codes", "scale", "error"), "node")
    second = asked.repartition(tasks, "dims", "cell").groupBy("dims", "cell").applyInArrow(_by_vectors(threshold, tile), "node long, links long, other long")
    found = materialise(first.filter("cell is null").select("node", "links", "other").union(second))
    members = connected_components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(members, "node", "left")
    named = named.select("vector", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = materialise(named.join(smallest, "component").select("vector", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"))
    done = rows.join(labels, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return done.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
