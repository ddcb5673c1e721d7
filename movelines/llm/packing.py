"""Packing into fixed-length sequences: first-fit decreasing with a tournament tree.

Documents fall into groups at random, by a seeded hash, each with about `group_bytes` of text;
a group is tokenised and packed on its own, in one task, without a look at any other. In a
group, whole sequences are cut off the long documents; the remaining pieces go, longest first,
into the first sequence with room, which the tournament tree over free capacities finds in
log2(n) steps. What room is left is then filled by cutting up the pieces of the emptiest
sequences, so a group has at most one sequence that needs padding.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, session_ready
from .tokens import encoder

#: Chunks in either half of the encoder's memory, some 200 bytes each: the worker that holds it stays for later stages.
MEMORY = 200_000
PIECES = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OUT = pa.schema([(n, pa.int64()) for n in (x.split()[0] for x in PIECES.split(", "))])


class Tournament:
    """The first of n bins with at least some free room. Each inner node holds the larger free
    room of its two children, so the leftmost bin that fits is found from the root down."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        room, k = self.room, 1
        if room[1] < need:
            raise ValueError("no bin has room")
        while k < self.size:
            k *= 2
            if room[k] < need:
                k += 1
        room[k] -= need
        at = k - self.size
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each piece. Ties keep their order."""
    tree, out = Tournament(max(1, len(sizes)), capacity), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = tree.place(sizes[k])
    return out


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every token lies in exactly one piece."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((d, whole, n - whole))
    bins: list[list[tuple[int, int, int]]] = []
    for piece, b in zip(rest, first_fit_decreasing([p[2] for p in rest], capacity)):
        while len(bins) <= b:
            bins.append([])
        bins[b].append(piece)
    free = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: free[k])
    low, high = 0, len(order) - 1
    while low < high:
        to, of = order[low], order[high]
        if not free[to]:
            low += 1
        elif not bins[of]:
            high -= 1
        else:
            d, s, n = bins[of].pop()
            take = min(n, free[to])
            bins[to].append((d, s + n - take, take))
            if n > take:
                bins[of].append((d, s, n - take))
            free[to] -= take
            free[of] += take
    return full + [b for b in bins if b]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    group_bytes: int = 4 << 20,
    seed: int = 11,
    special_as_text: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, copy, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then end_id; a null or empty text has end_id alone.
    `tokenizer` is a tokenizers JSON file that every executor has. Rows that repeat an id are
    packed as separate documents, told apart by copy (0, 1, ... among equal ids of a group).
    Rows that repeat both id and text are spread by the partition they are read in, so however
    many there are, a group holds no more of them than one partition. The string of a special
    token in a text is that token, as the library has it, or text with `special_as_text`.
    Null ids are allowed. An empty table gives no pieces. Other columns are ignored.
    """
    spark = session_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    total = source.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 16)).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    spread = source.select(F.pmod(F.xxhash64(F.lit(seed), "_id", "_text", F.spark_partition_id()), F.lit(groups)).alias("group"), "_id", "_text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("_text", "ascending")])
        group = int(table.column("group")[0].as_py())
        parts = [encoder(tokenizer, special_as_text, MEMORY).encode(b.column("_text"), end_id) for b in blocks(table.combine_chunks().to_batches(), "_text")]
        sizes = np.concatenate([np.diff(offsets) for _, offsets in parts])
        begin, sizes = (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()
        raw = memoryview(b"".join([tokens.tobytes() for tokens, _ in parts]))
        names = table.column("_id").to_pylist()
        copy = [0] * len(names)
        for k in range(1, len(names)):
            copy[k] = copy[k - 1] + 1 if names[k] == names[k - 1] else 0
        rows = []
        for q, pieces in enumerate(pack(sizes, capacity)):
            offset = 0
            for d, s, n in pieces:
                at = begin[d] + s
                rows.append((names[d], copy[d], s, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), sizes[d], (group << 24) + q, offset))
                offset += n
        return pa.table([list(x) for x in zip(*rows)] or [[]] * 8, schema=_OUT)

    return spread.groupBy("group").applyInArrow(run, PIECES).withColumnRenamed("doc_id", id_col)
