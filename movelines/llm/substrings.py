"""Substring dedup by seed and extend.

Documents are joined on winnowed anchors: in every window of `length` words the smallest
hash of `seed` consecutive words is kept, so two equal windows always keep the same anchor.
Anchors that more than one document holds are seeds. Around each seed the match is extended
both ways over every window that the seed anchors; a window matches when another document
holds the same word sequence (compared on 128 bits, from two halves of a hash that gives no two
words the same value, under a key drawn for each run). The document that holds a window first and
its place there come back, and the match goes on from window to window as long as both texts do: a
maximal repeat is a run of windows with one source document on one diagonal, at least `length` words
long. The source of a window is the smallest doc_id that holds it, the place the first one there; so
repeats may overlap where a window is known from elsewhere. Their words are cut from every document
but the first.

Three rounds, each keyed by chunk of documents and then by hash range:
  seeds    chunk -> its distinct anchors      -> range: anchors of two or more documents
  extend   chunk -> distinct anchored windows -> range: the smallest doc_id of each, and the place
  cut      chunk -> words covered by a window of a smaller doc_id
A chunk sends a passage once, however many of its documents hold it, so a passage in a third
of all documents costs a range at most one entry a chunk. The number of chunks and of ranges
follows the size of the input; beyond 100 GB chunks and ranges also grow in size, with its cube
root (tenfold at 100 TB), which keeps the entries of one passage to some tens of MB.
"""

from __future__ import annotations

import math
import secrets
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, session_ready, utf8, word_spans

_U = np.uint64
_TURN = (_U(27), _U(37))

SEEDS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
REPLY = pa.schema([("chunk", pa.int32()), ("keys", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
_SEEDS, _WINDOWS, _REPLY = "bucket int, chunk int, keys binary, many binary", "bucket int, chunk int, keys binary, docs binary", "chunk int, keys binary"


class _Chunk:
    """The words of a chunk's documents in order of id, and the windows that lie in one document."""

    def __init__(self, table: pa.Table, length: int, key: bytes):
        ids = table.column("_id").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        values = ids.fill_null(0).to_numpy()  # never as floats, which would lose digits
        order = np.argsort(values, kind="stable")
        self.ids, self.null = values[order], np.asarray(ids.is_null())[order]
        table = table.take(pa.array(order))
        self.buf, self.offsets = utf8(table.column("_text"))
        self.starts, self.ends, self.first = word_spans(self.buf, self.offsets)
        self.words, self.other = word_hashes(self.buf, self.starts, self.ends, key)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        n = max(0, len(self.words) - length + 1)
        self.at = np.flatnonzero((self.doc[:n] == self.doc[length - 1 : length - 1 + n]) & ~self.null[self.doc[:n]])

    def anchors(self, length: int, seed: int) -> np.ndarray:
        """The anchor of each window."""
        if not len(self.at):
            return np.zeros(0, _U)
        low, span, width = runs(self.words, seed), length - seed + 1, 1
        while width < span:  # running minimum by doubling
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        return low[self.at]

    def windows(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows that start at `at`."""
        if not len(at):
            return np.zeros(0, _U), np.zeros(0, _U)
        return runs(self.words, length)[at], runs(self.other, length)[at]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a hash of each word that no two words share. A word of up to 15 bytes
    and its length are 128 bits, which a few rounds of a keyed Feistel network permute; a longer
    word has a keyed cryptographic hash."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    ones = ~_U(0)
    a = eight[starts] & (ones >> (_U(8) * (8 - np.minimum(size, 8)).astype(_U)))
    b = eight[np.minimum(starts + 8, len(buf))] & ((ones >> _U(8)) >> (_U(8) * (7 - np.clip(size - 8, 0, 7)).astype(_U)))
    b |= np.minimum(size, 16).astype(_U) << _U(56)
    for k in np.frombuffer(blake2b(key, digest_size=32).digest(), _U):
        a, b = b, a ^ mix(b + k)
    long = np.flatnonzero(size > 15)
    if len(long):
        raw = buf.tobytes()
        words = [raw[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist())]
        known = {w: blake2b(w, digest_size=16, key=key).digest() for w in set(words)}
        both = np.frombuffer(b"".join(map(known.__getitem__, words)), _U).reshape(-1, 2)
        a[long], b[long] = both[:, 0], both[:, 1]
    return a, b


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every `length` values in a row, by doubling. The order of values matters."""
    out, have, power, width = None, 0, h, 1
    while True:
        if length & width:
            if out is None:
                out = power
            else:
                n = len(h) - have - width + 1
                out = mix((out[:n] << _TURN[0] | out[:n] >> _TURN[1]) ^ (power[have : have + n] + _U(width)))
            have += width
        if have == length:
            return out[: len(h) - length + 1]
        n = len(power) - width
        power = mix((power[:n] << _TURN[0] | power[:n] >> _TURN[1]) + power[width:])
        width *= 2


def _sorted(a: np.ndarray, b: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (a, b) together, docs ascending, and each run's first place.
    docs must ascend already."""
    order = np.argsort(a, kind="stable")
    same_a = a[order][1:] == a[order][:-1]
    if np.any(same_a & (b[order][1:] != b[order][:-1])):
        order = np.lexsort((docs, b, a))
        same_a = a[order][1:] == a[order][:-1]
    same = same_a & (b[order][1:] == b[order][:-1])
    return order, np.flatnonzero(np.concatenate(([True], ~same))) if len(a) else np.zeros(0, np.int64)


def _ranges(keys: np.ndarray, bits: int):
    """Ranges of sorted keys by their top bits."""
    top = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(top) else []
    for s, e in zip(at, [*at[1:], len(keys)]):
        yield int(top[s]), s, e


def _u64(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), _U)


def _joined(column) -> np.ndarray:
    parts = [_u64(x) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, seed: int = 5, chunk_bytes: int = 3 << 20, range_keys: int = 1 << 19) -> DataFrame:
    """Cut from each text the words of every `length`-word passage that also starts in a
    document with a smaller id.

    Returns one row per input row: id, n_words, n_removed, repeats (the maximal repeats that were
    cut, in order: start and end, exclusive, in words, the document that holds the words first, and
    where they start there) and kept_text (the kept words joined by one space). Windows are judged
    on the input. A null or empty text has no words. A row with
    a null id keeps all its words and is nobody's source. Rows with equal ids don't cut each
    other. Other columns of `docs` are ignored.
    """
    if not 1 <= seed <= length:
        raise ValueError("seed must lie between 1 and length")
    spark = session_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    larger = max(1.0, total / 100e9) ** (1 / 3)
    chunks = max(1, math.ceil(total / (chunk_bytes * larger)))
    bits = max(4, math.ceil(math.log2(max(1, total / 5 / (range_keys * larger)))))
    # rows without an id match nothing, so any chunk will do for them
    place = F.when(F.col("_id").isNull(), F.spark_partition_id().cast("long")).otherwise(F.col("_id"))
    chunked = source.select(F.pmod(F.xxhash64(place, "_text"), F.lit(chunks)).cast("int").alias("chunk"), "_id", "_text")

    key = secrets.token_bytes(32)

    def seeds(table: pa.Table) -> pa.Table:
        c = _Chunk(table, length, key)
        keys, doc = c.anchors(length, seed), c.ids[c.doc[c.at]]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, bool)
        keys, doc = keys[new], doc[new]
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        last = np.concatenate((at[1:], [len(keys)])) - 1 if len(keys) else at
        many, keys = (doc[at] != doc[last]).astype(np.uint8), keys[at]
        chunk = int(table.column("chunk")[0].as_py())
        rows = [(b, chunk, keys[s:e].tobytes(), many[s:e].tobytes()) for b, s, e in _ranges(keys, bits)]
        return pa.table([list(x) for x in zip(*rows)] or [[]] * 4, schema=SEEDS)

    def shared(table: pa.Table) -> pa.Table:
        parts = [_u64(x) for x in table.column("keys")]
        keys = np.concatenate(parts)
        many = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("many")]) > 0
        every = np.sort(keys)
        twice = every[1:][every[1:] == every[:-1]]
        wanted = np.unique(np.concatenate((twice, keys[many])))
        out = [(ch.as_py(), p[np.isin(p, wanted, assume_unique=True)].tobytes()) for ch, p in zip(table.column("chunk"), parts)]
        out = [x for x in out if x[1]]
        return pa.table([list(x) for x in zip(*out)] or [[]] * 2, schema=REPLY)

    def extend(table: pa.Table, reply: pa.Table) -> pa.Table:
        rows: list = []
        if table.num_rows and reply.num_rows:
            c = _Chunk(table, length, key)
            wanted = np.sort(_joined(reply.column("keys")))
            keys = c.anchors(length, seed)
            place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            at = c.at[wanted[place] == keys]
            a, b = c.windows(at, length)
            doc = c.ids[c.doc[at]]
            order, first = _sorted(a, b, doc)
            pick = order[first]
            place = (at - c.first[c.doc[at]])[pick].astype(np.int32)
            a, b, doc = a[pick], b[pick], doc[pick]
            chunk = int(table.column("chunk")[0].as_py())
            for r, s, e in _ranges(a, bits):
                rows.append((r, chunk, np.concatenate((a[s:e], b[s:e])).tobytes(), doc[s:e].tobytes() + place[s:e].tobytes()))
        return pa.table([list(x) for x in zip(*rows)] or [[]] * 4, schema=WINDOWS)

    def earliest(table: pa.Table) -> pa.Table:
        both = [_u64(x) for x in table.column("keys")]
        a = np.concatenate([x[: len(x) // 2] for x in both])
        b = np.concatenate([x[len(x) // 2 :] for x in both])
        sizes = [len(x) // 2 for x in both]
        raw = [x.as_py() for x in table.column("docs")]
        doc = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(raw, sizes)])
        place = np.concatenate([np.frombuffer(x, np.int32, n, 8 * n) for x, n in zip(raw, sizes)])
        sender = np.repeat(np.arange(len(both)), sizes)
        order = np.lexsort((place, doc, a))
        if np.any((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])):
            order = np.lexsort((place, doc, b, a))
        a, b, doc, place, sender = a[order], b[order], doc[order], place[order], sender[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        count = np.diff([*first, len(a)])
        least, place = np.repeat(doc[first], count), np.repeat(place[first], count)
        late = np.flatnonzero(doc > least)
        late = late[np.argsort(sender[late], kind="stable")]
        a, b, least, place, sender = a[late], b[late], least[late], place[late].astype(np.int64), sender[late]
        out = []
        for k, x in enumerate(np.split(np.arange(len(a)), np.searchsorted(sender, np.arange(1, len(both))))):
            if len(x):
                out.append((table.column("chunk")[k].as_py(), np.concatenate((a[x], b[x] >> _U(32) << _U(32) | place[x].view(_U), least[x].view(_U))).tobytes()))
        return pa.table([list(x) for x in zip(*out)] or [[]] * 2, schema=REPLY)

    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        c = _Chunk(table, length, key)
        a, b = c.windows(c.at, length)
        doc = c.ids[c.doc[c.at]]
        order, first = _sorted(a, b, doc)
        place = c.at - c.first[c.doc[c.at]]
        # who holds each window first, and where: in this chunk, or else where the reply says
        count = np.diff([*first, len(a)])
        source, start = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        source[order], start[order] = np.repeat(doc[order][first], count), np.repeat(place[order][first], count)
        gone = doc > source
        parts = [_u64(x).reshape(3, -1) for x in reply.column("keys")]
        if parts:
            ea, eb, ed = np.concatenate(parts, axis=1)
            o = np.argsort(ea, kind="stable")
            # 96 bits tell the windows of a chunk apart; the place takes the other 32
            ea, eb, ed, ep, bb = ea[o], eb[o] >> _U(32), ed[o].view(np.int64), (eb[o] & _U(0xFFFFFFFF)).view(np.int64), b >> _U(32)
            lo, hi = np.searchsorted(ea, a), np.searchsorted(ea, a, side="right")
            hit = np.flatnonzero(lo < hi)
            at = lo[hit]
            for k in np.flatnonzero(hi[hit] - at > 1):  # several windows with one first hash
                same = np.flatnonzero(eb[lo[hit[k]] : hi[hit[k]]] == bb[hit[k]])
                at[k] += same[0] if len(same) else 0
            true = eb[at] == bb[hit]
            hit, at = hit[true], at[true]
            gone[hit], source[hit], start[hit] = True, ed[at], ep[at]
        step = np.zeros(len(c.words) + 1, np.int64)
        starts = c.at[gone]
        step[starts] += 1
        np.subtract.at(step, starts + length, 1)
        removed = np.cumsum(step[:-1]) > 0
        n_removed = np.diff(np.concatenate(([0], np.cumsum(removed)))[c.first])
        raw, kept = c.buf.tobytes(), []
        for d in range(len(c.ids)):
            f, t = c.first[d], c.first[d + 1]
            if not n_removed[d]:
                kept.append(b" ".join(raw[c.offsets[d] : c.offsets[d + 1]].split()).decode())
            elif n_removed[d] == t - f:
                kept.append("")
            else:
                left = f + np.flatnonzero(~removed[f:t])
                kept.append(b" ".join([raw[s:e] for s, e in zip(c.starts[left].tolist(), c.ends[left].tolist())]).decode())
        g = np.flatnonzero(gone)
        line, source, start = place[g], source[g], start[g]
        # the next window of the same text, with the same source one word further
        on = (c.at[g][1:] == c.at[g][:-1] + 1) & (c.doc[c.at[g]][1:] == c.doc[c.at[g]][:-1]) & (source[1:] == source[:-1]) & (start[1:] == start[:-1] + 1)
        begin = np.flatnonzero(np.concatenate(([True], ~on))) if len(g) else g
        last = np.append(begin[1:], len(g)) - 1 if len(g) else g
        spans = pa.StructArray.from_arrays([pa.array(x) for x in (line[begin], line[last] + length, source[begin], start[begin])], list(_SPANS.value_type.names))
        repeats = pa.ListArray.from_arrays(pa.array(np.searchsorted(c.at[g][begin], c.first).astype(np.int32)), spans)
        ids = pa.array(c.ids, mask=c.null)
        return pa.table([ids, np.diff(c.first), n_removed, repeats, pa.array(kept, pa.string())], schema=OUT)

    OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("repeats", _SPANS), ("kept_text", pa.string())])
    by_chunk = chunked.groupBy("chunk")
    reply = by_chunk.applyInArrow(seeds, _SEEDS).groupBy("bucket").applyInArrow(shared, _REPLY)
    found = by_chunk.cogroup(reply.groupBy("chunk")).applyInArrow(extend, _WINDOWS)
    late = found.groupBy("bucket").applyInArrow(earliest, _REPLY)
    out = by_chunk.cogroup(late.groupBy("chunk")).applyInArrow(cut, "id long, n_words long, n_removed long, repeats array<struct<start:bigint,end:bigint,source:bigint,source_start:bigint>>, kept_text string")
    return out.withColumnRenamed("id", id_col)
