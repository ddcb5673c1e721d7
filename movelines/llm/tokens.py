"""Token ids with a public tokenizer, and their binary file format: patched frame of reference.

Ids of all documents in ascending id order form one stream, cut into segments of whole
documents. A segment is one self-contained record:

  header   magic "PFR1", documents, ids, ids a block, blocks (little-endian uint32 each)
  lengths  ids in each document, uint32
  index    where each block begins in the body, uint32, and the body's length
  body     blocks: minimum (uint32), width in bits (uint8), exceptions (uint16), then the
           values less the minimum packed at that width, then the exceptions' places (uint16)
           and their full values less the minimum (uint32)

The width is the one that holds a set share of the block's values (a percentile); larger ones
go to the exception list. The index gives any block without reading those before it. Segments
are rows of a Parquet table, so that Spark's own commit protocol covers lost executors and any
store that Spark can write.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, scratch_dir, session_ready, utf8

# ---- tokenising ------------------------------------------------------------------------

# The white space of Unicode other than space and newline, and punctuation.
_OTHER_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_MARKS, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b".,!?;:")] = True
_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LONGEST = 256  # bytes of a chunk that is remembered
_UPPER = np.zeros(256, bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
# A space and lower-case letters below U+0250, each of which is its own composed form.
_WORD = re.compile(" [%s]+" % "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.islower()))
_COMBINING = 0xCC  # the first byte of U+0300, the first character that combines with one before it
_encoders: dict[tuple[str, bool, int], "Encoder"] = {}


def _chunks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All texts cut into chunks: some spaces and newlines with what follows up to the next, where
    punctuation at the end, after a plain letter or digit, is a chunk of its own. Gives each chunk's
    number, the distinct chunks by number, and each text's first chunk (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    space, mark = (buf == 32) | (buf == 10), _MARKS[buf]
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    text = offsets[:-1][offsets[:-1] < len(buf)]
    begin[text] = True
    ends = np.append(np.flatnonzero(begin)[1:], len(buf))
    ends = ends[mark[ends - 1]]  # of the chunks with punctuation at their ends
    place = np.arange(len(buf), dtype=np.int32 if len(buf) < 1 << 31 else np.int64)
    place[mark] = -1
    other = np.maximum.accumulate(place, out=place)  # the last byte up to here that is none
    last = other[ends - 1]
    begin[last[(last >= 0) & _PLAIN[buf[last]]] + 1] = True
    starts = np.flatnonzero(begin)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(starts, offsets)


def _folded(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case and newlines as spaces. A letter that may combine with what follows stays:
    J with a caron has no character of its own, j with one has."""
    upper = _UPPER[buf]
    upper[:-1] &= buf[1:] < _COMBINING
    out = np.where(upper, buf | 32, buf)
    out[buf == 10] = 32
    return out


def _folds(normalizer) -> bool:
    """Whether a normaliser makes no difference between a text and its folded form: it composes,
    makes one space of white space and lower-cases, and no more."""
    if normalizer is None:
        return False
    state = json.loads(normalizer.__getstate__())
    parts = state.get("normalizers", [state])
    want = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    return parts == want


class Encoder:
    """The tokenizers library with a memory of chunks.

    Both supported tokenizer kinds split a text before merging, and never across the border
    between a character that isn't white space and one that is, nor between a plain letter or
    digit and the punctuation after it. A text whose only white space is spaces and newlines is
    therefore its chunks one after the other. Arrow finds the distinct chunks of a block of texts,
    the library encodes those that are new, and the ids of the block are gathered by chunk number.
    A text with any other white space, or with the string of a special token, goes to the library
    whole. When the young half of the memory is full it becomes the old half, from which chunks
    still in use come back.

    Where the tokenizer lower-cases and makes white space one space, chunks are remembered in that
    form, so one that begins a sentence or a line is not new. If the tokenizer also marks the ends
    of words, plain words are given to its model many at a time, without the normaliser, which
    would not change them, and the ends tell their ids apart.

    The library gives the string of a special token in a text that token's id; with
    `special_as_text` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, memory: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.joined = Tokenizer.from_file(path) if special_as_text else self.library
        for t in (self.library, self.joined):
            t.no_truncation()
            t.no_padding()
        self.library.encode_special_tokens = special_as_text
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: k for k, t in added.items() if t.special}
        self.folds = _folds(self.library.normalizer) and len(self.special) == len(added)
        self.whole = re.compile("|".join([_OTHER_SPACE, *map(re.escape, self.special)]), re.IGNORECASE if self.folds else 0)
        self.words, self.ends = None, np.zeros(0, bool)
        if self.folds and (suffix := getattr(self.library.model, "end_of_word_suffix", None)):
            self.words = Tokenizer(self.library.model)  # shares the model
            self.words.pre_tokenizer = self.library.pre_tokenizer
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[[k for t, k in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.memory = memory

    def _learn(self, texts: list[str], at_once: int = 256) -> list[bytes]:
        """The ids of each text, none of which holds a special token's string."""
        if self.words is None:
            return self._separated(texts)
        out: list[bytes] = [b""] * len(texts)
        plain = list(map(_WORD.fullmatch, texts))
        rest = [k for k, x in enumerate(plain) if x is None]
        words = [k for k, x in enumerate(plain) if x is not None]
        parts = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        for part, e in zip(parts, self.words.encode_batch_fast(["".join([texts[k] for k in part]) for part in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(cut) != len(part):  # each has one end at least, so some text is not one word to the tokenizer
                rest += part
                continue
            raw = ids.tobytes()
            for k, a, b in zip(part, [0, *cut[:-1]], cut):
                out[k] = raw[a:b]
        for k, value in zip(rest, self._separated([texts[k] for k in rest])):
            out[k] = value
        return out

    def _separated(self, texts: list[str], at_once: int = 32) -> list[bytes]:
        """The same, for any text. A special token's string separates texts for the library, which
        takes them faster when joined."""
        if not self.special:
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        name, between = next(iter(self.special.items()))
        lines = [name.join(texts[k : k + at_once]) + name for k in range(0, len(texts), at_once)]
        ids = array("I")
        for e in self.joined.encode_batch_fast(lines, add_special_tokens=False):
            ids.extend(e.ids)
        raw, cut = ids.tobytes(), np.flatnonzero(np.frombuffer(ids, "<u4") == between) * 4
        return [raw[a:b] for a, b in zip([0, *(cut[:-1] + 4).tolist()], cut.tolist())]

    def _values(self, keys: list[bytes]) -> list[bytes | None]:
        """The ids of each distinct chunk; None where its texts must go to the library whole."""
        if len(self.young) > self.memory:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, keys))
        missing = []
        for k in [k for k, v in enumerate(out) if v is None]:
            if (known := self.old.get(keys[k])) is not None:
                out[k] = self.young[keys[k]] = known
            else:
                missing.append(k)
        texts = [keys[k].decode() for k in missing]
        if self.whole.search("\n".join(texts)):  # rare: find which
            fit = [not self.whole.search(t) for t in texts]
            missing, texts = list(compress(missing, fit)), list(compress(texts, fit))
        for k, value in zip(missing, self._learn(texts)):
            out[k] = value
            if len(keys[k]) <= _LONGEST:
                self.young[keys[k]] = value
        return out

    def encode(self, column: pa.Array | pa.ChunkedArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (n + 1 offsets). end_id,
        if given, follows each text. A null has no ids of its own."""
        buf, offsets = utf8(column)
        n = len(offsets) - 1
        code, distinct, first = _chunks(_folded(buf) if self.folds and len(buf) else buf, offsets)
        values = self._values(distinct.to_numpy(zero_copy_only=False).tolist())
        counts = np.diff(first)
        if None in values:  # one chunk of its own for each text that holds such a chunk
            odd = np.fromiter((v is None for v in values), bool, len(values))
            text_of = np.repeat(np.arange(n), counts)
            whole = np.unique(text_of[odd[code]])
            keep = ~np.isin(text_of, whole)
            raw = buf.tobytes()
            values = [v or b"" for v in values] + [array("I", self.library.encode(raw[offsets[t] : offsets[t + 1]].decode(), add_special_tokens=False).ids).tobytes() for t in whole.tolist()]
            text_of = np.concatenate((text_of[keep], whole))
            code = np.concatenate((code[keep], len(values) - len(whole) + np.arange(len(whole))))
            order = np.argsort(text_of, kind="stable")
            text_of, code = text_of[order], code[order]
            counts = np.bincount(text_of, minlength=n)
        if end_id is not None:
            code = np.insert(code, np.cumsum(counts), len(values))
            values = [*values, np.array([end_id], "<u4").tobytes()]
            counts = counts + 1
        pool = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        at = np.cumsum(size) - size
        length = size[code]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        ids = pool[np.repeat(at[code] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))]


def encoder(path: str, special_as_text: bool = False, memory: int = 500_000) -> Encoder:
    """One encoder for each worker process, file, treatment of special tokens and size of memory."""
    key = (path, special_as_text, memory)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text, memory)
    return _encoders[key]


# ---- patched frame of reference --------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values at `width` bits each, lowest bit first, each row to whole bytes. Eight values
    fill `width` bytes, so each of the eight places of such a group is shifted at once."""
    rows, n = values.shape
    groups = -(-n // 8)
    lanes = np.zeros((rows, groups * 8), np.uint64)
    lanes[:, :n] = values
    lanes = lanes.reshape(rows, groups, 8)
    out = np.zeros((rows, groups, width), np.uint8)
    for k in range(8):
        byte, bit = divmod(k * width, 8)
        moved = lanes[:, :, k] << np.uint64(bit)
        for j in range(-(-(bit + width) // 8)):
            out[:, :, byte + j] |= (moved >> np.uint64(8 * j)).astype(np.uint8)
    return out.reshape(rows, groups * width)[:, : (n * width + 7) // 8]


def _unpack(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n values of each row of bytes."""
    rows, groups = len(raw), -(-n // 8)
    full = np.zeros((rows, groups * width), np.uint8)
    full[:, : raw.shape[1]] = raw
    full = full.reshape(rows, groups, width)
    out = np.empty((rows, groups, 8), np.uint32)
    for k in range(8):
        byte, bit = divmod(k * width, 8)
        value = np.zeros((rows, groups), np.uint64)
        for j in range(-(-(bit + width) // 8)):
            value |= full[:, :, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, :, k] = (value >> np.uint64(bit)) & np.uint64((1 << width) - 1)
    return out.reshape(rows, groups * 8)[:, :n]


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> list[bytes]:
    """Blocks of one length, at most 65,535 ids, given as rows. Those of equal width are packed
    together."""
    n = ids.shape[1]
    low = ids.min(axis=1)
    values = (ids - low[:, None]).astype(np.uint32)
    rank = max(0, int(np.ceil(share * n)) - 1)
    need = np.partition(values, rank, axis=1)[:, rank]
    widths = np.where(need > 0, np.frexp(need.astype(np.float64))[1], 0)
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        limit = np.uint32((1 << width) - 1)
        body = _pack(np.minimum(values[own], limit), width) if width else np.zeros((len(own), 0), np.uint8)
        row, place = np.nonzero(values[own] > limit)
        cut = np.searchsorted(row, np.arange(len(own) + 1))
        odd = values[own[row], place].astype("<u4")
        place = place.astype("<u2")
        for k, b in enumerate(own.tolist()):
            s, e = cut[k], cut[k + 1]
            out[b] = struct.pack("<IBH", int(low[b]), width, e - s) + body[k].tobytes() + place[s:e].tobytes() + odd[s:e].tobytes()
    return out


def encode_block(ids: np.ndarray, share: float = 0.9) -> bytes:
    """One block of at most 65,535 ids."""
    return encode_blocks(np.asarray(ids, "<u4")[None, :], share)[0]


def decode_block(raw: bytes, n: int) -> np.ndarray:
    low, width, odd = struct.unpack_from("<IBH", raw)
    end = 7 + (n * width + 7) // 8
    values = _unpack(np.frombuffer(raw, np.uint8, end - 7, 7)[None, :], n, width)[0] if width else np.zeros(n, np.uint32)
    if odd:
        values[np.frombuffer(raw, "<u2", odd, end)] = np.frombuffer(raw, "<u4", odd, end + 2 * odd)
    return values + np.uint32(low)


def encode_segment(ids: np.ndarray, offsets: np.ndarray, block: int = 1024, share: float = 0.9) -> bytes:
    """A segment of the documents whose ids lie end to end in `ids`, beginning at `offsets`."""
    cut = len(ids) // block * block
    parts = encode_blocks(ids[:cut].reshape(-1, block), share) if cut else []
    if cut < len(ids):
        parts.append(encode_block(ids[cut:], share))
    index = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype("<u4")
    lengths = np.diff(offsets).astype("<u4")
    return struct.pack("<4sIIII", b"PFR1", len(lengths), len(ids), block, len(parts)) + lengths.tobytes() + index.tobytes() + b"".join(parts)


def _header(raw: bytes) -> tuple[int, int, int, int]:
    magic, *counts = struct.unpack_from("<4sIIII", raw)
    if magic != b"PFR1":
        raise ValueError("not a segment of this format")
    return tuple(counts)


def segment_lengths(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", _header(raw)[0], 20)


def _index(raw: bytes) -> tuple[np.ndarray, int]:
    """Where each block begins and the last one ends in the body, and where the body begins."""
    docs, _, _, count = _header(raw)
    at = 20 + 4 * docs
    return np.frombuffer(raw, "<u4", count + 1, at).astype(np.int64), at + 4 * (count + 1)


def read_block(raw: bytes, k: int) -> np.ndarray:
    """Block k of a segment, found through the index."""
    _, ids, block, count = _header(raw)
    if not 0 <= k < count:
        raise IndexError(k)
    index, body = _index(raw)
    return decode_block(raw[body + index[k] : body + index[k + 1]], min(block, ids - k * block))


def decode_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents end to end, and where each one's begin (n + 1 offsets). Full blocks
    of equal width are unpacked together."""
    _, n, block, count = _header(raw)
    index, body = _index(raw)
    data = np.frombuffer(raw, np.uint8)
    full = n // block
    out = np.empty(n, "<u4")
    at = body + index[:full]
    widths = data[at + 4]
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = (block * width + 7) // 8
        packed = data[at[own, None] + 7 + np.arange(size)]
        out[: full * block].reshape(full, block)[own] = _unpack(packed, block, width) if width else 0
    for k in range(full):
        low, width, odd = struct.unpack_from("<IBH", raw, at[k])
        own = out[k * block : (k + 1) * block]
        if odd:
            end = at[k] + 7 + (block * width + 7) // 8
            own[np.frombuffer(raw, "<u2", odd, end)] = np.frombuffer(raw, "<u4", odd, end + 2 * odd)
        own += np.uint32(low)
    for k in range(full, count):
        out[k * block :] = read_block(raw, k)
    return out, np.concatenate((np.zeros(1, np.int64), np.cumsum(segment_lengths(raw), dtype=np.int64)))


# ---- writing and reading ---------------------------------------------------------------

_FILE = "part int, before long, doc_ids binary, null_ids binary, n_ids long, payload binary"
_FILE_ARROW = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    block: int = 1024,
    share: float = 0.9,
    segment_bytes: int = 4 << 20,
    special_as_text: bool = False,
    range_bytes: int = 256 << 20,
) -> None:
    """Encode whole texts, append end_id to each, and write segments in ascending id order
    (null ids first, equal ids by a hash of the text). A task writes about range_bytes of text, also
    where one id, or none, holds many rows. Null and empty texts hold end_id alone. The string of a
    special token is that token, as the library has it, or text with `special_as_text`."""
    spark = session_ready(docs.sparkSession)
    if not 1 <= block <= 65_535:
        raise ValueError("a block holds 1 to 65,535 ids")

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for piece in blocks(batches, "_text", segment_bytes):
            tokens, offsets = encoder(tokenizer, special_as_text).encode(piece.column("_text"), end_id)
            ids = piece.column("_id")
            row = (part, before, ids.fill_null(0).to_numpy().astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), len(tokens), encode_segment(tokens, offsets, block, share))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _FILE_ARROW.types)], schema=_FILE_ARROW)
            before += len(tokens)

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    # rows of one id, or without one, are dealt by text, and copies of one by place
    order = ["_id", "_hash", "_row"]
    source = source.withColumn("_hash", F.xxhash64("_text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = source.repartitionByRange(ranges, *order).sortWithinPartitions("_id", "_hash", "_text")
    ordered.select("_id", "_text").mapInArrow(run, _FILE).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens,
    ids (binary: little-endian uint32)."""
    session_ready(spark)
    files = spark.read.schema(_FILE).parquet(path)
    # one number for each part of the write job, whatever the size of the input
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    begin, at = {}, 0
    for part, n in sizes:
        begin[part], at = at, at + n

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, offsets = decode_segment(row["payload"])
                first = begin[row["part"]] + row["before"] + offsets[:-1]
                null = np.frombuffer(row["null_ids"], np.uint8) > 0
                ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=null)
                own = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(first), pa.array(np.diff(offsets)), own], ["id", "start", "n_tokens", "ids"])

    return files.drop("n_ids").mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, **options) -> DataFrame:
    """Write the files to the shared scratch folder and read them back."""
    path = scratch_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, id_col, text_col, end_id, **options)
    return read_tokens(docs.sparkSession, path, id_col)
