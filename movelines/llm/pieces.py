"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at each place the longest prefix that
the map's double-array trie holds gives way to its replacement, any other character stays; the
place of origin of every normalised byte is recorded. The normalised texts of a block are cut
into chunks before each run of space marks, which no piece crosses. The library encodes the
distinct chunks (with a copy of the model whose normaliser does nothing), a worker remembers
their ids, and each piece goes back through the recorded places to its span of original bytes.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, session_ready, utf8

_MARK = np.frombuffer("▁".encode(), np.uint8)
_BAD = np.frombuffer("�".encode(), np.uint8)
_LONGEST = 256  # bytes of a chunk that is remembered


class CharMap:
    """A compiled character map: the size of a double-array trie, its 32-bit units, and the
    replacements, each ended by a zero byte. A unit holds a label (its low byte), a flag that a
    value follows (bit 8), and the offset of its children (from bit 10, eight bits further if bit 9
    is set); a unit with bit 31 is a value."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64) if blob else np.zeros(0, np.int64)
        self.texts = blob[4 + size :]

    @staticmethod
    def _children(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, buf: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of `at` (its text ends at `limit`) the length of the longest prefix that
        the map holds, 0 if none, and its replacement's place. All places go down the trie at once."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.units):
            return length, value
        live, node, k = np.arange(len(at)), np.full(len(at), self._children(self.units[0])), 0
        while len(live):
            inside = at[live] + k < limit[live]
            live, node = live[inside], node[inside]
            label = buf[at[live] + k].astype(np.int64)
            unit = self.units[np.minimum(node ^ label, len(self.units) - 1)]
            found = (unit & 0x800000FF) == label
            live, unit, node, k = live[found], unit[found], (node ^ label)[found] ^ self._children(unit[found]), k + 1
            ends = (unit >> 8) & 1 == 1
            length[live[ends]], value[live[ends]] = k, self.units[node[ends]] & 0x7FFFFFFF
        return length, value

    def replacement(self, value: int) -> np.ndarray:
        return np.frombuffer(self.texts[value : self.texts.index(b"\0", value)], np.uint8)


def _greedy(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the matches, in order of place, reading from the left takes."""
    end, keep = start + length, np.ones(len(start), bool)
    if len(start) > 1 and (start[1:] < end[:-1]).any():
        upto = 0
        for k, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
            keep[k] = s >= upto
            upto = e if keep[k] else upto
    return keep


class Normaliser:
    def __init__(self, charmap: bytes, prefix: bool, trim: bool, escape: bool):
        self.map, self.prefix, self.trim, self.escape = CharMap(charmap), prefix, trim, escape

    def _replaced(self, buf: np.ndarray, offsets: np.ndarray):
        """Bytes with the map's and malformed bytes' replacements, where each comes from, which
        begin a replaced or kept unit, and the texts' offsets."""
        lead = (buf & 0xC0) != 0x80
        odd = np.zeros(len(buf), bool)
        try:
            buf.tobytes().decode()
        except UnicodeDecodeError:  # each malformed byte is a unit of its own
            at = 0
            for c in buf.tobytes().decode("utf-8", "surrogateescape"):
                odd[at] = bad = "\udc80" <= c <= "\udcff"
                at += 1 if bad else len(c.encode())
        lead |= odd
        at = np.flatnonzero(lead)
        length, value = self.map.longest(buf, at, offsets[np.searchsorted(offsets, at, side="right")])
        malformed = odd[at] & (length == 0)
        length[malformed], value[malformed] = 1, -1
        hit = length > 0
        start, length, value = at[hit], length[hit], value[hit]
        keep = _greedy(start, length)
        start, length, value = start[keep], length[keep], value[keep]
        origin = np.maximum.accumulate(np.where(lead, np.arange(len(buf)), 0)) if len(buf) else np.zeros(0, np.int64)
        if not len(start):
            return buf, origin, lead, offsets
        size = np.ones(len(buf), np.int64)
        inner = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        size[inner] = 0
        origin[inner] = np.repeat(start, length)
        kinds, which = np.unique(value, return_inverse=True)
        texts = [_BAD if v < 0 else self.map.replacement(v) for v in kinds.tolist()]
        size[start] = np.array([len(t) for t in texts])[which]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        out, first = np.repeat(buf, size), np.repeat(lead, size)
        for k, text in enumerate(texts):
            if len(text):
                own = upto[start[which == k]]
                out[own[:, None] + np.arange(len(text))] = text
                first[own[:, None] + np.arange(len(text))] = np.arange(len(text)) == 0
        return out, np.repeat(origin, size), first, upto[offsets]

    def _trimmed(self, buf, origin, first, offsets, ends):
        """Without spaces at the beginning and end of a text, and after another space. A unit's own
        inner spaces stay, as in the library. Changes `ends` where a text's end goes."""
        space = buf == 32
        at = np.arange(len(buf))
        unit = np.maximum.accumulate(np.where(first, at, 0))
        other = np.concatenate((np.zeros(1, np.int64), np.cumsum(~space)))
        leading = space & (other[at] == other[unit])  # spaces that begin a unit
        text_start = np.zeros(len(buf) + 1, bool)
        text_start[offsets] = True
        before = np.concatenate((np.ones(1, bool), space[:-1])) | text_start[:-1]
        keep = ~(leading & before[unit])
        # spaces at the end of a text
        for t in np.flatnonzero(offsets[1:] > offsets[:-1]).tolist():
            a, b = offsets[t], offsets[t + 1]
            e = b
            while e > a and space[e - 1]:
                e -= 1
            cut = np.flatnonzero(keep[e:b])
            if len(cut):
                ends[t] = origin[e + cut[0]]
                keep[e:b] = False
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
        return buf[keep], origin[keep], upto[offsets]

    def __call__(self, buf: np.ndarray, offsets: np.ndarray):
        """Normalised bytes of all texts end to end, their offsets (n + 1), the original byte that
        each comes from, and the original byte at which each text's pieces end."""
        ends = offsets[1:].copy()
        buf, origin, first, offsets = self._replaced(buf, offsets)
        if self.trim and len(buf):
            buf, origin, offsets = self._trimmed(buf, origin, first, offsets, ends)
        size = np.ones(len(buf), np.int64)
        spaces = np.flatnonzero(buf == 32) if self.escape else np.zeros(0, np.int64)
        size[spaces] = 3
        begin = offsets[:-1][offsets[1:] > offsets[:-1]] if self.prefix else np.zeros(0, np.int64)
        mark = _MARK if self.escape else np.full(1, 32, np.uint8)
        size[begin] += len(mark)
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        out = np.repeat(buf, size)
        own = upto[spaces + 1] - 3
        out[own[:, None] + np.arange(3)] = _MARK
        out[upto[begin][:, None] + np.arange(len(mark))] = mark
        return out, upto[offsets], np.repeat(origin, size), ends


class Pieces:
    """The library with a memory of chunks and the spans of pieces. When the young half of the
    memory is full it becomes the old half, from which chunks still in use come back."""

    def __init__(self, path: str, memory: int = 400_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with symbols of the user's own or spaces as suffixes aren't supported")
        spec = model.normalizer_spec
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [p.piece for p in model.pieces]
        self.bytes_of = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        # whole texts are chunks where a piece crosses the border before a mark
        self.whole = not spec.escape_whitespaces or any(re.search("[^▁]▁", n) for n in names)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.memory = memory

    def _values(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each distinct chunk."""
        if len(self.young) > self.memory:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, keys))
        missing = []
        for k in [k for k, v in enumerate(out) if v is None]:
            if (known := self.old.get(keys[k])) is not None:
                out[k] = self.young[keys[k]] = known
            else:
                missing.append(k)
        for k, ids in zip(missing, self.plain.encode([keys[k].decode() for k in missing], out_type=int, num_threads=1) if missing else ()):
            out[k] = array("i", ids).tobytes()
            if len(keys[k]) <= _LONGEST:
                self.young[keys[k]] = out[k]
        return out

    def encode(self, column: pa.Array | pa.ChunkedArray):
        """For all texts end to end: ids, where each piece begins and ends in the bytes of its own
        text, where each text's pieces begin (n + 1 offsets), and the texts decoded. The end id
        closes each text, at the place where its pieces end. A null is an empty text."""
        buf, source = utf8(column)
        n = len(source) - 1
        norm, offsets, origin, ends = self.normalise(buf, source)
        begin = np.zeros(len(norm), bool)
        if not self.whole and len(norm) > 2:
            mark = np.zeros(len(norm), bool)
            mark[:-2] = (norm[:-2] == _MARK[0]) & (norm[1:-1] == _MARK[1]) & (norm[2:] == _MARK[2])
            begin = mark.copy()
            begin[3:] &= ~mark[:-3]
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(begin)
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(norm))), pa.py_buffer(np.ascontiguousarray(norm))])
        coded = spans.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        keys = coded.dictionary.to_pylist()
        values = [*self._values(keys), array("i", [self.end]).tobytes()]
        first = np.searchsorted(starts, offsets)
        # the end id is one more chunk of each text, without bytes
        text_of = np.concatenate((np.repeat(np.arange(n), np.diff(first)), np.arange(n)))
        order = np.argsort(text_of, kind="stable")
        code = np.concatenate((code, np.full(n, len(values) - 1)))[order]
        count = np.fromiter(map(len, values), np.int64, len(values)) // 4
        at = np.cumsum(count) - count
        length = count[code]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        pool = np.frombuffer(b"".join(values), "<i4")
        size = self.bytes_of[pool]
        size[-1] = 0
        for k in np.unique(np.searchsorted(at, np.flatnonzero(pool[:-1] == self.unknown), side="right") - 1).tolist():
            size[at[k] : at[k] + count[k]] = [len(p.encode()) for p in self.plain.encode(keys[k].decode(), out_type=str)]
        pick = np.repeat(at[code] - upto[:-1], length) + np.arange(upto[-1])
        ids, size = pool[pick], size[pick]
        chunks = np.diff(first) + 1
        pieces = upto[np.concatenate((np.zeros(1, np.int64), np.cumsum(chunks)))]
        place = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        own = np.repeat(np.arange(n), np.diff(pieces))
        origin = np.append(origin, 0)
        where = lambda k: np.where(k < offsets[own + 1], origin[np.minimum(k, len(origin) - 1)], ends[own]) - source[own]
        decoded = self.library.decode([ids[a:b].tolist() for a, b in zip(pieces[:-1], pieces[1:])], num_threads=1)
        return ids, where(place[:-1]), where(place[1:]), pieces, decoded


_workers: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker process and model."""
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: id, ids (with the model's end id), begins and ends (each piece's span
    in the bytes of the text as it stands), decoded (the text that the ids decode to). Exactly what
    the library gives, whole texts.

    Null and empty texts hold the end id alone and decode to nothing. A byte piece other than the
    last of its character spans nothing, the last one the character. Malformed bytes count as U+FFFD,
    one by one. Rows with a null or repeated id are encoded like any other. Other columns are ignored.
    """

    def run(batches):
        worker = pieces(model)
        for part in blocks(batches, "_text", block_bytes):
            ids, begins, ends, first, decoded = worker.encode(part.column("_text"))
            cut = pa.array(first, pa.int32())
            columns = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *columns, pa.array(decoded, pa.string())], ["id", "ids", "begins", "ends", "decoded"])

    session_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, "id long, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)
