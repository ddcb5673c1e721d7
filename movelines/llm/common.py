"""What the corpus operators share: session set-up, shared scratch tables, and word
splitting and hashing over whole Arrow string columns."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import materialise, scratch_dir  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])

#: The characters that separate words everywhere in this subpackage: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def session_ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, parts)])
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


# ---- words of many texts at once -------------------------------------------------------

#: Bytes of text in a block where a byte of it becomes tens of bytes of arrays. A worker keeps much of what a
#: block took, and workers stay for the stages that follow.
SMALL_BLOCK = 1 << 18

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (n + 1 offsets). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, text: str, limit: int = 1 << 20):
    """Split record batches into slices of about `limit` bytes of text, to bound memory."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and each text's first word (n + 1)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before[inner] = True
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the public-domain splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _tables(len(buf))
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * power[: len(buf)], dtype=_U, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
