"""Language identification with string kernels.

A text is the set of its character n-grams of lengths 1 to `top` (the blended spectrum, each
n-gram present or absent), hashed into `buckets` places. The kernel of two texts is the number
of common places over the geometric mean of their numbers of places. A Nyström map over a few
landmark texts of each language makes the kernel finite, and one-versus-rest ridge regression in
that space gives a score for each language. Scoring is two matrix products for a batch of texts:
presence bits by landmarks, then kernel values by dual weights.

Training sees at most `per_language` distinct labelled texts of each language and at most `landmarks` of
them as landmarks, chosen by a seeded hash, and of all languages together at most `texts_limit`
and `landmark_limit` (or one a language); these bounds are parameters. Every language is learned,
however many there are. Only the packed presence bits of the chosen texts come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, session_ready

_U32 = np.uint32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x32000) if chr(c).isalpha()]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def presence(text: str, buckets: int, top: int) -> np.ndarray:
    """One flag for each bucket; white space of any length counts as one space."""
    flags = np.zeros(buckets, np.uint8)
    text = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    gram = np.zeros(len(c), _U32)
    shift = 32 - (buckets.bit_length() - 1)
    for n in range(1, top + 1):
        if len(c) < n:
            break
        gram = gram[: len(c) - n + 1] * _U32(0x01000193) + c[n - 1 :] + _U32(n)
        flags[(gram * _U32(0x9E3779B1)) >> _U32(shift)] = 1
    return flags


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # m x buckets, 0 or 1
    weights: np.ndarray  # m x languages
    bias: np.ndarray
    buckets: int
    top: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _kernel(x, self.landmarks) @ self.weights + self.bias

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], np.ndarray]:
        names, values = ["und"] * len(texts), np.zeros(len(texts))
        todo = [k for k, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for s in range(0, len(todo), batch):
            own = todo[s : s + batch]
            z = self.scores(np.stack([presence(texts[k], self.buckets, self.top) for k in own]))
            best = z.argmax(axis=1)
            for k, b, v in zip(own, best.tolist(), z[np.arange(len(own)), best]):
                names[k], values[k] = self.langs[b], min(1.0, max(0.0, (v + 1) / 2))
        return names, values


def _kernel(x: np.ndarray, landmarks: np.ndarray, at_once: int = 512) -> np.ndarray:
    right, own = landmarks.T.astype(np.float32), np.maximum(landmarks.sum(axis=1, dtype=np.float64), 1)
    out = np.empty((len(x), len(landmarks)))
    for s in range(0, len(x), at_once):
        rows = x[s : s + at_once].astype(np.float32)
        common = (rows @ right).astype(np.float64)  # whole numbers, exact
        out[s : s + at_once] = common / np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.float64), 1)[:, None] * own[None, :])
    return out


def fit_kernel(x: np.ndarray, y: np.ndarray, langs: list[str], chosen: np.ndarray, buckets: int, top: int, ridge: float = 1e-3) -> Model:
    """x: presence rows; y: each row's place in langs; chosen: the landmark rows."""
    landmarks = x[chosen]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = _kernel(x, landmarks) @ root
    goal = np.where(y[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    # each language weighs the same, however many rows it has
    w = (1.0 / np.bincount(y, minlength=len(langs)))[y] * len(y) / len(langs)
    total = w.sum()
    mean, bias = (w @ z) / total, (w @ goal) / total
    zc, gc = z - mean, goal - bias
    a = np.linalg.solve((zc * w[:, None]).T @ zc + ridge * len(y) * np.eye(z.shape[1]), (zc * w[:, None]).T @ gc)
    return Model(langs, landmarks, root @ a, bias - mean @ a, buckets, top)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
    landmarks: int = 40,
    texts_limit: int = 6000,
    landmark_limit: int = 1024,
    buckets: int = 1 << 14,
    top: int = 3,
    seed: int = 5,
) -> Model:
    """A model from the rows of `labelled` with a language and a letter in the text. Each text
    counts twice: whole, and as eight words from its middle, so that short texts are known too.
    Where there are so many languages that the two limits bind, each has an equal part of them, and
    one text at least. No usable row: a model that says `und`."""
    spark = session_ready(labelled.sparkSession)
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    place = F.xxhash64(F.lit(seed), F.col(text_col)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    usable = usable.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), place.alias("_place"))
    # a text that repeats in a language counts once
    distinct = usable.groupBy("_lang", "_place").agg(F.lit(1)).groupBy("_lang").agg(F.count("*").alias("n"), F.min("_place").alias("least"))
    counts = sorted((r["_lang"], r["n"], r["least"]) for r in distinct.collect())  # one row for each class of the model
    if not counts:
        return Model([], np.zeros((0, buckets), np.uint8), np.zeros((0, 0)), np.zeros(0), buckets, top)
    langs = [name for name, _, _ in counts]
    per_language = max(1, min(per_language, texts_limit // len(langs)))
    landmarks = max(1, min(landmarks, landmark_limit // len(langs)))
    # twice the share that is wanted of each language and its first text at least, cut to the
    # bound in order of the hash
    shares = [(name, max(min(1.0, 2.0 * per_language / n), math.nextafter(least, 2.0))) for name, n, least in counts]
    shares = spark.createDataFrame(shares, "_lang string, _share double")
    sample = usable.join(F.broadcast(shares), "_lang").filter(F.col("_place") < F.col("_share")).groupBy("_lang", "_place").agg(F.first("_text").alias("_text"))
    order = Window.partitionBy("_lang").orderBy("_place")
    sample = sample.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language).select("_text", "_lang", "_place")

    def run(batches):
        for block in blocks(batches, "_text"):
            bits = []
            for text in block.column("_text").to_pylist():
                words = text.split()
                at = max(0, len(words) // 2 - 4)
                both = [presence(text, buckets, top), presence(" ".join(words[at : at + 8]), buckets, top)]
                bits.append(np.packbits(np.stack(both), axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([block.column("_lang"), block.column("_place"), pa.array(bits, pa.binary())], ["lang", "place", "bits"])

    rows = sample.mapInArrow(run, "lang string, place double, bits binary").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    xs, ys, chosen = [], [], []
    for k, name in enumerate(langs):
        own = rows.filter(pa.compute.equal(rows.column("lang"), name)).column("bits").to_pylist()
        for j, raw in enumerate(own):
            if j < landmarks:
                chosen.append(len(xs))
            xs += list(np.unpackbits(np.frombuffer(raw, np.uint8).reshape(2, -1), axis=1))
            ys += [k, k]
    return fit_kernel(np.stack(xs), np.asarray(ys), langs, np.asarray(chosen), buckets, top)


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, the columns of `extra`, lang_pred and score (0 to 1).

    A text that is null or has no letter is `und` with score 0. Whole texts count, whatever
    their length. Repeated rows and null ids each get their row. Other columns are ignored.
    """
    spark = session_ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded: landmarks x languages x buckets

    def run(batches):
        for block in blocks(batches, "_text"):
            names, values = shared.value.predict(block.column("_text").to_pylist())
            keep = [k for k in range(block.num_columns) if block.schema.names[k] != "_text"]
            yield pa.RecordBatch.from_arrays([block.column(k) for k in keep] + [pa.array(names, pa.string()), pa.array(values)], [block.schema.names[k] for k in keep] + ["lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), *[c.alias(k) for k, c in (extra or {}).items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, schema + ", lang_pred string, score double").withColumnRenamed("_id", id_col)
