"""Quality classifier: supervised subword embeddings.

A text is the bag of its hashed words, pairs of neighbouring words and character n-grams of words
(a word's beginning and end are characters of their own). Each hash
bucket has a learned vector; a document is the mean of its features' vectors, and a softmax over
two classes reads the mean. Vectors and output are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled texts.

Averaging and the output layer are both linear, so after training every bucket's vector times
the output weights is one number, and scoring a text is a mean of numbers looked up for whole
batches of texts. They are stored as whole numbers, so a score doesn't depend on what else is in
a batch. A pair of equal neighbours always hashes to one bucket, which makes stuttering text
visible to the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BLOCK, blocks, mix, session_ready, span_hashes, utf8, word_spans

_U = np.uint64
GRAMS = (3, 5)
_ONE = 1 << 20  # fixed-point scale of the stored numbers


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int):
    """For each kind of feature: its buckets, and for each text where its own begin and end."""
    shift = _U(64 - (buckets.bit_length() - 1))
    place = lambda h: (h >> shift).astype(np.int32)
    starts, ends, first = word_spans(buf, offsets)
    words = span_hashes(buf, starts, ends)
    yield place(words), first[:-1], first[1:]
    if len(words) > 1:
        pairs = mix(words[1:] ^ words[:-1])  # equal neighbours: mix(0)
        begin = np.minimum(first[:-1], len(pairs))
        yield place(pairs), begin, np.maximum(begin, first[1:] - 1)
    # code points, with a space around each text, so that every word stands between two
    n_texts = len(offsets) - 1
    spaced = np.full(len(buf) + 2 * n_texts, 32, np.uint8)
    at = np.repeat(2 * np.arange(n_texts) + 1, np.diff(offsets)) + np.arange(len(buf))
    spaced[at] = buf
    lead = (spaced & 0xC0) != 0x80
    cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(lead)))[offsets + 2 * np.arange(n_texts + 1)]
    chars = np.frombuffer(spaced.tobytes().decode().encode("utf-32-le"), "<u4")
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    spaces = np.concatenate((np.zeros(1, np.int32), np.cumsum(space, dtype=np.int32)))
    chars = np.where(space, np.uint32(32), chars)
    for n in GRAMS:
        if len(chars) >= n:
            h = np.zeros(len(chars) - n + 1, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + chars[j : j + len(h)]
            # of one word: no space but at the ends
            inside = np.flatnonzero(spaces[n - 1 : n - 1 + len(h)] == spaces[1 : 1 + len(h)])
            h = h[inside]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            own = np.searchsorted(inside, cut)
            yield (h >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32), own[:-1], own[1:]


@dataclass
class Model:
    table: np.ndarray  # int64, one fixed-point number for each bucket
    bias: float

    def scores(self, column) -> np.ndarray:
        """The probability of class 1 for each text."""
        buf, offsets = utf8(column)
        total, count = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        for ids, a, b in features(buf, offsets, len(self.table)):
            run = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.table[ids])))
            total += run[b] - run[a]
            count += b - a
        z = total / (_ONE * np.maximum(count, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_embeddings(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, buckets: int, dims: int = 8, epochs: int = 5, steps: int = 12_000, rate: float = 4.0, seed: int = 3) -> Model:
    """bags: each text's buckets and their shares of its features (shares sum to 1). A small sample
    is gone through more often than `epochs` times, for `steps` steps."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims))
    out, bias = np.zeros((dims, 2)), np.zeros(2)
    out[:, 1] = rng.uniform(-1 / dims, 1 / dims, dims)
    epochs = max(epochs, -(-steps // len(bags)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k][0], bags[k][1].astype(np.float64)
            mean = share @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1  # gradient of the softmax loss
            step = rate * (1 - done / steps) * weight[k]
            back = out @ p
            out -= 0.05 * step * np.outer(mean, p)
            bias -= 0.05 * step * p
            vectors[ids] -= step * share[:, None] * back[None, :]
            done += 1
    score = vectors @ (out[:, 1] - out[:, 0])
    return Model(np.rint(score * _ONE).astype(np.int64), float(bias[1] - bias[0]))


def _views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """Each value of a binary column as an array over the column's own memory: the driver holds the
    sample once."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        size = np.dtype(kind).itemsize
        out += [np.frombuffer(data, kind, (b - a) // size, a) if b > a else np.zeros(0, kind) for a, b in zip(ends[:-1], ends[1:])]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, buckets: int = 1 << 17, steps: int = 12_000, seed: int = 3) -> Model:
    """A model from the documents that `labels` (id_col, label_col) marks 0 or 1, at most per_class
    of each label, chosen by a seeded hash of the id; they are weighted so that the classes keep
    the shares that they have among all labels. An id with both labels counts as 0; null ids and
    other labels don't count. Without both labels, the score is near the one label there is (0.5
    without any). steps is the least number of gradient steps. The sample is drawn from the labels, so only its ids meet the documents, and
    only the features of one text for each of them (the one with the smallest hash, where rows repeat
    an id) come to the driver: at most 3 * per_class rows."""
    session_ready(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.zeros(buckets, np.int64), {0: -4.0, 1: 4.0}[next(iter(counts))] if counts else 0.0)
    place = F.xxhash64(F.lit(seed), F.col("_id")).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    share = F.coalesce(*[F.when(F.col("_label") == k, F.lit(min(1.0, 1.2 * per_class / n))) for k, n in counts.items()])
    chosen = known.withColumn("_place", place).filter(F.col("_place") < share).orderBy("_place", "_id").limit(3 * per_class)  # so that its size is bounded, and no rerun takes others
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # one text for each id, however many rows have it: no more rows than ids reach the driver
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label", "_place").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text")).drop("_id")

    def run(batches):
        for block in blocks(batches, "_text", SMALL_BLOCK):
            buf, offsets = utf8(block.column("_text"))
            parts = list(features(buf, offsets, buckets))
            ids, shares = [], []
            for d in range(block.num_rows):
                own, n = np.unique(np.concatenate([x[a[d] : b[d]] for x, a, b in parts] or [np.zeros(0, np.int32)]), return_counts=True)
                ids.append(own.astype("<i4").tobytes())
                shares.append((n / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([block.column("_label"), block.column("_place"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["label", "place", "ids", "shares"])

    rows = sample.mapInArrow(run, "label int, place double, ids binary, shares binary").toArrow()
    label, views = rows.column("label").to_numpy(), [_views(rows.column(c), kind) for c, kind in (("ids", "<i4"), ("shares", "<f4"))]
    order = np.lexsort((rows.column("place").to_numpy(), label))
    bags, y, weight = [], [], []
    for k in (0, 1):
        own = order[label[order] == k][:per_class].tolist()
        bags += [(views[0][i], views[1][i]) for i in own]
        y += [k] * len(own)
        weight += [counts[k] / sum(counts.values()) / max(1, len(own))] * len(own)
    weight = np.asarray(weight) * len(weight)
    return fit_embeddings(bags, np.asarray(y), weight, buckets, steps=steps, seed=seed)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, the columns of `extra`, and score (0 to 1: the probability of
    label 1). Null and empty texts have no features and get the model's base score. Repeated
    rows and null ids each get their row. Other columns are ignored."""
    spark = session_ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # one number for each bucket

    def run(batches):
        for block in blocks(batches, "_text", SMALL_BLOCK):
            keep = [k for k in range(block.num_columns) if block.schema.names[k] != "_text"]
            scores = pa.array(shared.value.scores(block.column("_text")))
            yield pa.RecordBatch.from_arrays([block.column(k) for k in keep] + [scores], [block.schema.names[k] for k in keep] + ["score"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), *[c.alias(k) for k, c in (extra or {}).items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, schema + ", score double").withColumnRenamed("_id", id_col)


def filter_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score is at least `threshold`, with all their columns."""
    spark = session_ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, text_col, SMALL_BLOCK):
            yield block.filter(pa.array(shared.value.scores(block.column(text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
