"""What a step of the pipeline takes, and leaves, in a worker that later stages use again."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from movelines.llm import neardup, packing, quality, tokens

MB = 1 << 20


def _texts(n_bytes: int) -> list[str]:
    rng, out = random.Random(5), []
    while sum(map(len, out)) < n_bytes:
        out.append(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)))
    return out


def _peak(run) -> float:
    tracemalloc.start()
    try:
        for _ in run:
            pass
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_sketches_take_little_memory():
    texts = _texts(2 * MB)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["row", "text_hash", "text"])
    assert _peak(neardup._sketches(5)([batch])) < 8  # MB; 12 with blocks of a megabyte


def test_quality_filter_takes_little_memory(spark):
    model = quality.Model(np.zeros(1 << 17, np.int64), 0.0)
    docs = SimpleNamespace(sparkSession=spark, schema=None, mapInArrow=lambda run, schema: run)
    batch = pa.RecordBatch.from_arrays([pa.array(_texts(2 * MB))], ["text"])
    assert _peak(quality.filter_quality(docs, model)([batch])) < 40  # MB; 70 with blocks of a megabyte


def test_packing_remembers_few_chunks(spark, monkeypatch):
    """520,000 different words pass through one worker, of which its memory keeps the latest."""
    steps, docs = [], spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(tokens, "_encoders", {})
    monkeypatch.setattr(type(docs.groupBy("doc_id")), "applyInArrow", lambda self, run, schema: steps.append(run) or docs)
    packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    words = [np.base_repr(k, 36).lower() for k in random.Random(6).sample(range(10**6, 10**8), 520_000)]
    for k in range(0, len(words), 40_000):
        text = " ".join(words[k : k + 40_000])
        assert sum(steps[0](pa.table({"group": [0], "_id": [k], "_text": [text]})).column("length").to_pylist()) > 40_000
    assert sum(len(e.young) + len(e.old) for e in tokens._encoders.values()) < 500_000
