"""The queries over the corpus tables, one for each operator, and SQL for those that it can
express. Each gets its rows through its operator; only digests are derived here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, embeddings, langid, mixing, packing, pieces, pii, quality, rules, simhash, substrings, tokens, trie
from .common import documents, session_ready
from .oracle import ORACLE_SQL  # noqa: F401


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(mod: int, column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(mod))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    model = langid.train(docs.filter(~held))
    return langid.predict_language(docs, model, extra={"held_out": held})


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(documents(spark, sf_dir), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), _path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(_fold(5) == 0, F.lit(False))
    out = quality.score_quality(docs, quality_model(spark, sf_dir), extra={"held_out": held})
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(5) != 0).select("doc_id", "quality")
    return quality.train(documents(spark, sf_dir), labels)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_dedup(documents(spark, sf_dir), shingle=3, distance=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.round_trip(documents(spark, sf_dir), _path("byte_bpe_50k.json"), end_id=0)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    spans, base = F.col("pii"), F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_documents(documents(spark, sf_dir), _path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(session_ready(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dims=64, seed=2)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_substrings, op3_embeddings, op4_rules, op5_packing, op6_quality, op7_simhash, op8_mixing, op9_tokens, op10_pii, op11_pieces, op12_trie, op13_clusters, pipeline)}
