"""Registered queries of the corpus operators: each runs over its whole table and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitrace.llm import oracles
from orbitrace.llm.centroid_clusters import cluster_vectors
from orbitrace.llm.fingerprints import fingerprint_documents
from orbitrace.llm.language_id import identify_languages
from orbitrace.llm.line_dedup import drop_repeated_lines
from orbitrace.llm.ngram_join import similarity_classes
from orbitrace.llm.packing import pack_documents
from orbitrace.llm.pii import find_personal_data
from orbitrace.llm.quality_rules import apply_policy, ledger
from orbitrace.llm.sentencepiece_codec import encode_documents
from orbitrace.llm.sharding import shard_documents
from orbitrace.llm.source_divergence import audit_sources
from orbitrace.llm.token_counts import count_tokens
from orbitrace.llm.warc import derivatives, responses


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(_documents(spark, sf_dir), _tokenizer(), capacity=1024, end_id=2)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every text and of its edited text."""
    return fingerprint_documents(_documents(spark, sf_dir))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces by Viterbi, and decoded again."""
    return encode_documents(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity class and link count of every document: five-word shingles, Jaccard of 0.8 or more."""
    return similarity_classes(_documents(spark, sf_dir), threshold=0.8, width=5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: plain spans, and those that deobfuscation adds."""
    return find_personal_data(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of every document, with the base rules' and the current policy's verdicts."""
    return apply_policy(ledger(_documents(spark, sf_dir)), "v1")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of near equal bytes."""
    return shard_documents(_documents(spark, sf_dir), shards=24)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return identify_languages(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and whether it is over 512 tokens."""
    return count_tokens(_documents(spark, sf_dir), _tokenizer(), limit=512)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds over eight centroids."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, seed=3)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every two sources of a language are apart, and each source's most overrepresented terms."""
    return audit_sources(_documents(spark, sf_dir), least_docs=30, top=50)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents or more share, but for each line's last document."""
    return drop_repeated_lines(_documents(spark, sf_dir), least_docs=5, least_chars=40)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_fingerprints, op3_pii, op4_quality_rules, op5_sharding, op6_warc_derivatives, op7_sentencepiece,
        op8_ngram_jaccard_join, op9_language_id, op10_token_counts, op11_centroid_clusters, op12_source_divergence, op13_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": oracles.OP4, "op11_centroid_clusters": oracles.OP11, "op12_source_divergence": oracles.OP12, "op13_line_dedup": oracles.OP13,
}
