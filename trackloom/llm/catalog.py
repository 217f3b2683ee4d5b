"""The operators as queries over the given tables, and the same results as SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import (
    extraction, hamming, infilling, language, lexical, mixing, neighbours, notices, packing, privacy, quality, secrets, similarity,
)
from trackloom.llm.common import table
from trackloom.llm.oracles import ORACLES as ORACLES
from trackloom.session import ship_package


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op2_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return language.identify(table(spark, sf_dir, "documents"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest sign codes of every vector whose id is divisible by 20."""
    return hamming.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each text being one version of its document."""
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    places, ledger = secrets.scan_versions(versions)
    return secrets.digest(secrets.findings(places, ledger)).withColumnRenamed("path", "doc_id")


def op6_join_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents and the number of links of each."""
    return similarity.join_near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return privacy.digest(privacy.find(table(spark, sf_dir, "documents")))


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_find_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices in all documents."""
    return notices.digest(notices.find_notices(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document rearranged for infilling."""
    return infilling.digests(infilling.store_frames(table(spark, sf_dir, "documents")))


def op13_rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package sent to the executors first, so that it runs from any folder."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_extract_main_text": op1_extract_main_text,
    "op2_identify_languages": op2_identify_languages,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_nearest_codes": op4_nearest_codes,
    "op5_scan_secrets": op5_scan_secrets,
    "op6_join_near_duplicates": op6_join_near_duplicates,
    "op7_mix_sources": op7_mix_sources,
    "op8_find_personal_data": op8_find_personal_data,
    "op9_pack_documents": op9_pack_documents,
    "op10_score_quality": op10_score_quality,
    "op11_find_license_notices": op11_find_license_notices,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_rank_documents": op13_rank_documents,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
