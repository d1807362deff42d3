"""The corpus operators as registered queries: thin adapters over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm import decontam, hmm, langid, matroska, mixing, pii, simhash, tokens, toxicity, warc
from typeweave.llm.common import crc_mod, table

#: The key of surrogates in registered queries; a deployment passes its own secret.
PII_KEY = "typeweave-demo-key"
TOXIC_FROM = 0.3


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a unigram and a hidden Markov model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = hmm.train_and_score(docs, crc_mod("doc_id", 10) == 0)
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learned_labels(spark, sf_dir))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) such that the document contains the item."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced."""
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix takes of every document."""
    return mixing.pareto_mix(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's bytes and tokens."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary())


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as media, stored and read back."""
    return matroska.stored_texts(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate group."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from WARC archives."""
    pages = table(spark, sf_dir, "pages")
    index = warc.write_archives(pages, warc.archive_folder(pages))
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_scores": op1_hmm_scores,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_language_id": op5_language_id,
        "op6_mixing": op6_mixing,
        "op7_token_counts": op7_token_counts,
        "op8_matroska": op8_matroska,
        "op9_simhash": op9_simhash,
        "op10_warc": op10_warc,
        "pipeline": pipeline,
    }
