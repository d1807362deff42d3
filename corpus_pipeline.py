"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm import copies, decontam, mixing, pii, toxicity
from typeweave.llm.common import free_name, small_batches, table
from typeweave.llm.queries import PII_KEY, TOXIC_FROM, learned_labels
from typeweave.operators.fixpoint import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and empty texts stay, and all without labels to learn from."""
    small_batches(spark)
    model = toxicity.fit(docs, learned_labels(spark, sf_dir))
    if model.chars is None:
        return docs
    score = free_name("score", docs.columns)
    return toxicity.score_texts(docs, model, score=score).where(F.col(score) < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    SimHash links within two bits, over shingles of five words, come first; an exact search for what
    they miss follows.  All links are verified: a Jaccard similarity of 0.8 or more.
    """
    small_batches(spark)
    return copies.one_of_each(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows are told apart by key and text."""
    small_batches(spark)
    mark, other = free_name("mark", docs.columns), free_name("found_mark", docs.columns)
    marked = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
    found = decontam.contained_items(marked, table(spark, sf_dir, "benchmark"), key=mark).select(F.col("doc_id").alias(other)).distinct()
    found = written(found, "contaminated")
    return marked.join(found, F.col(mark) == F.col(other), "left_anti").select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and n_chars counted again."""
    columns = docs.columns
    return pii.replace_entities(docs, key=PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.pareto_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii surrogates", replace_personal_data),
    ("mixing", mix_sources),
]

#: Models and 64-bit hashes are beyond SQL; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
