"""What the corpus operators share: table access, word rules, batches of sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.sources.package import ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a Python worker is handed at once in the pipeline.
TEXTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Let Arrow hand Python workers so many rows at once, at most; a smaller number that is set already stays.

    Spark's 10,000 whole texts are held several times over: by the JVM outside
    its heap, and by every worker of an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's decimal text (null: of the empty text, which is 0), modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8; bytes.lower and bytes.split know ASCII only."""
    return text.encode().lower().split() if text else []


def time_major(order: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that bring flat sequences into time-major order, and where each time step begins.

    `order` lists the sequences by falling length; step t holds the t-th item of
    every sequence longer than t, in that order, without padding.
    """
    lens = lengths[order]
    longest = int(lens[0]) if len(lens) else 0
    alive = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right")  # sequences of length > t
    begins = np.concatenate([[0], np.cumsum(alive)])
    total = int(begins[-1])
    step = np.repeat(np.arange(longest), alive)
    rank = np.arange(total) - begins[step]
    return starts[order][rank] + step, begins
