"""Caches of costly lookups, and documents of finished types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest generation of a cache; empty if there is none or it cannot be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def cached(keys: DataFrame, key: str, path: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values of all keys: known ones from the cache, others computed and appended as files of their own.

    Appending leaves earlier files alone, so a lost job costs what it was adding.
    """
    known = read_cache(keys.sparkSession, path, schema)
    missing = keys.select(key).distinct().join(known.select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return keys.select(key).distinct().join(read_cache(keys.sparkSession, path, schema), key)


def type_documents(types: DataFrame) -> DataFrame:
    """(goff, document): a YAML document of each struct, union and enumeration, members in order.

    members must be array<struct<offset, name, text>>, text in notation; enumerators array<struct<name, value>>.
    """
    member = F.transform("members", lambda m: F.concat(F.lit("  - [ "), m["offset"].cast("string"), F.lit(", "), F.coalesce(m["name"], F.lit("null")), F.lit(", "), m["text"], F.lit(" ]\n")))
    value = F.transform("enumerators", lambda e: F.concat(F.lit("  "), e["name"], F.lit(": "), e["value"].cast("string"), F.lit("\n")))
    head = F.concat(F.lit("kind: "), F.col("kind"), F.lit("\nname: "), F.coalesce("name", F.lit("null")), F.lit("\nsize: "), F.coalesce(F.col("byte_size").cast("string"), F.lit("null")), F.lit("\n"))
    body = F.when(F.col("kind") == "enum", F.concat(F.lit("values:\n"), F.array_join(value, ""))).otherwise(F.concat(F.lit("members:\n"), F.array_join(member, "")))
    return types.select("goff", F.concat(head, F.coalesce(body, F.lit(""))).alias("document"))
