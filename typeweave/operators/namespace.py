"""Namespaces of entries in a tree of debug information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.functions.names import SEG, contains_anonymous, cpp_source, split_namespace
from typeweave.operators.fixpoint import checkpointed

# Tags of entries that are types.
TYPE_TAGS = [
    "structure_type", "class_type", "union_type", "enumeration_type", "unspecified_type", "typedef", "pointer_type", "reference_type", "rvalue_reference_type",
    "array_type", "const_type", "volatile_type", "restrict_type", "subroutine_type", "ptr_to_member_type", "base_type",
]


def paths(die: DataFrame) -> DataFrame:
    """(cu_offset, goff, qualifier, namespace) for every entry, from the root down, a level a round.

    Types and functions add to the qualifier of what is inside them, namespaces to
    both; other entries pass both on.
    """
    named = lambda kind, text: F.struct(F.lit(kind).alias("k"), F.col("goff").alias("goff"), text.alias("s"), F.lit(False).alias("linkage"))
    function = F.struct(F.lit("subprogram").alias("k"), F.col("goff").alias("goff"), F.coalesce("linkage_name", "name", F.lit("anonymous")).alias("s"), F.col("linkage_name").isNotNull().alias("linkage"))
    nothing = F.struct(F.lit("anonymous").alias("k"), F.lit(None).cast("bigint").alias("goff"), F.lit(None).cast("string").alias("s"), F.lit(False).alias("linkage"))
    space = F.struct(F.lit("name").alias("k"), F.lit(None).cast("bigint").alias("goff"), F.col("name").alias("s"), F.lit(False).alias("linkage"))
    is_type, is_space = F.col("tag").isin(*TYPE_TAGS), F.col("tag") == "namespace"
    own = (
        F.when((is_type | is_space) & F.col("name").isNull(), F.array(nothing))
        .when(is_type, F.array(named("type", F.col("name"))))
        .when(is_space, F.array(space))
        .when(F.col("tag") == "subprogram", F.array(function))
        .otherwise(F.array().cast(f"array<{SEG}>"))
    )
    nodes = checkpointed(die.select("cu_offset", "goff", "parent", "depth", own.cast(f"array<{SEG}>").alias("own"), is_space.alias("space")))
    empty = F.array().cast(f"array<{SEG}>")
    level = nodes.join(nodes.select(F.col("goff").alias("p")), F.col("parent") == F.col("p"), "left_anti").select("cu_offset", "goff", empty.alias("qualifier"), empty.alias("namespace"), "own", "space")
    out = None
    while True:
        level = checkpointed(level)
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        above = level.select(
            F.col("goff").alias("p"), F.concat("qualifier", "own").alias("q"), F.when(F.col("space"), F.concat("namespace", "own")).otherwise(F.col("namespace")).alias("n")
        )
        level = nodes.join(above, F.col("parent") == F.col("p")).select("cu_offset", "goff", F.col("q").alias("qualifier"), F.col("n").alias("namespace"), "own", "space")
    return (out if out is not None else level).select("cu_offset", "goff", "qualifier", "namespace")


def source_index(namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index (cu_offset, src, ns), audit rows of sources that mean several namespaces).

    Namespaces inside functions or with anonymous parts are left out.
    """
    usable = namespaces.where((F.size("namespace") > 0) & ~contains_anonymous(F.col("namespace")) & ~F.exists("namespace", lambda s: s["k"] == "subprogram"))
    by_src = usable.select("cu_offset", cpp_source(F.col("namespace")).alias("src"), "namespace", F.to_json("namespace").alias("j"))
    index = by_src.groupBy("cu_offset", "src").agg(F.min_by("namespace", "j").alias("ns"), F.count_distinct("j").alias("n"))
    audit = index.where("n > 1").select(F.col("cu_offset").alias("goff"), F.lit("namespace source is ambiguous").alias("rule"), F.col("src").alias("detail"))
    return index.drop("n"), audit


def look_up(names: DataFrame, index: DataFrame, *, name: str = "name") -> DataFrame:
    """names (cu_offset, name) with ns and base: cut at the last ::, looked up by source, else taken apart if untemplated."""
    cut = names.withColumn("cut_", split_namespace(F.col(name)))
    found = cut.join(index.select(F.col("cu_offset").alias("cu_"), F.col("src").alias("src_"), F.col("ns").alias("ns_")), (F.col("cu_offset") == F.col("cu_")) & (F.col("cut_.ns") == F.col("src_")), "left")
    plain = F.transform(F.split("cut_.ns", "::"), lambda s: F.struct(F.lit("name").alias("k"), F.lit(None).cast("bigint").alias("goff"), F.trim(s).alias("s"), F.lit(False).alias("linkage")))
    empty = F.array().cast(f"array<{SEG}>")
    parsed = F.when(F.col("cut_.ns").isNull(), empty).when(~F.col("cut_.ns").rlike(r"[<>*&]"), plain)
    return found.withColumn("ns", F.coalesce("ns_", parsed)).withColumn("base", F.col("cut_.base")).drop("cut_", "cu_", "src_", "ns_")
