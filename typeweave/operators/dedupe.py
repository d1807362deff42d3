"""Content deduplication to a fixpoint, and representatives of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.functions.prims import is_prim
from typeweave.functions.tokens import remap
from typeweave.operators.components import connected_components
from typeweave.operators.fixpoint import checkpointed


def primaries(buckets: DataFrame, prim: Column | None = None) -> DataFrame:
    """(component, primary) of (node, component): a primitive if there is one, else the smallest id."""
    prim = F.max(F.when(is_prim(F.col("node")) if prim is None else prim, F.col("node")))
    return buckets.groupBy("component").agg(F.coalesce(prim, F.min("node")).alias("primary"))


def two_primitives(buckets: DataFrame, prim: Column | None = None) -> DataFrame:
    """Audit rows of groups that hold two different primitives."""
    n = F.count_distinct(F.when(is_prim(F.col("node")) if prim is None else prim, F.col("node")))
    return buckets.groupBy("component").agg(n.alias("n")).where("n > 1").select(F.col("component").alias("goff"), F.lit("two primitives").alias("rule"), F.col("n").cast("string").alias("detail"))


def buckets_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(goff, primary) for every node of an edge table."""
    groups = connected_components(edges, src, dst)
    return groups.join(checkpointed(primaries(groups)), "component").select(F.col("node").alias("goff"), "primary")


def content_dedupe(rows: DataFrame, *, key: str = "goff", refs: tuple[str, ...] = (), trees: tuple[str, ...] = (), max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows without repetitions, bucket (goff, primary)).

    Rows with the same content, which is every column but the key, collapse to
    their primary; ids in columns `refs` and trees in `trees` are then replaced by
    primaries, which may make further rows alike, until nothing collapses.
    """
    kept, bucket = checkpointed(rows), None
    for _ in range(max_rounds):
        content = F.sha2(F.to_json(F.struct(*[c for c in kept.columns if c != key]), {"ignoreNullFields": "false"}), 256)
        tagged = kept.select(F.col(key).alias("goff"), content.alias("h"))
        prim = F.max(F.when(is_prim(F.col("goff")), F.col("goff")))
        groups = checkpointed(tagged.groupBy("h").agg(F.coalesce(prim, F.min("goff")).alias("primary"), F.count("*").alias("n")))
        if groups.where("n > 1").isEmpty():
            break
        moved = checkpointed(tagged.join(groups, "h").where("goff <> primary").select("goff", "primary"))
        bucket = moved if bucket is None else checkpointed(_compose(bucket, moved))
        kept = kept.join(moved.select(F.col("goff").alias("gone_")), F.col(key) == F.col("gone_"), "left_anti")
        for c in refs:
            target = moved.select(F.col("goff").alias("old_"), F.col("primary").alias("new_"))
            kept = kept.join(target, F.col(c) == F.col("old_"), "left").withColumn(c, F.coalesce("new_", c)).drop("old_", "new_")
        for c in trees:
            kept = remap(kept, c, moved, key=key)
        kept = checkpointed(kept)
    else:
        raise RuntimeError("content deduplication did not settle")
    same = kept.select(F.col(key).alias("goff"), F.col(key).alias("primary"))
    return kept, same if bucket is None else same.unionByName(bucket)


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """Earlier replacements followed by later ones."""
    step = then.select(F.col("goff").alias("g2"), F.col("primary").alias("p2"))
    moved = first.join(step, F.col("primary") == F.col("g2"), "left").select("goff", F.coalesce("p2", "primary").alias("primary"))
    return moved.unionByName(then)
