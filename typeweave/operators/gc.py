"""Sweeping rows that nothing needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.fixpoint import checkpointed


def sweep(rows: DataFrame, edges: DataFrame, roots: DataFrame, *, key: str = "goff", mode: str = "referenced", max_rounds: int = 1000) -> DataFrame:
    """rows that stay: (src, dst) edges say which row refers to which, roots (goff) are needed from outside.

    mode "referenced": a row stays if it is a root or a row that stays refers to it
    (itself included), so garbage that refers to itself survives.  mode
    "reachable": it stays if a root leads to it.
    """
    alive = checkpointed(rows.select(F.col(key).alias("goff")).distinct())
    start = checkpointed(roots.select("goff").distinct())
    edges = checkpointed(edges.select("src", "dst").distinct())
    if mode == "reachable":
        marked = checkpointed(start.join(alive, "goff", "left_semi"))
        front = marked
        for _ in range(max_rounds):
            front = edges.join(front.select(F.col("goff").alias("src")), "src", "left_semi").select(F.col("dst").alias("goff")).distinct()
            front = checkpointed(front.join(marked, "goff", "left_anti").join(alive, "goff", "left_semi"))
            if front.isEmpty():
                break
            marked = checkpointed(marked.unionByName(front))
        else:
            raise RuntimeError(f"the sweep did not settle in {max_rounds} rounds")
        alive = marked
    else:
        before = alive.count()
        for _ in range(max_rounds):
            used = edges.join(alive.select(F.col("goff").alias("src")), "src", "left_semi").select(F.col("dst").alias("goff"))
            alive = checkpointed(alive.join(used.unionByName(start).distinct(), "goff", "left_semi"))
            now = alive.count()
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"the sweep did not settle in {max_rounds} rounds")
    return rows.join(alive.withColumnRenamed("goff", "alive_"), F.col(key) == F.col("alive_"), "left_semi")
