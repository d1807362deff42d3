"""Flattening of type expressions that refer to other type expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.functions.tokens import normalize, splice
from typeweave.operators.fixpoint import checkpointed
from typeweave.operators.resolve import CycleError


def flatten_trees(trees: DataFrame, *, key: str = "goff", tree: str = "tree", max_rounds: int = 11) -> DataFrame:
    """(goff, tree) with every base that names another row replaced by that row's tokens, then normalized.

    Rounds splice the trees of the round before, so nesting doubles each time and
    eleven rounds exceed the depth limit; a row that still changes then is cyclic.
    """
    state = checkpointed(trees.select(F.col(key).alias("goff"), F.col(tree).alias("tree")))
    open_rows = None
    for _ in range(max_rounds):
        bases = state.select("goff", F.explode("tree").alias("t")).where("t.op = 'base'").select(F.col("t.ref").alias("r"), "goff")
        open_rows = checkpointed(bases.join(state.select(F.col("goff").alias("r")), "r", "left_semi").select("goff").distinct())
        if open_rows.isEmpty():
            return state.withColumn("tree", normalize(F.col("tree"))).select(F.col("goff").alias(key), F.col("tree").alias(tree))
        changing = state.join(open_rows, "goff", "left_semi")
        state = checkpointed(splice(changing, "tree", state, key="goff").unionByName(state.join(open_rows, "goff", "left_anti")))
    raise CycleError("type expressions are nested too deeply, or in a cycle")


def flatten_column(rows: DataFrame, column: str, flat: DataFrame, *, key: str) -> DataFrame:
    """rows with flattened trees (goff, tree) spliced into a tree column."""
    return splice(rows, column, flat, key=key).withColumn(column, normalize(F.col(column)))


def replace_leaf(rows: DataFrame, column: str, *, key: str, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ids replaced by trees (goff, tree), audit rows of member pointer classes that would need one)."""
    held = rows.select(key, F.explode(column).alias("t")).where("t.op in ('ptmd', 'ptmf')").select(F.col(key).alias("goff"), F.col("t.ref").alias("r"))
    bad = held.join(replacements.where("size(tree) > 1").select(F.col("goff").alias("r")), "r", "left_semi")
    audit = bad.select("goff", F.lit("class of a member pointer is a tree").alias("rule"), F.col("r").cast("string").alias("detail"))
    return splice(rows, column, replacements, key=key), audit
