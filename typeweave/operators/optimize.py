"""Simplification of layouts: unions and structs that say no more than one of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeweave.functions import tokens as T
from typeweave.operators.fixpoint import checkpointed
from typeweave.operators.flatten import flatten_trees
from typeweave.operators.layout import struct_action, union_action
from typeweave.operators.resolve import tree_size


def member_sizes(members: DataFrame, sizes: DataFrame, *, pointer: int, ptmd: int, ptmf: int) -> DataFrame:
    """members with the size of their type expression; null if it has none."""
    sized = members.withColumn("s_", tree_size(F.col("ty"), pointer, ptmd, ptmf))
    known = sizes.select(F.col("goff").alias("g_"), F.col("byte_size").alias("b_"))
    return sized.join(known, F.col("s_.ref") == F.col("g_"), "left").withColumn("size", F.coalesce("s_.fixed", F.col("b_") * F.col("s_.factor"))).drop("s_", "g_", "b_")


def actions(types: DataFrame, members: DataFrame) -> DataFrame:
    """(goff, action, ty): what becomes of each struct and union, and the type expression that takes its place.

    types: (goff, kind, byte_size, n_virtual); members: (goff, ord, name, ty, special, size).
    """
    first = lambda c: F.min_by(c, "ord")
    last = lambda c: F.max_by(c, "ord")
    deep = T.complexity(F.col("ty"))
    own = F.exists("ty", lambda t: t["ref"].eqNullSafe(F.col("goff")))
    stats = members.withColumn("deep", deep).withColumn("own", own).groupBy("goff").agg(
        F.count("*").alias("n"),
        F.count_distinct("ty").alias("types"),
        first("size").alias("s1"),
        last("size").alias("s2"),
        F.count_if(F.col("name").isNull()).alias("unnamed"),
        first("deep").alias("d1"),
        last("deep").alias("d2"),
        F.bool_or("own").alias("loops"),
        F.bool_and(F.col("special").eqNullSafe(F.lit("base"))).alias("based"),
        first("ty").alias("t1"),
        last("ty").alias("t2"),
        first("name").alias("n1"),
    )
    both = types.where("kind in ('struct', 'union')").join(stats.withColumnRenamed("goff", "g"), F.col("goff") == F.col("g"), "left")
    n, loops = F.coalesce("n", F.lit(0)), F.coalesce("loops", F.lit(False))
    fits = F.coalesce(F.col("s1") == F.col("byte_size"), F.lit(False))
    union = union_action(n, F.coalesce("types", F.lit(0)), F.col("s1"), F.col("s2"), F.col("unnamed"), F.col("d1"), F.col("d2"), loops)
    struct = struct_action(n, F.coalesce("n_virtual", F.lit(0)), F.coalesce("based", F.lit(False)), loops, fits)
    action = F.when(F.col("kind") == "union", union).otherwise(struct)
    chosen = (
        F.when(action == "larger", F.when(F.col("s1") > F.col("s2"), F.col("t1")).otherwise(F.col("t2")))
        .when(action == "unnamed", F.when(F.col("n1").isNull(), F.col("t1")).otherwise(F.col("t2")))
        .when(action == "deeper", F.when(F.col("d1") > F.col("d2"), F.col("t1")).otherwise(F.col("t2")))
        .otherwise(F.col("t1"))
    )
    return both.select("goff", action.alias("action"), F.when(~action.isin("keep", "empty struct", "inline base"), chosen).alias("ty"))


def simplify(types: DataFrame, members: DataFrame, *, pointer: int = 8, ptmd: int = 8, ptmf: int = 16, max_rounds: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, members, moved (goff, tree)) after all rewrites, each applied until none applies.

    Types that give way to a type expression are gone; `moved` has what took their place.
    """
    types, members, moved = checkpointed(types), checkpointed(members), None
    for _ in range(max_rounds):
        sized = member_sizes(members.drop("size"), types, pointer=pointer, ptmd=ptmd, ptmf=ptmf)
        todo = checkpointed(actions(types, sized).where("action <> 'keep'"))
        if todo.isEmpty():
            empty = types.select("goff", F.lit(None).cast(T.TREE).alias("tree")).limit(0)
            return types, members, empty if moved is None else moved
        hollow = todo.where("action = 'empty struct'").select(F.col("goff").alias("h"))
        types = types.join(hollow, F.col("goff") == F.col("h"), "left")
        types = types.withColumn("kind", F.when(F.col("h").isNotNull(), "struct").otherwise(F.col("kind"))).withColumn("byte_size", F.when(F.col("h").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("byte_size"))).drop("h")
        members = _inlined(members, todo)
        gone = todo.where("ty is not null").select("goff", F.col("ty").alias("tree"))
        if not gone.isEmpty():
            gone = checkpointed(flatten_trees(gone))
            key = members.withColumn("row_", F.concat_ws("/", "goff", "ord"))
            members = T.splice(key, "ty", gone, key="row_").drop("row_").join(gone.select("goff"), "goff", "left_anti")
            types = types.join(gone.select("goff"), "goff", "left_anti")
            moved = gone if moved is None else checkpointed(T.splice(moved, "tree", gone, key="goff").unionByName(gone))
        types, members = checkpointed(types), checkpointed(members)
    raise RuntimeError("layouts did not settle")


def _inlined(members: DataFrame, todo: DataFrame) -> DataFrame:
    """Structs whose only member is a base get the base's members instead."""
    outer = todo.where("action = 'inline base'").select(F.col("goff").alias("outer"))
    bases = members.join(outer, F.col("goff") == F.col("outer")).select("outer", F.get("ty", F.lit(0))["ref"].alias("base"))
    below = members.join(bases, F.col("goff") == F.col("base")).withColumn("goff", F.col("outer")).select(members.columns)
    return members.join(outer, F.col("goff") == F.col("outer"), "left_anti").select(members.columns).unionByName(below)


def inherit_vtables(entries: DataFrame, bases: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """(goff, idx, name, from_base): virtual functions with those that a base at offset 0 has and the type doesn't override.

    entries: (goff, idx, name); bases: (goff, base).
    """
    state = checkpointed(entries.select("goff", "idx", "name", F.lit(False).alias("from_base")))
    known = state.count()
    for _ in range(max_rounds):
        above = state.select(F.col("goff").alias("base"), "idx", "name").join(bases, "base").select("goff", "idx", "name", F.lit(True).alias("from_base"))
        place = F.row_number().over(Window.partitionBy("goff", "idx").orderBy("from_base", "name"))
        state = checkpointed(state.unionByName(above).withColumn("place_", place).where("place_ = 1").drop("place_"))
        now = state.count()
        if now == known:
            return state
        known = now
    raise RuntimeError("virtual tables did not settle")


def kind_statistics(types: DataFrame) -> DataFrame:
    """Types by kind and by the outermost part of their type expression, as columns."""
    shape = F.coalesce(T.root_op(F.col("tree")), F.lit("plain"))
    return types.select("kind", shape.alias("shape")).groupBy("kind").pivot("shape", ["plain", "base", "ptr", "arr", "sub", "ptmd", "ptmf"]).count()
