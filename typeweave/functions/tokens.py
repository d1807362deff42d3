"""Recursive type expressions as postfix token arrays.

A tree is array<struct<op, ref, n>>: `base` holds an id; `ptr`; `arr` with its
length in n; `sub` with its number of types (return type first); `ptmd` with a
class id; `ptmf` with class id and number of types.  Arity is fixed by the
token, so equal arrays are equal trees, and trees can be grouped, hashed, joined
and rewritten with built-in array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeweave.operators.fixpoint import spread

TREE = "array<struct<op:string,ref:bigint,n:int>>"


def token(op: str, ref: Column | int | None = None, n: Column | int | None = None) -> Column:
    as_col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(op).alias("op"), as_col(ref, "bigint").alias("ref"), as_col(n, "int").alias("n"))


def base(ref: Column | int) -> Column:
    return F.array(token("base", ref))


def ptr(tree: Column) -> Column:
    return F.concat(tree, F.array(token("ptr")))


def arr(tree: Column, length: Column | int) -> Column:
    return F.concat(tree, F.array(token("arr", None, length)))


def sub(*trees: Column) -> Column:
    return F.concat(*trees, F.array(token("sub", None, len(trees))))


def sub_of(trees: Column) -> Column:
    """A subroutine from an array of trees, return type first."""
    return F.concat(F.flatten(trees), F.array(token("sub", None, F.size(trees))))


def ptmd(cls: Column | int, tree: Column) -> Column:
    return F.concat(tree, F.array(token("ptmd", cls)))


def ptmf(cls: Column | int, *trees: Column) -> Column:
    return F.concat(*trees, F.array(token("ptmf", cls, len(trees))))


def refs(tree: Column) -> Column:
    """All ids of a tree, in order."""
    return F.filter(F.transform(tree, lambda t: t["ref"]), lambda r: r.isNotNull())


def contains(tree: Column, goff: Column) -> Column:
    return F.exists(tree, lambda t: t["ref"].eqNullSafe(goff))


def shape(tree: Column) -> Column:
    """The tree without its ids: equal shapes can be compared id by id."""
    return F.transform(tree, lambda t: F.struct(t["op"].alias("op"), t["n"].alias("n")))


def root_op(tree: Column) -> Column:
    return F.element_at(tree, -1)["op"]


def map_refs(tree: Column, f: Callable[[Column], Column]) -> Column:
    """f over every id; only for f that is a small expression, joins are for tables."""
    return F.transform(tree, lambda t: F.when(t["ref"].isNull(), t).otherwise(F.struct(t["op"].alias("op"), f(t["ref"]).cast("bigint").alias("ref"), t["n"].alias("n"))))


def drop_unit_arrays(tree: Column) -> Column:
    """T[1] is T."""
    return F.filter(tree, lambda t: ~((t["op"] == "arr") & t["n"].eqNullSafe(1)))


def merge_member_functions(tree: Column) -> Column:
    """A member pointer right above a subroutine becomes a member function pointer."""
    follows = lambda i: (F.get(tree, i + 1)["op"] == "ptmd") & (F.get(tree, i)["op"] == "sub")
    swapped = F.transform(
        tree,
        lambda t, i: F.when((t["op"] == "ptmd") & (i > 0) & follows(i - 1), F.struct(F.lit("ptmf").alias("op"), t["ref"].alias("ref"), F.get(tree, i - 1)["n"].alias("n")))
        .when(F.coalesce(follows(i), F.lit(False)), F.lit(None))
        .otherwise(t),
    )
    return F.filter(swapped, lambda t: t.isNotNull())


def normalize(tree: Column) -> Column:
    """The rewrites of a spliced tree, in the order that they need."""
    return merge_member_functions(drop_unit_arrays(tree))


def explode_refs(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, ref) of every id in a tree column, distinct."""
    return df.select(key, F.explode(refs(F.col(tree))).alias("ref")).distinct()


def remap(df: DataFrame, tree: str, mapping: DataFrame, *, key: str, old: str = "goff", new: str = "primary", number: int | None = None) -> DataFrame:
    """Every id of a tree column replaced by its representative, by join; `key` identifies rows.

    number: of tokens, about; tokens are then dealt out by it when trees are built again, and mapping is not broadcast.
    """
    parts = df.select(key, F.posexplode(tree).alias("pos_", "t_"))
    target = mapping.select(F.col(old).alias("old_"), F.col(new).alias("new_"))
    found = parts.join(target if number is None else target.hint("merge"), F.col("t_.ref") == F.col("old_"), "left")
    fixed = F.struct(F.col("t_.op").alias("op"), F.coalesce("new_", F.col("t_.ref")).alias("ref"), F.col("t_.n").alias("n"))
    found = found.select(key, "pos_", fixed.alias("t"))
    built = (found if number is None else spread(found, number, key)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos_", "t"))).alias("s_"))
    out = built.select(F.col(key).alias("key_"), F.transform("s_", lambda s: s["t"]).alias("tree_"))
    return (df if number is None else spread(df, number, key)).join(out, F.col(key) == F.col("key_"), "left").withColumn(tree, F.coalesce("tree_", tree)).drop("key_", "tree_")


def splice(df: DataFrame, tree: str, replacements: DataFrame, *, key: str, ref: str = "goff", by: str = "tree") -> DataFrame:
    """Every base token whose id has a replacement gives way to the replacement's tokens.

    Class ids of member pointers are not spliced, as no tree can stand there.
    """
    parts = df.select(key, F.posexplode(tree).alias("pos_", "t_"))
    target = replacements.select(F.col(ref).alias("old_"), F.col(by).alias("new_"))
    found = parts.join(target, (F.col("t_.ref") == F.col("old_")) & (F.col("t_.op") == "base"), "left")
    piece = F.coalesce("new_", F.array("t_"))
    built = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos_", piece.alias("p")))).alias("s_"))
    out = built.select(F.col(key).alias("key_"), F.flatten(F.transform("s_", lambda s: s["p"])).alias("tree_"))
    return df.join(out, F.col(key) == F.col("key_"), "left").withColumn(tree, F.coalesce("tree_", tree)).drop("key_", "tree_")


def numbered(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def complexity(tree: Column) -> Column:
    """Nesting depth along the first child; member pointers add two.

    In postfix order a token is above the first leaf exactly if it takes the
    whole stack.
    """

    def step(state: Column, t: Column) -> Column:
        arity = F.when(t["op"] == "base", 0).when(t["op"].isin("sub", "ptmf"), t["n"]).otherwise(1)
        above = (t["op"] != "base") & (state["held"] == arity)
        weight = F.when(t["op"].isin("ptmd", "ptmf"), 2).otherwise(1)
        return F.struct((state["held"] - arity + 1).alias("held"), (state["depth"] + F.when(above, weight).otherwise(0)).alias("depth"))

    return F.aggregate(tree, F.struct(F.lit(0).alias("held"), F.lit(0).alias("depth")), step, lambda s: s["depth"])
