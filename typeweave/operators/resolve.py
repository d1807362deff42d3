"""Following references: alias chains, fallback attributes, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.operators.fixpoint import checkpointed, discard, written

#: Chains longer than this are taken for cycles.
MAX_DEPTH = 1000


class CycleError(RuntimeError):
    """A chain of references doesn't end."""


def chase(links: DataFrame, *, key: str = "goff", target: str = "target", strict: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, root, depth) for every row: where its chain of targets ends.

    A row without target is its own root; a target that is no row ends the chain there.
    Chains double in length each round, so ten rounds reach the depth limit.  Rows
    on or behind a cycle are an error if strict, else have a null root.
    """
    state = links.select(
        F.col(key).alias("k"), F.coalesce(target, key).alias("at"), F.when(F.col(target).isNull() | (F.col(target) == F.col(key)), 0).otherwise(1).cast("long").alias("depth")
    )
    state, before = checkpointed(state), None
    for _ in range(max_depth.bit_length() + 2):
        total = state.agg(F.sum("depth").alias("s")).first()["s"]
        if total == before:
            break
        before = total
        step = state.select(F.col("k").alias("k2"), F.col("at").alias("at2"), F.col("depth").alias("d2"))
        moved = state.join(step, F.col("at") == F.col("k2"), "left")
        state = checkpointed(moved.select("k", F.coalesce("at2", "at").alias("at"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
    looping = F.col("depth") > max_depth
    if strict and not state.where(looping).isEmpty():
        raise CycleError(f"a chain is longer than {max_depth}, or a cycle")
    return state.select(F.col("k").alias(key), F.when(~looping, F.col("at")).alias("root"), "depth")


def carry(rows: DataFrame, links: DataFrame, attribute: str, *, key: str = "goff", target: str = "target") -> DataFrame:
    """rows with the attribute of the root of their chain."""
    ends = chase(links, key=key, target=target).select(F.col(key).alias("k"), "root")
    values = rows.select(F.col(key).alias("r"), F.col(attribute).alias("value_"))
    found = ends.join(values, F.col("root") == F.col("r"), "left").select("k", "root", "value_")
    return rows.drop(attribute).join(found, F.col(key) == F.col("k"), "left").drop("k").withColumnRenamed("value_", attribute)


def resolve_aliases(types: DataFrame) -> DataFrame:
    """types (goff, kind, name, target, ...) with alias and typedef rows resolved.

    An alias takes the place of its root and has no name of its own.  A typedef
    whose chain ends in a tree or a primitive loses its name and becomes an
    alias; another typedef is retargeted to the root.  Adds `root` and `root_kind`.
    """
    links = types.select("goff", F.when(F.col("kind").isin("alias", "typedef"), F.col("target")).alias("target"))
    ends = chase(links).select(F.col("goff").alias("k"), "root")
    kinds = types.select(F.col("goff").alias("r"), F.col("kind").alias("root_kind"))
    ends = ends.join(kinds, F.col("root") == F.col("r"), "left").select("k", "root", "root_kind")
    out = types.join(ends, F.col("goff") == F.col("k"), "left").drop("k")
    typedef = F.col("kind") == "typedef"
    plain = typedef & F.col("root_kind").isin("tree", "prim")
    return (
        out.withColumn("target", F.when(typedef | (F.col("kind") == "alias"), F.col("root")).otherwise(F.col("target")))
        .withColumn("name", F.when(plain | (F.col("kind") == "alias"), F.lit(None)).otherwise(F.col("name")))
        .withColumn("kind", F.when(plain, F.lit("alias")).otherwise(F.col("kind")))
    )


def fallback(rows: DataFrame, attribute: str, *, key: str = "goff", via: tuple[str, ...] = ("origin_ref", "spec_ref")) -> DataFrame:
    """(key, attribute): a row's own value, else that of its chain by the first link, else by the next."""
    out = rows
    for link in via:
        links = out.select(key, F.when(F.col(attribute).isNull(), F.col(link)).alias("target"))
        ends = chase(links, key=key, strict=False).select(F.col(key).alias("k"), "root")
        values = out.select(F.col(key).alias("r"), F.col(attribute).alias("value_"))
        found = ends.join(values, F.col("root") == F.col("r"), "left").select("k", "value_")
        out = out.join(found, F.col(key) == F.col("k"), "left").withColumn(attribute, F.coalesce(attribute, "value_")).drop("k", "value_")
    return out


def tree_size(tree: Column, pointer: int, ptmd: int, ptmf: int) -> Column:
    """struct(ref, factor, fixed): a tree's size is fixed, or factor times the size of ref; all null if unsized.

    Outer arrays multiply; what is below them is a base, a pointer or nothing that has a size.
    """
    top = F.size(tree) - F.coalesce(F.array_position(F.transform(F.reverse(tree), lambda t: t["op"] != "arr"), True), F.lit(0)) + 1
    factor = F.aggregate(F.filter(F.slice(tree, top + 1, F.size(tree)), lambda t: t["op"] == "arr"), F.lit(1).cast("long"), lambda a, t: a * t["n"])
    under = F.get(tree, (top - 1).cast("int"))
    fixed = F.when(under["op"] == "ptr", pointer).when(under["op"] == "ptmd", ptmd).when(under["op"] == "ptmf", ptmf)
    return F.struct(F.when(under["op"] == "base", under["ref"]).alias("ref"), factor.alias("factor"), (fixed * factor).cast("long").alias("fixed"))


def resolve_sizes(types: DataFrame, *, pointer: int = 8, ptmd: int = 8, ptmf: int = 16) -> DataFrame:
    """(goff, byte_size) of (goff, byte_size, target, tree): own size, else the target's, else the tree's.

    Each round resolves the rows whose reference is resolved, and lets the others refer
    to what their reference refers to, with the factors multiplied: so the depth that
    is resolved doubles, and a round that resolves nothing is the last.  What never
    resolves (unsized, dangling, cyclic, or beyond 64 bits) stays null.
    """
    size = tree_size(F.col("tree"), pointer, ptmd, ptmf)
    need = types.select("goff", F.col("byte_size").cast("long").alias("own"), F.when(F.col("tree").isNotNull(), size).alias("s"), "target")
    need = need.select("goff", F.coalesce("own", "s.fixed").alias("size"), F.coalesce("target", "s.ref").alias("ref"), F.coalesce("s.factor", F.lit(1)).alias("factor"))
    state = written(need, "sizes")
    known = state.where("size is not null").count()
    while True:
        there = state.select(F.col("goff").alias("g2"), F.col("size").alias("size2"), F.col("ref").alias("ref2"), F.col("factor").alias("factor2"))
        got = state.join(there, F.col("ref") == F.col("g2"), "left")
        on = F.col("size").isNull() & F.col("size2").isNull()  # rows without a reference, or a dangling one, lose it
        last, state = state, written(
            got.select(
                "goff",
                F.coalesce("size", F.try_multiply("size2", "factor")).alias("size"),
                F.when(on, F.col("ref2")).alias("ref"),
                F.when(on, F.try_multiply("factor", "factor2")).otherwise(F.col("factor")).alias("factor"),
            ),
            "sizes",
        )
        discard(last)
        now = state.where("size is not null").count()
        if now == known:
            break
        known = now
    return state.select("goff", F.col("size").alias("byte_size"))


def check_union_sizes(unions: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Audit rows of unions (goff, byte_size) that are not as large as the largest of members (goff, ref)."""
    largest = members.join(sizes.select(F.col("goff").alias("ref"), F.col("byte_size").alias("member_size")), "ref").groupBy("goff").agg(F.max("member_size").alias("largest"))
    return unions.join(largest, "goff").where("byte_size <> largest").select("goff", F.lit("union size").alias("rule"), F.concat_ws(" <> ", "byte_size", "largest").alias("detail"))
