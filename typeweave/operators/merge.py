"""Merging types by name over all units.

Types of one kind that share a name are one type, and so are the types that
their definitions refer to at the same places.  The result is the connected components
of both kinds of pairs; names link to the smallest definition that has them, so
no list of all pairs is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.operators.components import connected_components
from typeweave.operators.dedupe import primaries
from typeweave.operators.fixpoint import checkpointed

# Kinds by how they win over others when they meet in one group, and what they have in common.
RANK = {"prim": 0, "enum": 1, "struct": 2, "union": 3, "enum_decl": 4, "struct_decl": 5, "union_decl": 6}


def kind_class(kind: Column) -> Column:
    """Declarations belong with definitions."""
    return F.regexp_replace(kind, "_decl$", "")


def rank(kind: Column) -> Column:
    out = F.lit(len(RANK))
    for name, place in RANK.items():
        out = F.when(kind == name, place).otherwise(out)
    return out


def name_index(names: DataFrame) -> DataFrame:
    """(kind_class, name, goffs): which types have each name; primitives are left out, as they never merge by name."""
    usable = names.where("kind <> 'prim' and name is not null").select(kind_class(F.col("kind")).alias("kind_class"), "name", "goff").distinct()
    return usable.groupBy("kind_class", "name").agg(F.array_sort(F.collect_set("goff")).alias("goffs"))


def star_edges(names: DataFrame) -> DataFrame:
    """(src, dst): every type with a name to that name's centre, the smallest definition, else the smallest declaration."""
    usable = names.where("kind <> 'prim' and name is not null").select(kind_class(F.col("kind")).alias("kind_class"), "name", "goff", F.col("kind").endswith("_decl").alias("decl")).distinct()
    centre = checkpointed(usable.groupBy("kind_class", "name").agg(F.coalesce(F.min(F.when(~F.col("decl"), F.col("goff"))), F.min("goff")).alias("dst")))
    return usable.join(centre, ["kind_class", "name"]).select(F.col("goff").alias("src"), "dst").distinct()


def candidate_pairs(names: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of types of one kind that share a name. Grows with the square; for small tables."""
    usable = names.where("kind <> 'prim' and name is not null").select(kind_class(F.col("kind")).alias("kind_class"), "name", "goff").distinct()
    other = usable.select("kind_class", "name", F.col("goff").alias("b"))
    return usable.join(other, ["kind_class", "name"]).where("goff < b").select(F.col("goff").alias("a"), "b").distinct()


def merge_groups(types: DataFrame, names: DataFrame, refs: DataFrame, *, max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(bucket (goff, component), audit rows).

    types: (goff, kind, shape), shape being what two definitions must share; names:
    (goff, kind, name); refs: (goff, place, ref), the ids of a definition by their place.
    Each round adds the pairs of ids that merged definitions have at one place,
    until none is new.
    """
    edges = checkpointed(star_edges(names))
    wide = checkpointed(types.select("goff", "kind", "shape"))
    refs = checkpointed(refs.select("goff", "place", "ref").distinct())
    known = edges.count()
    for _ in range(max_rounds):
        groups = checkpointed(connected_components(edges.unionByName(wide.select(F.col("goff").alias("src"), F.col("goff").alias("dst")))))
        placed = refs.join(groups.select(F.col("node").alias("goff"), "component"), "goff")
        centre = checkpointed(placed.groupBy("component", "place").agg(F.min_by("ref", "goff").alias("dst")))
        implied = placed.join(centre, ["component", "place"]).where("ref <> dst").select(F.col("ref").alias("src"), "dst")
        edges = checkpointed(edges.unionByName(implied).distinct())
        now = edges.count()
        if now == known:
            break
        known = now
    else:
        raise RuntimeError("merging by name did not settle")
    bucket = groups.select(F.col("node").alias("goff"), "component")
    members = wide.join(bucket, "goff")
    definitions = members.where(~F.col("kind").endswith("_decl"))
    shapes = definitions.groupBy("component").agg(F.count_distinct("shape").alias("n"), F.count_distinct("kind").alias("k"))
    differ = shapes.where("n > 1 or k > 1").select(F.col("component").alias("goff"), F.lit("definitions of one name differ").alias("rule"), F.concat_ws("/", "n", "k").alias("detail"))
    return bucket, differ


def named_orphans(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Audit rows of implied pairs (src, dst) of two named types that share no name."""
    own = names.where("name is not null").groupBy("goff").agg(F.collect_set("name").alias("names"))
    both = pairs.join(own.select(F.col("goff").alias("src"), F.col("names").alias("a")), "src").join(own.select(F.col("goff").alias("dst"), F.col("names").alias("b")), "dst")
    return both.where(~F.arrays_overlap("a", "b")).select(F.col("src").alias("goff"), F.lit("implied pair of different names").alias("rule"), F.col("dst").cast("string").alias("detail"))


def merged_types(types: DataFrame, bucket: DataFrame) -> DataFrame:
    """(goff, kind, name, other_names, byte_size, members): one row a group.

    The strongest kind wins, the smallest id of that kind gives content and name;
    names of all rows that don't give the name are other names, sorted.
    """
    rows = types.join(bucket, "goff")
    first = F.struct(rank(F.col("kind")), "goff")
    prim = primaries(bucket.select(F.col("goff").alias("node"), "component"))
    grouped = rows.groupBy("component").agg(
        F.min_by("kind", first).alias("kind"),
        F.min_by("byte_size", first).alias("byte_size"),
        F.min_by("members", first).alias("members"),
        F.coalesce(
            F.min_by("name", F.when(~F.col("kind").endswith("_decl") & F.col("name").isNotNull(), first)),
            F.when(F.min(rank(F.col("kind"))) >= RANK["enum_decl"], F.min("name")),
        ).alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.concat(F.coalesce("other_names", F.array().cast("array<string>")), F.array("name"))))))).alias("all_names"),
    )
    own = F.filter("all_names", lambda n: ~n.eqNullSafe(F.col("name")))
    return grouped.join(checkpointed(prim), "component").select(F.col("primary").alias("goff"), "kind", "name", own.alias("other_names"), "byte_size", "members")


def attach_typedef_names(types: DataFrame, typedefs: DataFrame) -> DataFrame:
    """types with the names of typedefs (root, name) that end at them added to other_names."""
    extra = typedefs.where("name is not null").groupBy(F.col("root").alias("goff_")).agg(F.collect_set("name").alias("more_"))
    both = types.join(extra, F.col("goff") == F.col("goff_"), "left").drop("goff_")
    empty = F.array().cast("array<string>")
    return both.withColumn("other_names", F.array_sort(F.array_distinct(F.concat(F.coalesce("other_names", empty), F.coalesce("more_", empty))))).drop("more_")


def closure(edges: DataFrame, *, max_rounds: int = 20) -> DataFrame:
    """(src, dst) for every path of (src, dst) edges; path lengths double each round."""
    paths = checkpointed(edges.select("src", "dst").distinct())
    known = paths.count()
    for _ in range(max_rounds):
        longer = paths.join(paths.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        paths = checkpointed(paths.unionByName(longer).distinct())
        now = paths.count()
        if now == known:
            return paths
        known = now
    raise RuntimeError("closure did not settle")


def without_mutual(edges: DataFrame) -> DataFrame:
    """Edges whose end does not lead back to their start."""
    back = closure(edges).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(back, ["src", "dst"], "left_anti")


def link_declarations(types: DataFrame) -> DataFrame:
    """(decl, definition) by kind and exact name, to the smallest definition; unlinked declarations have null."""
    decl = types.where(F.col("kind").endswith("_decl")).select(F.col("goff").alias("decl"), kind_class(F.col("kind")).alias("kind_class"), "name")
    full = types.where(~F.col("kind").endswith("_decl") & F.col("name").isNotNull()).groupBy(kind_class(F.col("kind")).alias("kind_class"), "name").agg(F.min("goff").alias("definition"))
    return decl.join(full, ["kind_class", "name"], "left").select("decl", "definition")


def dangling(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Audit rows of references (src, dst) to nothing."""
    there = rows.select(F.col("goff").alias("dst"))
    return edges.join(there, "dst", "left_anti").select(F.col("src").alias("goff"), F.lit("dangling reference").alias("rule"), F.col("dst").cast("string").alias("detail"))
