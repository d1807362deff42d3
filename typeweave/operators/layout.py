"""Members, layouts and virtual tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_bitfields(members: DataFrame, *, group: str, order: list[str], offset: str, is_bitfield: str) -> DataFrame:
    """Of a run of bitfields at one offset the last stays, as each replaces the one before."""
    w = Window.partitionBy(group).orderBy(*order)
    follows = F.lag(is_bitfield).over(w) & F.col(is_bitfield) & F.lag(offset).over(w).eqNullSafe(F.col(offset))
    runs = members.withColumn("run_", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.row_number().over(Window.partitionBy(group, "run_").orderBy(*[F.col(c).desc() for c in order]))
    return runs.withColumn("last_", last).where("last_ = 1").drop("run_", "last_")


def drop_empty_bases(members: DataFrame, *, group: str, offset: str, is_base: str, order: list[str]) -> DataFrame:
    """At each offset the first member by (is_base, order) stays; later bases are empty and go; others stay for the audit."""
    place = F.row_number().over(Window.partitionBy(group, offset).orderBy(F.col(is_base).cast("int"), *order))
    return members.withColumn("place_", place).where((F.col("place_") == 1) | ~F.col(is_base)).drop("place_")


def colliding_members(members: DataFrame, *, group: str, offset: str, is_base: str) -> DataFrame:
    """Audit rows of offsets that hold several members that are no bases."""
    n = F.sum((~F.col(is_base)).cast("int"))
    return members.groupBy(group, offset).agg(n.alias("n")).where("n > 1").select(F.col(group).alias("goff"), F.lit("members collide").alias("rule"), F.col(offset).cast("string").alias("detail"))


def rewrite_vfptr(name: Column, offset: Column, pattern: str) -> tuple[Column, Column]:
    """(whether a member is the virtual table pointer, whether it is at a wrong offset)."""
    hit = F.coalesce(name.rlike(pattern), F.lit(False))
    return hit & (offset == 0), hit & (offset != 0)


def dedupe_by_type(members: DataFrame, *, group: str, kind: str, name: str, order: str) -> DataFrame:
    """(group, kind, name, order): one member of each type, with its first non-null name, at its first place."""
    named = F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order)))
    return members.groupBy(group, kind).agg(named.alias(name), F.min(order).alias(order))


def ordered_members(members: DataFrame, *, group: str, order: list[str], value: Column) -> DataFrame:
    """(group, members): values in an order that is total."""
    w = F.array_sort(F.collect_list(F.struct(*order, value.alias("value_"))))
    return members.groupBy(group).agg(F.transform(w, lambda m: m["value_"]).alias("members"))


def union_action(n_members: Column, n_types: Column, first_size: Column, second_size: Column, n_unnamed: Column, first_depth: Column, second_depth: Column, recursive: Column) -> Column:
    """What becomes of a union: an empty struct, its member, the only type, the larger, unnamed or deeper of two, or itself."""
    return (
        F.when(n_members == 0, "empty struct")
        .when((n_members == 1) & ~recursive, "member")
        .when((n_types == 1) & ~recursive, "only type")
        .when((n_members == 2) & (first_size != second_size), "larger")
        .when((n_members == 2) & (n_unnamed == 1), "unnamed")
        .when((n_members == 2) & (first_depth != second_depth), "deeper")
        .otherwise("keep")
    )


def struct_action(n_members: Column, n_virtual: Column, only_is_base: Column, recursive: Column, sizes_match: Column) -> Column:
    """What becomes of a struct: its only member, the members of its only base, or itself."""
    return (
        F.when((n_members == 1) & only_is_base & sizes_match, "inline base")
        .when((n_members == 1) & ~only_is_base & (n_virtual == 0) & ~recursive, "member")
        .otherwise("keep")
    )


def merge_slots(entries: DataFrame, *, group: str, index: str, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(merged entries, audit rows) of virtual table entries of several rows of one group.

    Entries with one index must have one name, and the first stays; destructors
    (names that start with ~) share a single slot, the first of them.
    """
    dtor = F.col(name).startswith("~")
    slot = F.when(dtor, F.lit(-1)).otherwise(F.col(index))
    slots = entries.withColumn("slot_", slot)
    merged = slots.groupBy(group, "slot_").agg(F.min_by(F.col(index), F.col(order)).alias(index), F.min_by(F.col(name), F.col(order)).alias(name), F.count_distinct(name).alias("n_"))
    audit = merged.where("n_ > 1").select(F.col(group).alias("goff"), F.lit("virtual table entries differ").alias("rule"), F.col(index).cast("string").alias("detail"))
    return merged.drop("slot_", "n_"), audit


def place_destructors(slots: list[tuple[int, str | None]], cls: str) -> list[tuple[int, str]]:
    """A complete virtual table: the first two adjacent slots that are empty or a destructor's become ...D1 and ...D0.

    A slot without an entry elsewhere is an error, as is a destructor without place.
    """
    table = dict(slots)
    size = max(table, default=-1) + 1
    free = [i for i in range(size + 1) if table.get(i) is None or str(table[i]).startswith("~")]
    has_dtor = any(n and n.startswith("~") for n in table.values())
    if has_dtor:
        first = next((i for i in free if i + 1 in free), None)
        if first is None:
            raise ValueError(f"no place for the destructors of {cls}")
        table[first], table[first + 1] = f"~{cls}D1", f"~{cls}D0"
    holes = [i for i in range(max(table, default=-1) + 1) if table.get(i) is None]
    if holes:
        raise ValueError(f"virtual table of {cls} has holes at {holes}")
    return sorted(table.items())


def vtable_signature(vtable: Column) -> Column:
    """Names of a virtual table by index: what decides whether two tables are equal, types aside."""
    return F.transform(F.array_sort(vtable), lambda e: e["name"])
