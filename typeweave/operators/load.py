"""Types and symbols out of a table of debug information entries.

die: cu_offset, goff, parent, ord, depth, tag, name, linkage_name, type_ref, spec_ref,
origin_ref, containing_ref, byte_size, bit_size, const_value, count, member_loc,
encoding, declaration, external, inline_code, virtuality, vtable_idx, low_pc.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.functions import tokens as T
from typeweave.functions.names import fill_param_names, untemplated
from typeweave.functions.prims import PRIM_ID, decode_primitives, primitive_table
from typeweave.operators.fixpoint import spread
from typeweave.operators.layout import dedupe_by_type, drop_empty_bases, merge_bitfields, rewrite_vfptr
from typeweave.operators.namespace import TYPE_TAGS
from typeweave.operators.resolve import fallback

VOID = PRIM_ID["void"]
MEMBERS = ["member", "inheritance"]
TYPES = "cu_offset long, goff long, kind string, name string, target long, byte_size long, base_goff long, tree array<struct<op:string,ref:bigint,n:int>>"


@dataclass
class Config:
    """What the loaders need to know of the program: sizes, and patterns of names."""

    pointer_width: int = 64
    ptmd_repr: tuple[str, int] = ("i64", 1)
    ptmf_repr: tuple[str, int] = ("i64", 2)
    vfptr_pattern: str = "^_vptr"
    abandon_typedefs: list[str] = field(default_factory=list)
    vtable_pattern: str | None = None

    @property
    def pointer_prim(self) -> str:
        return f"u{self.pointer_width}"


def type_entries(die: DataFrame) -> DataFrame:
    """Entries that are types."""
    return die.where(F.col("tag").isin(*TYPE_TAGS))


def is_inlined(code: Column) -> Column:
    return F.coalesce(code.isin("inlined", "declared_inlined"), F.lit(False))


def vtable_index(virtuality: Column, index: Column) -> Column:
    """The index of a virtual function; null for others. Wrong combinations are for `vtable_audit`."""
    return F.when(virtuality.isin("virtual", "pure_virtual"), index)


def vtable_audit(die: DataFrame) -> DataFrame:
    virtual = F.coalesce(F.col("virtuality").isin("virtual", "pure_virtual"), F.lit(False))
    wrong = (F.col("tag") == "subprogram") & (virtual != F.col("vtable_idx").isNotNull())
    return die.where(wrong).select("goff", F.lit("virtual table index").alias("rule"), F.col("virtuality").alias("detail"))


def _children(die: DataFrame, tag: str | list[str]) -> DataFrame:
    return die.where(F.col("tag").isin(*([tag] if isinstance(tag, str) else tag)))


def _ref(column: str = "type_ref") -> Column:
    return F.coalesce(column, F.lit(VOID))


def load_simple(die: DataFrame, config: Config) -> DataFrame:
    """Rows of base types, typedefs, pointers, references, qualifiers and nullptr."""
    prims = primitive_table(die.sparkSession)
    base = decode_primitives(die.where("tag = 'base_type'")).join(F.broadcast(prims.select("prim", F.col("goff").alias("prim_goff"))), "prim", "left")
    none = F.lit(None)
    alias = lambda df, target: df.select("cu_offset", "goff", F.lit("alias").alias("kind"), none.cast("string").alias("name"), target.alias("target"))
    out = alias(base, F.col("prim_goff"))
    dropped = F.lit(False)
    for p in config.abandon_typedefs:
        dropped = dropped | F.coalesce(F.col("name").rlike(p), F.lit(False))
    typedef = die.where("tag = 'typedef'")
    kind = F.when(F.col("type_ref").isNull() | dropped, "alias").otherwise("typedef")
    out = out.unionByName(typedef.select("cu_offset", "goff", kind.alias("kind"), F.when(kind == "typedef", F.col("name")).alias("name"), _ref().alias("target")))
    out = out.unionByName(alias(die.where("tag in ('const_type', 'volatile_type', 'restrict_type')"), _ref()))
    out = out.unionByName(alias(die.where("tag = 'unspecified_type'"), F.lit(PRIM_ID[config.pointer_prim])))
    out = out.withColumn("tree", F.lit(None).cast(T.TREE))
    point = die.where("tag in ('pointer_type', 'reference_type', 'rvalue_reference_type')")
    return out.unionByName(_tree(point, T.ptr(T.base(_ref()))))


def _tree(df: DataFrame, tree: Column) -> DataFrame:
    none = F.lit(None)
    return df.select("cu_offset", "goff", F.lit("tree").alias("kind"), none.cast("string").alias("name"), none.cast("long").alias("target"), tree.alias("tree"))


def load_arrays(die: DataFrame, *, last_dim_only: bool = False) -> DataFrame:
    """Arrays; one without any count is a pointer; all dimensions count, from the innermost, unless last_dim_only."""
    counts = _children(die, "subrange_type").groupBy("parent").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("ord", "count")))), lambda s: s["count"]).alias("dims")
    )
    arrays = die.where("tag = 'array_type'").join(counts.withColumnRenamed("parent", "p"), F.col("goff") == F.col("p"), "left")
    dims = F.coalesce("dims", F.array().cast("array<bigint>"))
    used = F.slice(dims, -1, 1) if last_dim_only else F.reverse(dims)
    made = F.transform(used, lambda n: F.struct(F.lit("arr").alias("op"), F.lit(None).cast("bigint").alias("ref"), n.cast("int").alias("n")))
    return _tree(arrays, F.when(F.size(dims) == 0, T.ptr(T.base(_ref()))).otherwise(F.concat(T.base(_ref()), made)))


def signatures(die: DataFrame, owner: DataFrame, *, key: str = "goff") -> DataFrame:
    """(goff, types): return type and parameter types of subroutines, void parameters left out."""
    params = _children(die, "formal_parameter").where(F.col("type_ref").isNotNull() & (F.col("type_ref") != VOID))
    args = params.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type_ref"))), lambda s: s["type_ref"]).alias("args"))
    both = owner.select(F.col(key).alias("goff"), _ref().alias("ret")).join(args, F.col("goff") == F.col("parent"), "left")
    return both.select("goff", F.concat(F.array("ret"), F.coalesce("args", F.array().cast("array<bigint>"))).alias("types"))


def _sub_tree(types: Column) -> Column:
    bases = F.transform(types, lambda r: F.struct(F.lit("base").alias("op"), r.alias("ref"), F.lit(None).cast("int").alias("n")))
    return F.concat(bases, F.array(T.token("sub", None, F.size(types))))


def load_subroutines(die: DataFrame) -> DataFrame:
    owner = die.where("tag = 'subroutine_type'")
    made = signatures(die, owner).withColumn("tree", _sub_tree(F.col("types"))).select(F.col("goff").alias("g"), "tree")
    return _tree(owner.join(made, F.col("goff") == F.col("g")), F.col("tree"))


def void_parameter_audit(die: DataFrame) -> DataFrame:
    """Subroutines that have a void parameter among others."""
    params = _children(die, "formal_parameter").groupBy("parent").agg(F.count("*").alias("n"), F.count_if(F.col("type_ref").isNull() | (F.col("type_ref") == VOID)).alias("v"))
    return params.where("v > 0 and n > 1").select(F.col("parent").alias("goff"), F.lit("void parameter among others").alias("rule"), F.col("n").cast("string").alias("detail"))


def load_member_pointers(die: DataFrame) -> DataFrame:
    """Pointers to members; to member functions where they point to a subroutine."""
    point = die.where("tag = 'ptr_to_member_type'")
    subs = load_subroutines(die).select(F.col("goff").alias("s"), F.col("tree").alias("sub_tree"))
    both = point.join(subs, F.col("type_ref") == F.col("s"), "left")
    cls = F.coalesce("containing_ref", F.lit(VOID))
    function = F.concat(F.slice("sub_tree", F.lit(1), F.size("sub_tree") - 1), F.array(T.token("ptmf", cls, F.element_at("sub_tree", -1)["n"])))
    return _tree(both, F.when(F.col("sub_tree").isNotNull(), function).otherwise(T.ptmd(cls, T.base(_ref()))))


def load_enums(die: DataFrame) -> DataFrame:
    """Enumerations with their enumerators in source order; the base type goes before the size."""
    own = die.where("tag = 'enumeration_type'")
    values = _children(die, "enumerator").groupBy("parent").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", F.col("const_value").alias("value")))), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"))).alias("enumerators")
    )
    both = own.join(values.withColumnRenamed("parent", "p"), F.col("goff") == F.col("p"), "left")
    decl = F.coalesce("declaration", F.lit(False))
    empty = F.array().cast("array<struct<name:string,value:bigint>>")
    return both.select(
        "cu_offset",
        "goff",
        F.when(decl, "enum_decl").otherwise("enum").alias("kind"),
        "name",
        F.when(~decl & F.col("type_ref").isNull(), F.col("byte_size")).alias("byte_size"),
        F.when(~decl, F.col("type_ref")).alias("base_goff"),
        F.when(~decl, F.coalesce("enumerators", empty)).alias("enumerators"),
    )


def template_args(die: DataFrame) -> DataFrame:
    """(goff, template_args): types, constants and statics in order; packs are taken apart in place."""
    tags = ["template_type_parameter", "template_value_parameter", "template_type_param", "template_value_param"]
    own = _children(die, tags).select("parent", "ord", F.lit(0).alias("inner"), "tag", "const_value", "type_ref")
    packs = _children(die, ["GNU_template_parameter_pack", "template_parameter_pack"]).select(F.col("goff").alias("pack"), F.col("parent").alias("owner"), F.col("ord").alias("outer"))
    inner = own.join(packs, F.col("parent") == F.col("pack"))
    flat = inner.select(F.col("owner").alias("parent"), F.col("outer").alias("ord"), F.col("ord").alias("inner"), "tag", "const_value", "type_ref")
    flat = flat.unionByName(own.join(packs, F.col("parent") == F.col("pack"), "left_anti"))
    is_type = F.col("tag").contains("type_param")
    arg = F.struct(
        F.when(is_type, "type").when(F.col("const_value").isNotNull(), "const").otherwise("static").alias("k"),
        F.when(~is_type, F.col("const_value")).alias("c"),
        F.when(is_type, T.base(_ref())).alias("ty"),
    )
    return flat.groupBy(F.col("parent").alias("goff")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "inner", arg.alias("a")))), lambda s: s["a"]).alias("template_args"))


def members_of(die: DataFrame, config: Config, *, union: bool = False, number: int | None = None) -> DataFrame:
    """(goff, ord, offset, name, type_ref, is_base, is_vfptr, bits) of structs, or of unions, cleaned up.

    number: of all members, if it is known.
    """
    tags = ["union_type"] if union else ["structure_type", "class_type"]
    owner = die.where(F.col("tag").isin(*tags)).select(F.col("goff").alias("owner"))
    children = _children(die, MEMBERS)
    number = children.count() if number is None else number
    raw = spread(children, number, "parent").where(~F.coalesce("external", F.lit(False))).join(spread(owner, number, "owner"), F.col("parent") == F.col("owner"))
    vfptr, _ = rewrite_vfptr(F.col("name"), F.coalesce("member_loc", F.lit(0)), config.vfptr_pattern)
    rows = raw.select(
        F.col("owner").alias("goff"),
        "ord",
        F.coalesce("member_loc", F.lit(0)).alias("offset"),
        F.when(~vfptr & (F.col("tag") == "member"), F.col("name")).alias("name"),
        F.when(vfptr, F.lit(PRIM_ID[config.pointer_prim])).otherwise(_ref()).alias("type_ref"),
        (F.col("tag") == "inheritance").alias("is_base"),
        vfptr.alias("is_vfptr"),
        F.when(F.col("bit_size").isNotNull(), F.coalesce("byte_size", (F.col("bit_size") + 7).cast("long") / 8).cast("long")).alias("bits"),
        F.col("bit_size").isNotNull().alias("is_bitfield"),
    )
    if union:
        kept = dedupe_by_type(rows, group="goff", kind="type_ref", name="name", order="ord")
        return kept.join(rows.drop("name"), ["goff", "type_ref", "ord"])
    rows = merge_bitfields(rows, group="goff", order=["ord"], offset="offset", is_bitfield="is_bitfield")
    return drop_empty_bases(rows, group="goff", offset="offset", is_base="is_base", order=["ord"])


def load_compounds(die: DataFrame, config: Config) -> DataFrame:
    """Structs and unions with members ordered by (offset, is_base), virtual tables and template arguments."""
    own = die.where("tag in ('structure_type', 'class_type', 'union_type')")
    number = _children(die, MEMBERS).count()
    every = spread(members_of(die, config, number=number).unionByName(members_of(die, config, union=True, number=number)), number, "goff")
    special = F.when(F.col("is_base"), "base").when(F.col("is_vfptr"), "vfptr").when(F.col("is_bitfield"), "bitfield")
    member = F.struct("offset", "name", T.base(F.col("type_ref")).alias("ty"), special.alias("special"), F.col("bits").cast("int").alias("bf_size"))
    listed = every.groupBy("goff").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col("is_base").cast("int").alias("b"), "ord", member.alias("m")))), lambda s: s["m"]).alias("members"))
    virtual = die.where("tag = 'subprogram'").withColumn("idx", vtable_index(F.col("virtuality"), F.col("vtable_idx"))).where("idx is not null")
    sigs = signatures(die, virtual).select(F.col("goff").alias("f"), F.transform("types", lambda r: F.array(F.struct(F.lit("base").alias("op"), r.alias("ref"), F.lit(None).cast("int").alias("n")))).alias("types"))
    entries = virtual.join(sigs, F.col("goff") == F.col("f")).groupBy(F.col("parent").alias("v")).agg(F.array_sort(F.collect_list(F.struct("idx", "name", "types"))).alias("vtable"))
    both = spread(own, number, "goff").join(listed.withColumnRenamed("goff", "m"), F.col("goff") == F.col("m"), "left").join(entries, F.col("goff") == F.col("v"), "left")
    both = both.join(template_args(die).withColumnRenamed("goff", "t"), F.col("goff") == F.col("t"), "left")
    what = F.when(F.col("tag") == "union_type", "union").otherwise("struct")
    decl = F.coalesce("declaration", F.lit(False))
    return both.select("cu_offset", "goff", F.when(decl, F.concat(what, F.lit("_decl"))).otherwise(what).alias("kind"), "name", F.when(~decl, F.col("byte_size")).alias("byte_size"), "members", "vtable", "template_args")


def load_types(die: DataFrame, config: Config) -> DataFrame:
    """All type rows of all units, and the primitives once."""
    prims = primitive_table(die.sparkSession).select(F.lit(None).cast("long").alias("cu_offset"), "goff", F.lit("prim").alias("kind"), F.col("prim").alias("name"), F.col("byte_size").cast("long").alias("byte_size"))
    parts = [load_simple(die, config), load_arrays(die), load_subroutines(die), load_member_pointers(die), load_enums(die), load_compounds(die, config), prims]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def repeated_ids(types: DataFrame) -> DataFrame:
    return types.groupBy("goff").count().where("count > 1").select("goff", F.lit("repeated id").alias("rule"), F.col("count").cast("string").alias("detail"))


def load_symbols(die: DataFrame, listing: DataFrame) -> DataFrame:
    """(cu_offset, link_name, address, ty, param_names, template_args) of listed variables and functions.

    Variables take type and linkage name from their specification; functions need an
    address or to be inlined; names and types of functions fall back to their origin,
    then their specification.  Symbols that are not listed are left out.
    """
    own = die.where("tag in ('variable', 'subprogram')")
    full = own
    for attribute in ("linkage_name", "name", "type_ref"):
        found = fallback(own.select("goff", attribute, "origin_ref", "spec_ref"), attribute).select(F.col("goff").alias("g"), F.col(attribute).alias("x_"))
        full = full.drop(attribute).join(found, F.col("goff") == F.col("g")).drop("g").withColumnRenamed("x_", attribute)
    inlined = fallback(own.select("goff", "inline_code", "origin_ref", "spec_ref"), "inline_code").select(F.col("goff").alias("g"), F.col("inline_code").alias("inl"))
    full = full.join(inlined, F.col("goff") == F.col("g")).drop("g").where("linkage_name is not null")
    address = listing.select(F.col("symbol").alias("s"), "address")
    data = full.where("tag = 'variable'").select("cu_offset", "goff", "linkage_name", T.base(_ref()).alias("ty"), F.array().cast("array<string>").alias("param_names"))
    functions = full.where((F.col("tag") == "subprogram") & ~F.coalesce("declaration", F.lit(False)) & (F.col("low_pc").isNotNull() | is_inlined(F.col("inl"))))
    params = _children(die, "formal_parameter")
    names = fallback(die.where("tag = 'formal_parameter'").select("goff", "name", "origin_ref", "spec_ref"), "name").select(F.col("goff").alias("pg"), F.col("name").alias("pname"))
    kinds = fallback(die.where("tag = 'formal_parameter'").select("goff", "type_ref", "origin_ref", "spec_ref"), "type_ref").select(F.col("goff").alias("tg"), F.col("type_ref").alias("ptype"))
    args = params.join(names, F.col("goff") == F.col("pg")).join(kinds, F.col("goff") == F.col("tg"))
    args = args.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("ptype", F.lit(VOID)).alias("t"), F.coalesce("pname", F.lit("")).alias("n")))).alias("args"))
    typed = functions.join(args.withColumnRenamed("parent", "p"), F.col("goff") == F.col("p"), "left")
    given = F.coalesce("args", F.array().cast("array<struct<ord:int,t:bigint,n:string>>"))
    sub = _sub_tree(F.concat(F.array(_ref()), F.transform(given, lambda s: s["t"])))
    code = typed.select("cu_offset", "goff", "linkage_name", sub.alias("ty"), fill_param_names(F.transform(given, lambda s: s["n"])).alias("param_names"))
    both = data.unionByName(code).join(template_args(die).withColumnRenamed("goff", "t"), F.col("goff") == F.col("t"), "left")
    return both.join(address, F.col("linkage_name") == F.col("s")).select("cu_offset", F.col("linkage_name").alias("link_name"), "address", "ty", "param_names", "template_args")


def base_name(die: DataFrame) -> DataFrame:
    return die.select("goff", untemplated(F.col("name")).alias("base"))
