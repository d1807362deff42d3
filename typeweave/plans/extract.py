"""The whole extraction: entries of debug information to merged types, symbols and counts.

Stages, over all units at once: load types and symbols; resolve aliases and sizes;
flatten type expressions; name types; drop repeated content and what no symbol or
name needs; merge by name across units; sweep again; count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.functions import tokens as T
from typeweave.functions.names import contains_anonymous, cpp_source, untemplated
from typeweave.functions.prims import BYTE_SIZE, is_prim
from typeweave.operators import audit, flatten, gc, load, merge, namespace, resolve, spelling, symbols
from typeweave.operators.fixpoint import checkpointed


@dataclass
class Extracted:
    """Types (goff, kind, name, other_names, byte_size, members), symbols, and everything that breaks a rule."""

    types: DataFrame
    symbols: DataFrame
    violations: DataFrame

    def counts(self) -> DataFrame:
        """(kind, n) of all types that are no primitives."""
        return kind_counts(self.types)


def kind_counts(types: DataFrame) -> DataFrame:
    return types.where("kind <> 'prim'").groupBy("kind").agg(F.count("*").alias("n"))


def member_refs(compounds: DataFrame) -> DataFrame:
    """(goff, place, tree): the type expressions of members, template arguments and virtual functions, by place."""
    m = compounds.select("goff", F.posexplode("members").alias("p", "m")).select("goff", F.concat(F.lit("m"), F.col("p").cast("string")).alias("place"), F.col("m.ty").alias("tree"))
    t = compounds.select("goff", F.posexplode("template_args").alias("p", "t")).where("t.ty is not null").select("goff", F.concat(F.lit("t"), F.col("p").cast("string")).alias("place"), F.col("t.ty").alias("tree"))
    v = compounds.select("goff", F.explode("vtable").alias("v")).select("goff", "v.idx", "v.name", F.posexplode("v.types").alias("p", "tree"))
    slot = F.when(F.col("name").startswith("~"), "dtor").otherwise(F.col("idx").cast("string"))
    v = v.select("goff", F.concat_ws(".", F.lit("v"), slot, F.col("p").cast("string")).alias("place"), "tree")
    return m.unionByName(t).unionByName(v)


def shapes(types: DataFrame) -> DataFrame:
    """(goff, kind, shape): what definitions must agree on to be one type, ids left out; virtual tables may be partial."""
    member = F.transform("members", lambda m: F.struct(m["offset"].alias("o"), m["name"].alias("n"), m["special"].alias("s"), m["bf_size"].alias("b"), T.shape(m["ty"]).alias("t")))
    args = F.transform("template_args", lambda a: F.struct(a["k"].alias("k"), a["c"].alias("c"), T.shape(a["ty"]).alias("t")))
    content = F.to_json(F.struct("byte_size", member.alias("m"), args.alias("a"), "enumerators"))
    return types.select("goff", "kind", F.when(~F.col("kind").endswith("_decl"), content).alias("shape"))


def extract(die: DataFrame, listing: DataFrame, config: load.Config, *, strict: bool = False) -> Extracted:
    """Everything from a die table and a symbol listing (symbol, address)."""
    raw = checkpointed(load.load_types(die, config))
    width = config.pointer_width // 8

    # aliases: every id that names an alias, or a typedef of a tree or primitive, means its root
    links = raw.select("goff", F.when(F.col("kind").isin("alias", "typedef"), F.col("target")).alias("target"))
    roots = checkpointed(resolve.chase(links).select("goff", F.col("root").alias("primary")).where("goff <> primary"))
    solid = raw.where("kind not in ('alias', 'typedef')").withColumn("row_", F.col("goff"))
    trees = solid.where("kind = 'tree'").select("goff", "tree")
    trees = T.remap(trees, "tree", roots, key="goff")
    flat = checkpointed(flatten.flatten_trees(trees))

    parts = member_refs(solid).withColumn("row_", F.concat_ws("/", F.col("goff").cast("string"), "place"))
    parts = flatten.flatten_column(T.remap(parts, "tree", roots, key="row_"), "tree", flat, key="row_")
    parts = checkpointed(parts.select("goff", "place", "tree"))

    sized = solid.select("goff", "byte_size", "tree", F.col("base_goff").alias("target"))
    sized = sized.drop("tree").join(flat.select(F.col("goff").alias("g"), "tree"), F.col("goff") == F.col("g"), "left").drop("g")
    sized = sized.join(roots.select(F.col("goff").alias("g"), "primary"), F.col("target") == F.col("g"), "left").withColumn("target", F.coalesce("primary", "target")).drop("g", "primary")
    sizes = resolve.resolve_sizes(sized, pointer=width, ptmd=_repr_size(config.ptmd_repr), ptmf=_repr_size(config.ptmf_repr))

    # rebuild compounds with flat trees
    flat_members = _rebuilt(solid, parts)
    types = flat_members.where("kind <> 'tree'").drop("byte_size").join(sizes, "goff")

    # names: own, and those of typedefs that end here
    spaces = namespace.paths(die).select(F.col("goff").alias("g"), F.col("qualifier"))
    named = raw.where("name is not null and kind <> 'prim'").join(spaces, F.col("goff") == F.col("g"), "left")
    full = F.when(~contains_anonymous(F.coalesce("qualifier", F.array().cast("array<struct<k:string,goff:bigint,s:string,linkage:boolean>>"))), cpp_source(F.col("qualifier"), F.col("name")))
    names = named.select("goff", "kind", full.alias("name"), F.col("name").contains("<").alias("templated")).where("name is not null")

    # a templated type is called by its arguments' names: those of primitives, of types, and of typedefs that end there
    plain = names.where("not templated").select("goff", "name").unionByName(raw.where("kind = 'prim'").select("goff", "name"))
    by_typedef = names.where("kind = 'typedef' and not templated").join(roots, "goff").select(F.col("primary").alias("goff"), "name")
    lasting = types.select("goff").join(by_typedef.where(~is_prim(F.col("goff"))), "goff")
    templated = names.where("templated and kind <> 'typedef'").select(F.col("goff").alias("g"), "kind", untemplated(F.col("name")).alias("base"))
    templated = templated.join(types.select("goff", "template_args"), F.col("goff") == F.col("g")).where("template_args is not null")
    spelled, too_many = spelling.spellings(templated, plain.unionByName(lasting))
    names = names.where("not templated").drop("templated").unionByName(spelled.join(templated.select("goff", "kind"), "goff").select("goff", "kind", "name"))
    typedefs = names.where("kind = 'typedef'").join(roots, "goff").select(F.col("primary").alias("root"), "name")
    kinds = types.select(F.col("goff").alias("root"), "kind").where("kind <> 'prim'")
    other = typedefs.join(kinds, "root").select(F.col("root").alias("goff"), "kind", "name")
    every_name = checkpointed(names.where("kind <> 'typedef'").unionByName(other).distinct())
    types = types.drop("name").join(names.where("kind <> 'typedef'").groupBy(F.col("goff").alias("g")).agg(F.min("name").alias("name")), F.col("goff") == F.col("g"), "left").drop("g")
    types = checkpointed(merge.attach_typedef_names(types.withColumn("other_names", F.array().cast("array<string>")), typedefs))

    own = load.load_symbols(die, listing)
    own = own.withColumn("row_", F.concat_ws("/", F.col("cu_offset").cast("string"), "link_name"))
    own = flatten.flatten_column(T.remap(own, "ty", roots, key="row_"), "ty", flat, key="row_").drop("row_")
    linked, symbol_audit = symbols.link_symbols(checkpointed(own))
    linked = checkpointed(linked)

    ids = checkpointed(parts.select("goff", "place", F.posexplode(T.refs(F.col("tree"))).alias("k", "ref")).select("goff", F.concat_ws("#", "place", F.col("k").cast("string")).alias("place"), "ref"))
    bucket, differ = merge.merge_groups(shapes(types), every_name, ids)
    bucket = checkpointed(bucket)
    rest = types.join(bucket.select("goff"), "goff", "left_anti").select("goff", F.col("goff").alias("component"))
    whole = checkpointed(merge.merged_types(types, bucket.unionByName(rest)))
    primary = checkpointed(bucket.join(merge.primaries(bucket.select(F.col("goff").alias("node"), "component")), "component").select("goff", "primary"))

    # what symbols need, directly or through members, stays
    to = primary.select(F.col("goff").alias("old"), "primary")
    edges = ids.join(to, F.col("goff") == F.col("old"), "left").select(F.coalesce("primary", "goff").alias("src"), "ref").join(to, F.col("ref") == F.col("old"), "left").select("src", F.coalesce("primary", "ref").alias("dst"))
    start = linked.select(F.explode(T.refs(F.col("ty"))).alias("r")).join(to, F.col("r") == F.col("old"), "left").select(F.coalesce("primary", "r").alias("goff"))
    kept = gc.sweep(whole, edges, start)
    broken = audit.union(load.repeated_ids(raw), load.vtable_audit(die), load.void_parameter_audit(die), differ, symbol_audit, too_many)
    if strict:
        audit.enforce(broken)
    return Extracted(checkpointed(kept), linked, broken)


def _repr_size(spec: tuple[str, int]) -> int:
    return (BYTE_SIZE[spec[0]] or 0) * spec[1]


def _rebuilt(types: DataFrame, parts: DataFrame) -> DataFrame:
    """types with the trees of their members, template arguments and virtual tables replaced by parts (goff, place, tree)."""
    by_place = parts.groupBy("goff").agg(F.map_from_entries(F.collect_list(F.struct("place", "tree"))).alias("by_place")).withColumnRenamed("goff", "g")
    both = types.join(by_place, F.col("goff") == F.col("g"), "left").drop("g")
    at = lambda key, old: F.coalesce(F.element_at("by_place", key), old)
    member = F.transform("members", lambda m, i: m.withField("ty", at(F.concat(F.lit("m"), i.cast("string")), m["ty"])))
    arg = F.transform("template_args", lambda a, i: a.withField("ty", F.when(a["ty"].isNotNull(), at(F.concat(F.lit("t"), i.cast("string")), a["ty"]))))
    return both.withColumn("members", member).withColumn("template_args", arg).drop("by_place", "row_")
