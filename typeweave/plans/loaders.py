"""Queries that load entry tables made of the driver's tables, with their SQL.

Orders stand for types or functions, their lines for members, parameters,
enumerators, bounds or template arguments, and parts for the types that these refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.functions import tokens as T
from typeweave.functions.prims import PRIM_ID
from typeweave.operators import load, merge, namespace, optimize
from typeweave.operators.fixpoint import spread
from typeweave.plans import extract
from typeweave.plans.catalog import query, table
from typeweave.sources import config

ENTRY = {
    "cu_offset": "long", "goff": "long", "parent": "long", "ord": "int", "depth": "int", "tag": "string", "name": "string", "linkage_name": "string",
    "type_ref": "long", "spec_ref": "long", "origin_ref": "long", "containing_ref": "long", "byte_size": "long", "bit_size": "long", "const_value": "long",
    "count": "long", "member_loc": "long", "encoding": "string", "declaration": "boolean", "external": "boolean", "inline_code": "string",
    "virtuality": "string", "vtable_idx": "long", "low_pc": "long",
}
#: Added to ids of lines, so that they differ from those of orders; lines of one order and number count by part and supplier.
LINE = 1 << 40
ORDER_BY = "l_linenumber, l_partkey, l_suppkey"


def entries(df: DataFrame, tag: str | Column, **columns: Column | str) -> DataFrame:
    """df as an entry table: the columns given, null in the others."""
    given = {"tag": F.lit(tag) if isinstance(tag, str) else tag, "cu_offset": F.lit(0)} | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*[given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in ENTRY.items()])


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with `place`, which orders those of an order as ORDER_BY does, and an id of their own."""
    place = F.col("l_linenumber").cast("int")
    own = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") % LINE - 2 * LINE
    return table(spark, d, "lineitem").withColumn("place", place).withColumn("line", own)


def unique_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line for each number of an order: that of the smallest part and supplier."""
    rows = lines(spark, d)
    rows = spread(rows, rows.count(), "l_orderkey")
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in ("l_orderkey", "l_linenumber")]), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("first"))
    return first.select("l_orderkey", "l_linenumber", "first.*")


UNIQUE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)"


@query(
    "q01_tag_filter",
    "SELECT event_id AS goff, CASE event_type WHEN 'view' THEN 'typedef' WHEN 'click' THEN 'pointer_type' ELSE 'union_type' END AS tag FROM events WHERE event_type IN ('view', 'click', 'purchase')",
)
def q01(spark, d):
    tag = F.when(F.col("event_type") == "view", "typedef").when(F.col("event_type") == "click", "pointer_type").when(F.col("event_type") == "purchase", "union_type").otherwise("subprogram")
    return load.type_entries(entries(table(spark, d, "events"), tag, goff="event_id")).select("goff", "tag")


@query("q39_kind_counts", "SELECT CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN 'struct' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'union' ELSE 'enum' END AS kind, count(*) AS n FROM part WHERE p_size >= 5 GROUP BY 1")
def q39(spark, d):
    kind = F.when(F.col("p_size") < 5, "prim").when(F.col("p_type").isin("STANDARD", "PROMO"), "struct").when(F.col("p_type").isin("LARGE", "MEDIUM"), "union").otherwise("enum")
    return extract.kind_counts(table(spark, d, "part").select(kind.alias("kind")))


@query(
    "q24_required_join",
    "SELECT o_orderkey AS cu_offset, o_custkey::VARCHAR AS cu_name, c_name AS argument FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
)
def q24(spark, d):
    return joined_units(spark, d)[0].select("cu_offset", "cu_name", F.get("arguments", F.lit(0)).alias("argument"))


@query(
    "q24_missing_commands",
    "SELECT o_orderkey AS goff, 'no compile command' AS rule, o_custkey::VARCHAR AS detail FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
)
def q24_missing(spark, d):
    return joined_units(spark, d)[1]


def joined_units(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("cu_offset"), F.col("o_custkey").cast("string").alias("cu_name"))
    commands = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("file"), F.array("c_name").alias("arguments"))
    return config.join_units(units, commands)


@query(
    "q17_shape_audit",
    """SELECT goff, 'definitions of one name differ' AS rule, n::VARCHAR || '/1' AS detail FROM (
  SELECT min(p_partkey) AS goff, count(DISTINCT CASE WHEN p_size >= 5 THEN p_size END) AS n FROM part
  GROUP BY p_name, CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN 'struct' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'union' ELSE 'enum' END) WHERE n > 1""",
)
def q17(spark, d):
    kind = F.when(F.col("p_type").isin("STANDARD", "PROMO"), "struct").when(F.col("p_type").isin("LARGE", "MEDIUM"), "union").otherwise("enum")
    none = F.lit(None)
    types = table(spark, d, "part").select(
        F.col("p_partkey").alias("goff"),
        F.concat(kind, F.when(F.col("p_size") < 5, "_decl").otherwise("")).alias("kind"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("long").alias("byte_size"),
        none.cast(f"array<struct<offset:bigint,name:string,ty:{T.TREE},special:string,bf_size:int>>").alias("members"),
        none.cast(f"array<struct<k:string,c:bigint,ty:{T.TREE}>>").alias("template_args"),
        none.cast("array<struct<name:string,value:bigint>>").alias("enumerators"),
    )
    refs = types.select("goff", F.lit("m0").alias("place"), F.col("goff").alias("ref")).limit(0)
    return merge.merge_groups(extract.shapes(types), types.select("goff", "kind", "name"), refs)[1]


@query(
    "q20_implied_pairs",
    f"""SELECT o_orderkey + k * {LINE} AS goff, min(o_orderkey) OVER (PARTITION BY o_custkey) + k * {LINE} AS component FROM orders, (VALUES (0), (1), (2)) t(k)""",
)
def q20(spark, d):
    """Orders of one customer share a name; what they refer to, and what that refers to, has none and is implied."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("name"))
    level = lambda k: F.col("o_orderkey") + k * LINE
    types = orders.select(F.explode(F.array(level(0), level(1), level(2))).alias("goff")).withColumn("kind", F.lit("struct")).withColumn("shape", F.lit("{}"))
    refs = orders.select(level(0).alias("goff"), level(1).alias("ref")).unionByName(orders.select(level(1).alias("goff"), level(2).alias("ref"))).withColumn("place", F.lit("m0"))
    names = orders.select(F.col("o_orderkey").alias("goff"), F.lit("struct").alias("kind"), "name")
    return merge.merge_groups(types, names, refs)[0]


@query(
    "q42_simple_types",
    f"""SELECT p_partkey AS goff, CASE p_partkey % 4 WHEN 0 THEN 'tree' WHEN 1 THEN 'alias' ELSE CASE WHEN parent IS NULL OR p_name LIKE 'a%' OR p_partkey % 4 = 3 THEN 'alias' ELSE 'typedef' END END AS kind,
  CASE WHEN p_partkey % 4 = 2 AND parent IS NOT NULL AND p_name NOT LIKE 'a%' THEN p_name END AS name,
  (CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 3 THEN {PRIM_ID['u64']} ELSE coalesce(parent, {PRIM_ID['void']}) END)::VARCHAR AS target,
  (CASE p_partkey % 4 WHEN 0 THEN coalesce(parent, {PRIM_ID['void']}) END)::VARCHAR AS pointee
FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey // 2 END AS parent FROM part)""",
)
def q42(spark, d):
    parent = F.expr("if(p_partkey % 7 = 0, null, p_partkey div 2)")
    kind = F.col("p_partkey") % 4
    tag = F.when(kind == 0, "pointer_type").when(kind == 1, "const_type").when(kind == 2, "typedef").otherwise("unspecified_type")
    die = entries(table(spark, d, "part"), tag, goff="p_partkey", name="p_name", type_ref=parent)
    out = load.load_simple(die, load.Config(abandon_typedefs=["^a"]))
    return out.select("goff", "kind", "name", F.col("target").cast("string").alias("target"), F.get("tree", F.lit(0))["ref"].cast("string").alias("pointee"))


@query(
    "q43_arrays",
    f"""SELECT o_orderkey AS goff, o_custkey AS element, coalesce(dims, '*') AS dims FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, 'x' ORDER BY l_linenumber DESC) AS dims FROM {UNIQUE} WHERE l_linenumber < 4 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def q43(spark, d):
    die = entries(table(spark, d, "orders"), "array_type", goff="o_orderkey", type_ref="o_custkey")
    die = die.unionByName(entries(unique_lines(spark, d).where("l_linenumber < 4"), "subrange_type", goff="line", parent="l_orderkey", ord="place", count="l_quantity"))
    tail = F.transform(F.slice("tree", 2, 100), lambda t: F.when(t["op"] == "ptr", "*").otherwise(t["n"].cast("string")))
    return load.load_arrays(die).select("goff", F.get("tree", F.lit(0))["ref"].alias("element"), F.array_join(tail, "x").alias("dims"))


def subroutine_entries(spark, d):
    die = entries(table(spark, d, "orders"), "subroutine_type", goff="o_orderkey", type_ref=F.expr("if(o_custkey % 5 = 0, null, o_custkey)"))
    part = F.expr("if(l_suppkey % 7 = 0, null, l_partkey)")
    return die.unionByName(entries(unique_lines(spark, d), "formal_parameter", goff="line", parent="l_orderkey", ord="place", type_ref=part))


@query(
    "q44_subroutines",
    f"""SELECT o_orderkey AS goff, concat_ws(',', CASE WHEN o_custkey % 5 = 0 THEN {PRIM_ID['void']} ELSE o_custkey END, args) AS types, 1 + coalesce(n, 0) AS n FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber) AS args, count(*)::INT AS n FROM {UNIQUE} WHERE l_suppkey % 7 <> 0 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def q44(spark, d):
    out = load.load_subroutines(subroutine_entries(spark, d))
    return out.select("goff", F.array_join(T.refs(F.col("tree")), ",").alias("types"), F.element_at("tree", -1)["n"].alias("n"))


@query(
    "q44_void_parameters",
    f"SELECT l_orderkey AS goff, 'void parameter among others' AS rule, count(*)::VARCHAR AS detail FROM {UNIQUE} GROUP BY l_orderkey HAVING count(*) > 1 AND bool_or(l_suppkey % 7 = 0)",
)
def q44_audit(spark, d):
    return load.void_parameter_audit(subroutine_entries(spark, d))


@query(
    "q45_enums",
    f"""SELECT o_orderkey AS goff, CASE WHEN o_orderstatus = 'P' THEN 'enum_decl' ELSE 'enum' END AS kind,
  CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 0 THEN '4' END AS byte_size, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 1 THEN o_custkey::VARCHAR END AS base_goff,
  CASE WHEN o_orderstatus <> 'P' THEN coalesce(list, '') END AS enumerators
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag || '=' || l_partkey, ',' ORDER BY l_linenumber) AS list FROM {UNIQUE} GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def q45(spark, d):
    own = entries(
        table(spark, d, "orders"), "enumeration_type", goff="o_orderkey", byte_size=F.lit(4), declaration=F.col("o_orderstatus") == "P", type_ref=F.expr("if(o_custkey % 2 = 1, o_custkey, null)")
    )
    die = own.unionByName(entries(unique_lines(spark, d), "enumerator", goff="line", parent="l_orderkey", ord="place", name="l_returnflag", const_value="l_partkey"))
    shown = F.array_join(F.transform("enumerators", lambda e: F.concat_ws("=", e["name"], e["value"].cast("string"))), ",")
    return load.load_enums(die).select("goff", "kind", F.col("byte_size").cast("string").alias("byte_size"), F.col("base_goff").cast("string").alias("base_goff"), shown.alias("enumerators"))


@query(
    "q46_template_arguments",
    f"""SELECT l_orderkey AS goff, string_agg(CASE WHEN l_returnflag = 'R' THEN 'type:' || l_partkey WHEN l_linestatus = 'F' THEN 'const:' || l_suppkey ELSE 'static' END, ',' ORDER BY l_linenumber) AS args FROM {UNIQUE} GROUP BY l_orderkey""",
)
def q46(spark, d):
    """Lines from the third on stand in a pack."""
    rows = unique_lines(spark, d)
    tag = F.when(F.col("l_returnflag") == "R", "template_type_parameter").otherwise("template_value_parameter")
    value = F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))
    pack = F.col("l_orderkey") + 4 * LINE
    own = entries(rows, tag, goff="line", parent=F.when(F.col("l_linenumber") < 3, F.col("l_orderkey")).otherwise(pack), ord="place", type_ref="l_partkey", const_value=value)
    packs = entries(rows.where("l_linenumber >= 3").select("l_orderkey").distinct(), "GNU_template_parameter_pack", goff=pack, parent="l_orderkey", ord=F.lit(3))
    shown = lambda a: F.when(a["k"] == "type", F.concat(F.lit("type:"), F.get(a["ty"], F.lit(0))["ref"].cast("string"))).when(a["k"] == "const", F.concat(F.lit("const:"), a["c"].cast("string"))).otherwise("static")
    return load.template_args(own.unionByName(packs)).select("goff", F.array_join(F.transform("template_args", shown), ",").alias("args"))


@query(
    "q47_compounds",
    f"""SELECT o_orderkey AS goff, CASE WHEN o_orderstatus = 'P' THEN 'struct_decl' ELSE 'struct' END AS kind, members FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(at_ || ':' || what || ':' || l_partkey, ',' ORDER BY at_, base, l_linenumber) AS members FROM (
  SELECT *, l_quantity::BIGINT AS at_, (l_returnflag = 'R')::INT AS base, CASE WHEN l_returnflag = 'R' THEN 'base' ELSE l_linestatus END AS what,
    row_number() OVER (PARTITION BY l_orderkey, l_quantity::BIGINT ORDER BY l_returnflag = 'R', l_linenumber) AS rn FROM {UNIQUE}
) WHERE rn = 1 OR base = 0 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def q47(spark, d):
    """Members at their quantity; bases that share it with another member are empty and go."""
    own = entries(table(spark, d, "orders"), "structure_type", goff="o_orderkey", declaration=F.col("o_orderstatus") == "P")
    base = F.col("l_returnflag") == "R"
    die = own.unionByName(entries(unique_lines(spark, d), F.when(base, "inheritance").otherwise("member"), goff="line", parent="l_orderkey", ord="place", name="l_linestatus", member_loc=F.col("l_quantity").cast("long"), type_ref="l_partkey"))
    shown = F.transform("members", lambda m: F.concat_ws(":", m["offset"].cast("string"), F.coalesce(m["special"], m["name"]), F.get(m["ty"], F.lit(0))["ref"].cast("string")))
    return load.load_compounds(die, load.Config()).select("goff", "kind", F.array_join(shown, ",").alias("members"))


@query(
    "q48_symbols",
    """SELECT o_orderkey AS cu_offset, c_name AS link_name, c_custkey + 100 AS address, c_nationkey AS ty FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""",
)
def q48(spark, d):
    """Orders are variables whose names and types are those of their customers, which they specify; listed are some customers."""
    customers = table(spark, d, "customer")
    die = entries(customers, "variable", goff=F.col("c_custkey") + LINE, linkage_name="c_name", type_ref="c_nationkey", declaration=F.lit(True), cu_offset=F.lit(-1))
    die = die.unionByName(entries(table(spark, d, "orders"), "variable", goff="o_orderkey", cu_offset="o_orderkey", spec_ref=F.col("o_custkey") + LINE))
    listing = customers.where("c_acctbal > 0").select(F.col("c_name").alias("symbol"), (F.col("c_custkey") + 100).alias("address"))
    found = load.load_symbols(die, listing).where("cu_offset >= 0")
    return found.select("cu_offset", "link_name", "address", F.get("ty", F.lit(0))["ref"].alias("ty"))


@query("q49_repeated_ids", "SELECT l_orderkey AS goff, 'repeated id' AS rule, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def q49(spark, d):
    return load.repeated_ids(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("goff")))


@query(
    "q50_namespace_lookup",
    """SELECT n_nationkey::BIGINT AS cu_offset, CASE WHEN n_nationkey % 2 = 0 THEN 'known' ELSE 'parsed' END AS way, n_name AS base, r_name AS ns FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def q50(spark, d):
    """Units of even nations know their region as a namespace; for the others the name is taken apart."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    unit = F.col("n_nationkey").cast("long")
    known = both.where("n_nationkey % 2 = 0")
    die = entries(known, "namespace", cu_offset=unit, goff=unit + LINE, depth=F.lit(0), name="r_name").unionByName(entries(known, "structure_type", cu_offset=unit, goff=unit, parent=unit + LINE, depth=F.lit(1), name="n_name"))
    spaces = namespace.paths(die)
    own = spaces.join(die.select(F.col("goff").alias("g"), "name", "tag"), F.col("goff") == F.col("g")).where("tag = 'namespace'")
    segment = F.struct(F.lit("namespace").alias("k"), F.lit(None).cast("bigint").alias("goff"), F.col("name").alias("s"), F.lit(False).alias("linkage"))
    index = namespace.source_index(own.select("cu_offset", F.concat("namespace", F.array(segment)).alias("namespace")))[0]
    names = both.select(unit.alias("cu_offset"), F.concat_ws("::", "r_name", "n_name").alias("name"))
    found = namespace.look_up(names, index)
    way = F.when(F.get("ns", F.lit(0))["k"] == "namespace", "known").otherwise("parsed")
    return found.select("cu_offset", way.alias("way"), "base", F.array_join(F.transform("ns", lambda s: s["s"]), "::").alias("ns"))


@query(
    "q51_union_rewrites",
    f"""WITH m AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS part, p_size::BIGINT AS size, CASE WHEN l_discount < 0.05 THEN NULL ELSE l_returnflag END AS name FROM {UNIQUE} JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2
), s AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT part) AS types, arg_min(part, l_linenumber) AS t1, arg_max(part, l_linenumber) AS t2, arg_min(size, l_linenumber) AS s1, arg_max(size, l_linenumber) AS s2,
    count(*) FILTER (WHERE name IS NULL) AS unnamed, arg_min(name IS NULL, l_linenumber) AS first_unnamed FROM m GROUP BY l_orderkey
) SELECT l_orderkey AS goff, CASE WHEN n = 1 OR types = 1 THEN t1 WHEN s1 <> s2 THEN CASE WHEN s1 > s2 THEN t1 ELSE t2 END ELSE CASE WHEN first_unnamed THEN t1 ELSE t2 END END AS became
FROM s WHERE n = 1 OR types = 1 OR s1 <> s2 OR unnamed = 1""",
)
def q51(spark, d):
    """Unions of one or two members give way to one of them, or stay."""
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("goff"), F.lit("union").alias("kind"), F.lit(None).cast("long").alias("byte_size"))
    parts = table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("goff"), F.lit("enum").alias("kind"), F.col("p_size").cast("long").alias("byte_size"))
    types = own.unionByName(parts).withColumn("n_virtual", F.lit(0).cast("long"))
    some = unique_lines(spark, d).where("l_linenumber <= 2").join(table(spark, d, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    members = some.select(
        F.col("l_orderkey").alias("goff"), F.col("place").alias("ord"), F.when(F.col("l_discount") >= 0.05, F.col("l_returnflag")).alias("name"),
        T.base(-1 - F.col("l_partkey")).alias("ty"), F.lit(None).cast("string").alias("special"), F.lit(None).cast("long").alias("size"),
    )
    moved = optimize.simplify(types, members)[2]
    return moved.select("goff", (-1 - F.get("tree", F.lit(0))["ref"]).alias("became"))
