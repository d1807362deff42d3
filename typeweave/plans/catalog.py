"""Queries on the driver's tables, with their SQL.

The tables hold no debug information, so each query applies an operator of the
type graph to a stand-in relation: parts hang under `p_partkey div 2` unless
divisible by 7, orders stand for structs and their lines for members, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.functions import names as N
from typeweave.functions import notation
from typeweave.functions import tokens as T
from typeweave.operators import dedupe, flatten, gc, layout, merge, namespace, resolve, symbols
from typeweave.operators.components import connected_components
from typeweave.operators.fixpoint import spread
from typeweave.plans.extract import kind_counts
from typeweave.sources.package import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


LINK = "SELECT *, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey // 2 END AS parent FROM part"
WALK = f"""
WITH RECURSIVE link AS ({LINK}),
walk AS (
  SELECT p_partkey AS k, p_partkey AS at_, 0::BIGINT AS depth FROM link
  UNION ALL SELECT w.k, l.parent, w.depth + 1 FROM walk w JOIN link l ON w.at_ = l.p_partkey WHERE l.parent IS NOT NULL
), ends AS (SELECT k AS p_partkey, arg_max(at_, depth) AS root, max(depth) AS depth FROM walk GROUP BY k)
"""
# Kinds that parts stand for, and whether they are declarations.
CLASS = "CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN 'struct' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'union' ELSE 'enum' END"


def linked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("parent", F.expr("if(p_partkey % 7 = 0, null, p_partkey div 2)"))


def kinded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.expr(CLASS), F.when(F.col("p_size") < 5, "_decl").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("goff"), kind.alias("kind"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size")


@query(
    "q02_listing_last_wins",
    "SELECT o_custkey::VARCHAR AS symbol, (arg_max(o_orderkey, o_orderkey) - 10)::BIGINT AS address FROM orders WHERE o_orderkey >= 10 GROUP BY o_custkey",
)
def q02(spark, d):
    line = F.concat_ws(",", F.conv(F.col("o_orderkey").cast("string"), 10, 16), F.lit("x"), F.col("o_custkey").cast("string"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("value"))
    return symbols.parse_listing(lines, address_column=0, symbol_column=2, base=10)[0]


@query("q02_listing_audit", "SELECT o_orderkey AS goff, 'address out of range' AS rule, o_custkey::VARCHAR AS detail FROM orders WHERE o_orderkey < 10")
def q02_audit(spark, d):
    line = F.concat_ws(",", F.conv(F.col("o_orderkey").cast("string"), 10, 16), F.lit("x"), F.col("o_custkey").cast("string"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("value"))
    return symbols.parse_listing(lines, address_column=0, symbol_column=2, base=10)[1]


@query("q03_alias_chase", WALK + "SELECT p_partkey, root, depth FROM ends")
def q03(spark, d):
    return resolve.chase(linked_parts(spark, d), key="p_partkey", target="parent")


@query("q04_flag_propagation", WALK + "SELECT ends.p_partkey, part.p_type FROM ends JOIN part ON part.p_partkey = ends.root")
def q04(spark, d):
    parts = linked_parts(spark, d)
    return resolve.carry(parts.select("p_partkey", "p_type"), parts, "p_type", key="p_partkey", target="parent").select("p_partkey", "p_type")


@query(
    "q05_size_resolution",
    f"""WITH RECURSIVE link AS ({LINK}), sized AS (
  SELECT p_partkey, p_size::BIGINT AS byte_size FROM link WHERE parent IS NULL
  UNION ALL SELECT l.p_partkey, s.byte_size * (1 + l.p_size % 3) FROM sized s JOIN link l ON l.parent = s.p_partkey
) SELECT p_partkey AS goff, byte_size FROM sized""",
)
def q05(spark, d):
    parts = linked_parts(spark, d)
    rows = parts.select(
        F.col("p_partkey").alias("goff"),
        F.when(F.col("parent").isNull(), F.col("p_size")).cast("long").alias("byte_size"),
        F.lit(None).cast("long").alias("target"),
        F.when(F.col("parent").isNotNull(), T.arr(T.base(F.col("parent")), 1 + F.col("p_size") % 3)).alias("tree"),
    )
    return resolve.resolve_sizes(rows)


@query(
    "q06_union_size_audit",
    "SELECT l_orderkey AS goff, 'union size' AS rule, count(*) || ' <> ' || max(l_linenumber) AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber)",
)
def q06(spark, d):
    lines = table(spark, d, "lineitem")
    unions = lines.groupBy(F.col("l_orderkey").alias("goff")).agg(F.count("*").alias("byte_size"))
    members = lines.select(F.col("l_orderkey").alias("goff"), F.col("l_linenumber").cast("long").alias("ref"))
    sizes = members.select(F.col("ref").alias("goff"), F.col("ref").alias("byte_size")).distinct()
    return resolve.check_union_sizes(unions, members, sizes)


@query(
    "q07_ordered_members",
    "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS members FROM lineitem GROUP BY l_orderkey",
)
def q07(spark, d):
    lines = table(spark, d, "lineitem")
    made = layout.ordered_members(lines, group="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey"], value=F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey"))
    return made.withColumn("members", F.array_join("members", ","))


@query(
    "q08_empty_bases",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'R', l_partkey, l_suppkey) AS rn FROM lineitem
) WHERE rn = 1 OR l_returnflag <> 'R'""",
)
def q08(spark, d):
    lines = table(spark, d, "lineitem").withColumn("is_base", F.col("l_returnflag") == "R")
    kept = layout.drop_empty_bases(lines, group="l_orderkey", offset="l_linenumber", is_base="is_base", order=["l_partkey", "l_suppkey"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "q08_bitfield_runs",
    """SELECT user_id, event_id, event_type FROM (
  SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events
) WHERE NOT (event_type IN ('view', 'click') AND coalesce(after = event_type, false))""",
)
def q08_runs(spark, d):
    events = table(spark, d, "events").withColumn("bits", F.col("event_type").isin("view", "click"))
    return layout.merge_bitfields(events, group="user_id", order=["ts", "event_id"], offset="event_type", is_bitfield="bits").select("user_id", "event_id", "event_type")


@query("q08_collisions", "SELECT l_orderkey AS goff, 'members collide' AS rule, l_linenumber::VARCHAR AS detail FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def q08_collisions(spark, d):
    lines = table(spark, d, "lineitem").withColumn("is_base", F.col("l_returnflag") == "R")
    return layout.colliding_members(lines, group="l_orderkey", offset="l_linenumber", is_base="is_base")


@query("q09_content_dedupe", "SELECT doc_id AS goff, min(doc_id) OVER (PARTITION BY text) AS primary_id FROM documents")
def q09(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("goff"), "text")
    return dedupe.content_dedupe(rows)[1].withColumnRenamed("primary", "primary_id")


@query(
    "q10_dedupe_fixpoint",
    f"""WITH RECURSIVE link AS ({LINK}), path AS (
  SELECT p_partkey, p_brand || '|' || p_type AS sig FROM link WHERE parent IS NULL
  UNION ALL SELECT l.p_partkey, p.sig || '/' || l.p_brand || '|' || l.p_type FROM path p JOIN link l ON l.parent = p.p_partkey
) SELECT p_partkey AS goff, min(p_partkey) OVER (PARTITION BY sig) AS primary_id FROM path""",
)
def q10(spark, d):
    rows = linked_parts(spark, d).select(F.col("p_partkey").alias("goff"), "p_brand", "p_type", "parent")
    return dedupe.content_dedupe(rows, refs=("parent",))[1].withColumnRenamed("primary", "primary_id")


def part_groups(spark, d):
    edges = linked_parts(spark, d).select(F.col("p_partkey").alias("src"), F.coalesce("parent", "p_partkey").alias("dst"))
    return connected_components(edges)


def kinded_groups(spark, d):
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_type")
    return part_groups(spark, d).join(kinds.hint("merge"), "node")  # all parts: not for a broadcast


@query("q11_components", WALK + "SELECT p_partkey AS node, root AS component FROM ends")
def q11(spark, d):
    return part_groups(spark, d)


@query(
    "q12_primaries",
    WALK
    + """SELECT root AS component, coalesce(max(CASE WHEN p_type = 'PROMO' THEN p_partkey END), min(p_partkey)) AS primary_id
FROM ends JOIN part USING (p_partkey) GROUP BY root""",
)
def q12(spark, d):
    return dedupe.primaries(kinded_groups(spark, d), F.col("p_type") == "PROMO").withColumnRenamed("primary", "primary_id")


@query(
    "q12_two_primitives",
    WALK + "SELECT root AS goff, 'two primitives' AS rule, count(*)::VARCHAR AS detail FROM ends JOIN part USING (p_partkey) WHERE p_type = 'PROMO' GROUP BY root HAVING count(*) > 1",
)
def q12_audit(spark, d):
    return dedupe.two_primitives(kinded_groups(spark, d), F.col("p_type") == "PROMO")


SWEEP = f"""WITH RECURSIVE link AS ({LINK}), alive AS (
  SELECT p_partkey, parent FROM link WHERE {{roots}}
  UNION SELECT l.p_partkey, l.parent FROM alive a JOIN link l ON a.parent = l.p_partkey
) SELECT DISTINCT p_partkey FROM alive"""


@query("q13_sweep_referenced", SWEEP.format(roots="p_size > 40 OR p_type = 'PROMO'"))
def q13(spark, d):
    parts = linked_parts(spark, d)
    up = parts.where("parent is not null").select(F.col("p_partkey").alias("src"), F.col("parent").alias("dst"))
    own = parts.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"))
    roots = parts.where("p_size > 40").select(F.col("p_partkey").alias("goff"))
    return gc.sweep(parts.select("p_partkey"), up.unionByName(own), roots, key="p_partkey")


@query("q13_sweep_reachable", SWEEP.format(roots="p_size > 40"))
def q13_reachable(spark, d):
    parts = linked_parts(spark, d)
    up = parts.where("parent is not null").select(F.col("p_partkey").alias("src"), F.col("parent").alias("dst"))
    return gc.sweep(parts.select("p_partkey"), up, parts.where("p_size > 40").select(F.col("p_partkey").alias("goff")), key="p_partkey", mode="reachable")


@query("q14_name_index", f"SELECT {CLASS} AS kind_class, p_name AS name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS goffs FROM part GROUP BY ALL")
def q14(spark, d):
    return merge.name_index(kinded_parts(spark, d)).withColumn("goffs", F.array_join("goffs", ","))


@query(
    "q15_star_edges",
    f"""SELECT p_partkey AS src, coalesce(min(CASE WHEN p_size >= 5 THEN p_partkey END) OVER w, min(p_partkey) OVER w) AS dst
FROM part WINDOW w AS (PARTITION BY {CLASS}, p_name)""",
)
def q15(spark, d):
    return merge.star_edges(kinded_parts(spark, d))


def merged_parts(spark, d):
    parts = kinded_parts(spark, d)
    bucket = connected_components(merge.star_edges(parts)).select(F.col("node").alias("goff"), "component")
    rows = parts.select("goff", "kind", "name", F.array("p_brand").alias("other_names"), F.col("p_size").alias("byte_size"), F.lit(None).cast("array<string>").alias("members"))
    return merge.merged_types(rows, bucket)


MERGED = f"""SELECT min(p_partkey) AS goff, k || CASE WHEN bool_or(p_size >= 5) THEN '' ELSE '_decl' END AS kind, p_name AS name,
  array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS other_names,
  coalesce(arg_min(p_size, p_partkey) FILTER (WHERE p_size >= 5), arg_min(p_size, p_partkey)) AS byte_size
FROM (SELECT *, {CLASS} AS k FROM part) GROUP BY k, p_name"""


@query("q16_merge_types", MERGED)
def q16(spark, d):
    return merged_parts(spark, d).select("goff", "kind", "name", F.array_join("other_names", ",").alias("other_names"), "byte_size")


@query("q16_merge_counts", f"SELECT kind, count(*) AS n FROM ({MERGED}) GROUP BY kind")
def q16_counts(spark, d):
    return kind_counts(merged_parts(spark, d))


@query(
    "q18_dangling",
    """SELECT o_orderkey AS goff, 'dangling reference' AS rule, o_custkey::VARCHAR AS detail FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""",
)
def q18(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return merge.dangling(edges, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("goff")))


HOPS = """WITH RECURSIVE edge AS (
  SELECT n_nationkey::BIGINT AS src, (n_nationkey // 2)::BIGINT AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_regionkey = 0
), reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src) """


def nation_edges(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), "n_regionkey")
    one, two = n.withColumn("dst", F.expr("src div 2")), n.where("n_regionkey = 0").withColumn("dst", (F.col("src") * 3 + 1) % 25)
    return one.unionByName(two).select("src", "dst").distinct()


@query("q19_closure", HOPS + "SELECT src, dst FROM reach")
def q19(spark, d):
    return merge.closure(nation_edges(spark, d))


@query("q19_without_mutual", HOPS + "SELECT src, dst FROM edge WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.src = edge.dst AND reach.dst = edge.src)")
def q19_mutual(spark, d):
    return merge.without_mutual(nation_edges(spark, d))


def slots(spark, d):
    orders = table(spark, d, "orders").withColumn("slot", F.substring("o_orderpriority", 1, 1).cast("long"))
    return layout.merge_slots(orders, group="o_custkey", index="slot", name="o_orderstatus", order="o_orderkey")


@query("q21_slot_merge", "SELECT o_custkey, substr(o_orderpriority, 1, 1)::BIGINT AS slot, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL")
def q21(spark, d):
    return slots(spark, d)[0]


@query(
    "q21_slot_conflicts",
    """SELECT o_custkey AS goff, 'virtual table entries differ' AS rule, substr(o_orderpriority, 1, 1) AS detail FROM orders
GROUP BY o_custkey, substr(o_orderpriority, 1, 1) HAVING count(DISTINCT o_orderstatus) > 1""",
)
def q21_audit(spark, d):
    return slots(spark, d)[1]


def order_symbols(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(
        F.col("o_orderkey").alias("cu_offset"),
        F.col("o_custkey").cast("string").alias("link_name"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("address"),
        F.col("o_orderstatus").alias("ty"),
        F.array("o_orderstatus").alias("param_names"),
        F.when(F.col("o_totalprice") > 250000, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("template_args"),
    )


@query(
    "q22_symbol_link",
    """SELECT o_custkey::VARCHAR AS link_name, min(o_orderkey) AS cu_offset, arg_min(substr(o_orderpriority, 1, 1)::BIGINT, o_orderkey) AS address,
  arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_totalprice > 250000) AS template_arg FROM orders GROUP BY o_custkey""",
)
def q22(spark, d):
    return symbols.link_symbols(order_symbols(spark, d))[0].select("link_name", "cu_offset", "address", F.get("template_args", F.lit(0)).alias("template_arg"))


@query(
    "q22_symbol_audit",
    """SELECT min_key AS goff, rule, o_custkey::VARCHAR AS detail FROM (
  SELECT o_custkey, min(o_orderkey) AS min_key, count(DISTINCT substr(o_orderpriority, 1, 1)) AS a, count(DISTINCT o_orderstatus) AS b FROM orders GROUP BY o_custkey
), (VALUES ('addresses differ'), ('parameters differ'), ('types differ')) r(rule) WHERE CASE WHEN rule = 'addresses differ' THEN a ELSE b END > 1""",
)
def q22_audit(spark, d):
    return symbols.link_symbols(order_symbols(spark, d))[1]


@query(
    "q23_overlay",
    """SELECT coalesce(s.k, c.k)::VARCHAR AS symbol, coalesce(s.a, c.a) AS address
FROM (SELECT s_nationkey AS k, min(s_suppkey) AS a FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, min(c_custkey) AS a FROM customer GROUP BY 1) c ON s.k = c.k""",
)
def q23(spark, d):
    data = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("symbol"), F.col("c_custkey").alias("address"))
    functions = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("symbol"), F.col("s_suppkey").alias("address"))
    return symbols.overlay(data, functions)


@query(
    "q25_members_by_type",
    """SELECT source, lang, arg_min(quality::VARCHAR, doc_id) FILTER (WHERE quality IS NOT NULL) AS name, min(doc_id) AS ord
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""",
)
def q25(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = both.select("source", "lang", F.col("quality").cast("string").alias("name"), F.col("doc_id").alias("ord"))
    return layout.dedupe_by_type(rows, group="source", kind="lang", name="name", order="ord")


@query(
    "q26_fallback_chain",
    f"""WITH RECURSIVE link AS ({LINK}), walk AS (
  SELECT p_partkey AS k, p_partkey AS at_, 0 AS depth FROM part
  UNION ALL SELECT w.k, l.parent, w.depth + 1 FROM walk w JOIN link l ON w.at_ = l.p_partkey WHERE l.parent IS NOT NULL AND l.p_size >= 20
) SELECT k AS goff, arg_max(CASE WHEN p_size < 20 THEN p_name END, depth) FILTER (WHERE p_size < 20) AS name FROM walk JOIN part ON at_ = p_partkey GROUP BY k""",
)
def q26(spark, d):
    rows = linked_parts(spark, d).select(F.col("p_partkey").alias("goff"), F.when(F.col("p_size") < 20, F.col("p_name")).alias("name"), F.col("parent").alias("origin_ref"), F.lit(None).cast("long").alias("spec_ref"))
    return resolve.fallback(rows, "name").select("goff", "name")


@query(
    "q27_namespace_paths",
    """SELECT r_regionkey::BIGINT AS goff, r_name AS path FROM region
UNION ALL SELECT 1000 + n_nationkey, r_name || '::' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000000 + c_custkey, r_name || '::' || n_name || '::' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def q27(spark, d):
    none = F.lit(None)
    node = lambda df, goff, parent, name, depth: df.select(
        F.lit(0).cast("long").alias("cu_offset"), goff.cast("long").alias("goff"), parent.cast("long").alias("parent"), F.lit(depth).alias("depth"), F.lit("namespace").alias("tag"), F.col(name).alias("name"), none.cast("string").alias("linkage_name")
    )
    die = node(table(spark, d, "region"), F.col("r_regionkey"), none, "r_name", 0)
    die = die.unionByName(node(table(spark, d, "nation"), F.col("n_nationkey") + 1000, F.col("n_regionkey"), "n_name", 1))
    die = die.unionByName(node(table(spark, d, "customer"), F.col("c_custkey") + 1000000, F.col("c_nationkey") + 1000, "c_name", 2))
    own = die.select(F.col("goff").alias("g"), "name")
    found = namespace.paths(die).join(own, F.col("goff") == F.col("g"))
    return found.select("goff", N.cpp_source(F.col("qualifier"), F.col("name")).alias("path"))


@query(
    "q28_ambiguous_sources",
    r"""SELECT cu_offset, src FROM (SELECT DISTINCT doc_id % 3 AS cu_offset, source || '::' || lang AS src FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)""",
)
def q28(spark, d):
    segment = lambda c: F.struct(F.lit("namespace").alias("k"), F.lit(None).cast("bigint").alias("goff"), F.col(c).alias("s"), F.lit(False).alias("linkage"))
    spaces = table(spark, d, "documents").where("source is not null and lang is not null").select((F.col("doc_id") % 3).alias("cu_offset"), F.array(segment("source"), segment("lang")).alias("namespace"))
    return namespace.source_index(spaces)[0].select("cu_offset", "src")


@query(
    "q29_name_functions",
    r"""SELECT page_id, CASE WHEN strpos(n, '::') > 0 THEN regexp_extract(n, '^(.*)::', 1) END AS ns, regexp_extract(n, '^(?:.*::)?(.*)$', 1) AS base,
  split_part(replace(url, '?', '<'), '<', 1) AS untemplated, list_transform(string_split(split_part(n, '?', 1), '::'), lambda x: trim(x))[1] AS first_part
FROM (SELECT *, replace(url, '/', '::') AS n FROM pages)""",
)
def q29(spark, d):
    name = F.replace(F.col("url"), F.lit("/"), F.lit("::"))
    cut = N.split_namespace(name)
    first = F.get(N.parse_namespace(F.substring_index(name, "?", 1)), F.lit(0))
    return table(spark, d, "pages").select("page_id", cut["ns"].alias("ns"), cut["base"].alias("base"), N.untemplated(F.replace(F.col("url"), F.lit("?"), F.lit("<"))).alias("untemplated"), first.alias("first_part"))


def mangling_sql(column: str) -> str:
    out = column
    for c, code in N.MANGLED.items():
        out = "replace({}, '{}', '{}')".format(out, c.replace("'", "''"), code)
    return f"'{N.MANGLE_PREFIX}' || {out} || '$$' || strlen({column}) || '_'"


@query("q30_mangling", f"SELECT page_id, {mangling_sql('url')} AS ident FROM pages")
def q30(spark, d):
    return table(spark, d, "pages").select("page_id", N.mangle(F.col("url")).alias("ident"))


@query(
    "q31_preference_key",
    """SELECT p_partkey, (CASE WHEN p_type LIKE 'PROMO%' THEN 0 WHEN regexp_matches(p_type, 'A.D$') THEN 1 ELSE 2 END * 65536
  + CASE WHEN p_type LIKE '%MALL' THEN 1 WHEN p_type LIKE '%L%' THEN 2 ELSE 0 END)::BIGINT AS sort_key FROM part""",
)
def q31(spark, d):
    rules = N.Rules.of(["^PROMO", "A.D$", "<default>", "MALL$", "L"])
    return table(spark, d, "part").select("p_partkey", rules.key(F.col("p_type")).alias("sort_key"))


@query(
    "q32_permutations",
    "SELECT DISTINCT a.p_size, a.p_brand || '/' || b.p_type AS spelling FROM (SELECT DISTINCT p_size, p_brand FROM part) a JOIN (SELECT DISTINCT p_size, p_type FROM part) b USING (p_size)",
)
def q32(spark, d):
    sets = table(spark, d, "part").groupBy("p_size").agg(F.array(F.collect_set("p_brand"), F.collect_set("p_type")).alias("choices"))
    return sets.select("p_size", F.explode(N.permute_columns(F.col("choices"))).alias("w")).select("p_size", F.array_join("w", "/").alias("spelling"))


@query(
    "q33_variant_positions",
    "SELECT c_custkey, array_to_string(list_filter(range(1, length(c_name)), lambda i: c_name[i] = '0' AND c_name[i + 1] IN ('1', '2', '3')), ',') AS places FROM customer",
)
def q33(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(N.variant_positions(F.col("c_name"), "0", "123"), ",").alias("places"))


@query(
    "q34_parameter_names",
    """SELECT conv_id, string_agg(CASE WHEN turn % 3 = 0 THEN 'a' || (rn - 1) ELSE role END, ',' ORDER BY rn) AS names
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) GROUP BY conv_id""",
)
def q34(spark, d):
    rows = table(spark, d, "conversations").withColumn("given", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")))
    lists = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "given"))), lambda s: s["given"]).alias("names"))
    return lists.select("conv_id", F.array_join(N.fill_param_names(F.col("names")), ",").alias("names"))


PER_ORDER = """SELECT o_orderkey, count(l_orderkey) AS n, count(DISTINCT l_returnflag) AS types, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) FILTER (WHERE l_discount < 0.05) AS unnamed,
  min(l_linenumber) AS d1, max(l_linenumber) AS d2, coalesce(bool_or(l_tax > 0.075), false) AS loops, count(*) FILTER (WHERE l_returnflag = 'R') AS virt, coalesce(bool_and(l_linestatus = 'F'), false) AS base
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


def per_order(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    number = orders.count() + lines.count()
    both = spread(orders, number, "o_orderkey").join(spread(lines, number, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("o_orderkey").agg(
        F.count("l_orderkey").alias("n"),
        F.count_distinct("l_returnflag").alias("types"),
        F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"),
        F.count_if(F.col("l_discount") < 0.05).alias("unnamed"),
        F.min("l_linenumber").alias("d1"),
        F.max("l_linenumber").alias("d2"),
        F.coalesce(F.bool_or(F.col("l_tax") > 0.075), F.lit(False)).alias("loops"),
        F.count_if(F.col("l_returnflag") == "R").alias("virt"),
        F.coalesce(F.bool_and(F.col("l_linestatus") == "F"), F.lit(False)).alias("base"),
    )


@query(
    "q35_union_rules",
    f"""SELECT o_orderkey, CASE WHEN n = 0 THEN 'empty struct' WHEN n = 1 AND NOT loops THEN 'member' WHEN types = 1 AND NOT loops THEN 'only type' WHEN n = 2 AND lo <> hi THEN 'larger'
  WHEN n = 2 AND unnamed = 1 THEN 'unnamed' WHEN n = 2 AND d1 <> d2 THEN 'deeper' ELSE 'keep' END AS action FROM ({PER_ORDER})""",
)
def q35(spark, d):
    c = F.col
    return per_order(spark, d).select("o_orderkey", layout.union_action(c("n"), c("types"), c("lo"), c("hi"), c("unnamed"), c("d1"), c("d2"), c("loops")).alias("action"))


@query(
    "q36_struct_rules",
    f"""SELECT o_orderkey, CASE WHEN n = 1 AND base AND lo > 10 THEN 'inline base' WHEN n = 1 AND NOT base AND virt = 0 AND NOT loops THEN 'member' ELSE 'keep' END AS action FROM ({PER_ORDER})""",
)
def q36(spark, d):
    c = F.col
    return per_order(spark, d).select("o_orderkey", layout.struct_action(c("n"), c("virt"), c("base"), c("loops"), c("lo") > 10).alias("action"))


def part_trees(spark, d):
    leaf = F.struct(F.lit("base").alias("op"), F.col("p_name").alias("name"), F.lit(None).cast("int").alias("n"))
    star = F.struct(F.lit("ptr").alias("op"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("n"))
    many = F.struct(F.lit("arr").alias("op"), F.lit(None).cast("string").alias("name"), F.col("p_size").alias("n"))
    arg = F.struct(F.lit("base").alias("op"), F.lit("u32").alias("name"), F.lit(None).cast("int").alias("n"))
    call = F.struct(F.lit("sub").alias("op"), F.lit(None).cast("string").alias("name"), F.lit(2).alias("n"))
    shape = F.col("p_size") % 4
    tree = F.when(shape == 0, F.array(leaf)).when(shape == 1, F.array(leaf, star)).when(shape == 2, F.array(leaf, many, star)).otherwise(F.array(leaf, arg, call, star))
    return table(spark, d, "part").select("p_partkey", tree.cast(notation.NAMED_TREE).alias("tree"))


NOTATION = """'[ ''"' || p_name || '"''' || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ',''*''' WHEN 2 THEN ',[' || p_size || '],''*''' ELSE ',''()'',[[ u32 ]],''*''' END || ' ]'"""


@query("q37_notation", f"SELECT p_partkey, {NOTATION} AS notation FROM part")
def q37(spark, d):
    return part_trees(spark, d).select("p_partkey", notation.notation(F.col("tree")).alias("notation"))


@query(
    "q38_notation_round_trip",
    f"""SELECT p_partkey, {NOTATION} AS again, p_name || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN '[' || p_size || ']*' ELSE ' (*)(u32)' END AS shown FROM part""",
)
def q38(spark, d):
    read = part_trees(spark, d).select("p_partkey", notation.parse(notation.notation(F.col("tree"))).alias("tree"))
    return read.select("p_partkey", notation.notation(F.col("tree")).alias("again"), notation.display(F.col("tree")).alias("shown"))


def order_trees(spark, d):
    lines = table(spark, d, "lineitem")
    made = layout.ordered_members(spread(lines, lines.count(), "l_orderkey"), group="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey"], value=F.col("l_partkey"))
    tokens = F.transform("members", lambda r: F.struct(F.lit("base").alias("op"), r.alias("ref"), F.lit(None).cast("int").alias("n")))
    return made.select("l_orderkey", F.concat(tokens, F.array(T.token("sub", None, F.size("members")))).alias("tree"))


@query(
    "q40_remap",
    """SELECT l_orderkey, string_agg(r::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids
FROM lineitem JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS r FROM part) ON l_partkey = p_partkey GROUP BY l_orderkey""",
)
def q40(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("goff"), "p_name")
    mapping = dedupe.content_dedupe(rows)[1]
    number = table(spark, d, "lineitem").count()  # of ids; each order has one token more
    return T.remap(order_trees(spark, d), "tree", mapping, key="l_orderkey", number=number).select("l_orderkey", F.array_join(T.refs(F.col("tree")), ",").alias("ids"))


@query("q40_reference_extraction", "SELECT DISTINCT l_orderkey, l_partkey AS ref FROM lineitem")
def q40_refs(spark, d):
    return T.explode_refs(order_trees(spark, d), "l_orderkey", "tree")


@query(
    "q41_flatten",
    WALK
    + """SELECT p_partkey AS goff, root AS leaf, depth AS stars FROM ends""",
)
def q41(spark, d):
    parts = linked_parts(spark, d)
    trees = parts.where("parent is not null").select(F.col("p_partkey").alias("goff"), T.ptr(T.base(F.col("parent"))).alias("tree"))
    roots = parts.where("parent is null").select(F.col("p_partkey").alias("goff"), F.col("p_partkey").alias("leaf"), F.lit(0).cast("long").alias("stars"))
    flat = flatten.flatten_trees(trees)
    return flat.select("goff", F.get("tree", F.lit(0))["ref"].alias("leaf"), (F.size("tree") - 1).cast("long").alias("stars")).unionByName(roots)


def queries() -> dict[str, Query]:
    from typeweave.plans import loaders  # noqa: F401, PLC0415  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
