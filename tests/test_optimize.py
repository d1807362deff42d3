from pyspark.sql import functions as F

from typeweave.functions import names as N
from typeweave.functions import tokens as T
from typeweave.functions.notation import complexity, parse_notation
from typeweave.operators import optimize
from typeweave.sources.caches import type_documents

MEMBER = f"goff long, ord int, name string, ty {T.TREE}, special string"


def base(r):
    return [("base", r, None)]


def build(spark):
    types = spark.createDataFrame(
        [(1, "prim", 4, 0), (2, "prim", 8, 0), (10, "union", 0, 0), (11, "union", 4, 0), (12, "union", 4, 0), (13, "union", 8, 0), (14, "union", 8, 0), (15, "struct", 4, 0), (16, "struct", 8, 0), (17, "struct", 8, 1), (18, "struct", 16, 0), (19, "struct", 16, 0), (20, "union", 8, 0)],
        "goff long, kind string, byte_size long, n_virtual int",
    )
    ptr = [("ptr", None, None)]
    members = spark.createDataFrame(
        [
            (11, 0, "a", base(1), None),
            (12, 0, "a", base(1), None),
            (12, 1, "b", base(1), None),
            (13, 0, "a", base(1), None),
            (13, 1, "b", base(2), None),
            (14, 0, "a", base(2), None),
            (14, 1, None, base(2) + ptr, None),
            (15, 0, "u", base(11), None),
            (16, 0, "self", base(16) + ptr, None),
            (17, 0, "x", base(2), None),
            (18, 0, "p", base(2), None),
            (18, 1, "q", base(14), None),
            (19, 0, None, base(18), "base"),
            (20, 0, "a", base(20) + ptr, None),
        ],
        MEMBER,
    )
    return types, members


def test_rewrites(spark):
    types, members, moved = optimize.simplify(*build(spark))
    kinds = {r["goff"]: (r["kind"], r["byte_size"]) for r in types.collect()}
    assert kinds == {1: ("prim", 4), 2: ("prim", 8), 10: ("struct", 1), 16: ("struct", 8), 17: ("struct", 8), 18: ("struct", 16), 19: ("struct", 16), 20: ("union", 8)}
    went = {r["goff"]: [tuple(t) for t in r["tree"]] for r in moved.collect()}
    assert went == {11: base(1), 12: base(1), 13: base(2), 14: [*base(2), ("ptr", None, None)], 15: base(1)}
    left = {(r["goff"], r["ord"]): [tuple(t) for t in r["ty"]] for r in members.collect()}
    assert left[18, 1] == left[19, 1] == [*base(2), ("ptr", None, None)]


def test_complexity_equals_recursive(spark):
    texts = ["[ u8 ]", "[ u8,'*',[3] ]", "[ u8,'()',[[ u8,'*','*' ]] ]", "[ u8,'*','()',[[ u8 ],[ u8 ]],'*' ]", "[ u8,'\"C\"','::','*' ]", "[ u8,'()',[],'\"C\"','::','()',[[ u8,'*' ]],'*' ]"]
    rows = [(t, [(op, 1 if name else None, n) for op, name, n in parse_notation(t)]) for t in texts]
    got = {r["t"]: r["c"] for r in spark.createDataFrame(rows, f"t string, tree {T.TREE}").select("t", T.complexity(F.col("tree")).alias("c")).collect()}
    assert got == {t: complexity(parse_notation(t)) for t in texts}


def test_virtual_tables_of_bases(spark):
    entries = spark.createDataFrame([(1, 0, "f"), (1, 1, "g"), (2, 1, "h"), (3, 2, "k")], "goff long, idx long, name string")
    bases = spark.createDataFrame([(2, 1), (3, 2)], "goff long, base long")
    got = sorted(tuple(r) for r in optimize.inherit_vtables(entries, bases).where("goff = 3").collect())
    assert got == [(3, 0, "f", True), (3, 1, "h", True), (3, 2, "k", False)]


def test_statistics(spark):
    df = spark.createDataFrame([("tree", base(1) + [("ptr", None, None)]), ("tree", base(1)), ("enum", None)], f"kind string, tree {T.TREE}")
    got = {r["kind"]: (r["plain"], r["base"], r["ptr"]) for r in optimize.kind_statistics(df).collect()}
    assert got == {"tree": (None, 1, 1), "enum": (1, None, None)}


def test_names_as_json(spark):
    text = "a::B<int (*)(C&), 3, V<bool>*>"
    name = N.parse_name(text)
    assert N.from_json(N.to_json(name)) == name
    rows = spark.createDataFrame([(text,), ("<",), (None,)], "n string").select(N.parsed_names(F.col("n")).alias("p")).collect()
    assert rows[0]["p"]["json"] == N.to_json(name) and rows[1]["p"]["error"] and rows[2]["p"]["json"] is None


def test_documents(spark):
    df = spark.createDataFrame(
        [(1, "struct", "S", 8, [(0, "a", "[ u32 ]"), (4, None, "[ u8,'*' ]")], None), (2, "enum", None, 4, None, [("A", 1)])],
        "goff long, kind string, name string, byte_size long, members array<struct<offset:long,name:string,text:string>>, enumerators array<struct<name:string,value:long>>",
    )
    got = {r["goff"]: r["document"] for r in type_documents(df).collect()}
    assert got[1] == "kind: struct\nname: S\nsize: 8\nmembers:\n  - [ 0, a, [ u32 ] ]\n  - [ 4, null, [ u8,'*' ] ]\n"
    assert got[2] == "kind: enum\nname: null\nsize: 4\nvalues:\n  A: 1\n"
