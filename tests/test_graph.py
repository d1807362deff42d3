import random

import pytest
from pyspark.sql import functions as F

from typeweave.functions import tokens as T
from typeweave.functions.prims import PRIM_ID
from typeweave.operators import dedupe, flatten, gc, layout, merge, resolve
from typeweave.operators.components import connected_components
from typeweave.operators.resolve import CycleError


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
    assert rows(connected_components(df), "node", "component") == brute_components(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_primary_prefers_primitives(spark):
    edges = spark.createDataFrame([(1, 2), (2, PRIM_ID["u8"]), (7, 8), (PRIM_ID["i8"], PRIM_ID["i16"])], "src long, dst long")
    got = dict(rows(dedupe.buckets_of(edges), "goff", "primary"))
    assert got[1] == got[2] == PRIM_ID["u8"] and got[8] == 7
    assert dedupe.two_primitives(connected_components(edges)).count() == 1


def test_chase_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 99)] + [(i, i + 1) for i in range(200, 500)], "goff long, target long")
    got = {r["goff"]: (r["root"], r["depth"]) for r in resolve.chase(links).collect()}
    assert got[1] == (3, 2) and got[3] == (3, 0) and got[4] == (99, 1) and got[200] == (500, 300)
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (5, 6)], "goff long, target long")
    with pytest.raises(CycleError):
        resolve.chase(loop)
    free = {r["goff"]: r["root"] for r in resolve.chase(loop, strict=False).collect()}
    assert free == {1: None, 2: None, 3: None, 5: 6}


def test_alias_rules(spark):
    types = spark.createDataFrame(
        [(1, "struct", "S", None), (2, "typedef", "A", 1), (3, "alias", "x", 2), (4, "typedef", "B", 3), (5, "tree", None, None), (6, "typedef", "P", 5), (7, "typedef", "C", 4)],
        "goff long, kind string, name string, target long",
    )
    got = rows(resolve.resolve_aliases(types), "goff", "kind", "target")
    assert dict((g, (k, t)) for g, k, t in got)[4] == ("typedef", 1)
    named = {r["goff"]: (r["kind"], r["name"]) for r in resolve.resolve_aliases(types).collect()}
    assert named[6] == ("alias", None) and named[7] == ("typedef", "C") and named[3] == ("alias", None)


def test_flatten_keeps_all_arguments(spark):
    b = lambda r: T.base(r)
    df = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(10).cast("long").alias("goff"), T.sub(b(1), b(11), b(2), b(11), b(3)).alias("tree")),
                F.struct(F.lit(11).cast("long").alias("goff"), T.ptr(b(12)).alias("tree")),
                F.struct(F.lit(12).cast("long").alias("goff"), T.arr(b(4), 1).alias("tree")),
                F.struct(F.lit(13).cast("long").alias("goff"), T.ptmd(9, b(14)).alias("tree")),
                F.struct(F.lit(14).cast("long").alias("goff"), T.sub(b(1), b(2)).alias("tree")),
            )
        ).alias("r")
    ).select("r.*")
    got = {r["goff"]: [(t["op"], t["ref"], t["n"]) for t in r["tree"]] for r in flatten.flatten_trees(df).collect()}
    p = [("base", 4, None), ("ptr", None, None)]
    assert got[10] == [("base", 1, None), *p, ("base", 2, None), *p, ("base", 3, None), ("sub", None, 5)]
    assert got[12] == [("base", 4, None)]
    assert got[13] == [("base", 1, None), ("base", 2, None), ("ptmf", 9, 2)]
    loop = spark.range(1).select(F.lit(1).cast("long").alias("goff"), T.ptr(b(1)).alias("tree"))
    with pytest.raises(CycleError):
        flatten.flatten_trees(loop, max_rounds=5)


def test_sizes(spark):
    df = spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(g).cast("long").alias("goff"), F.lit(s).cast("long").alias("byte_size"), F.lit(t).cast("long").alias("target"), tree.alias("tree"))
                    for g, s, t, tree in [
                        (1, 4, None, F.lit(None).cast(T.TREE)),
                        (2, None, None, T.arr(T.arr(T.base(1), 3), 5)),
                        (3, None, None, T.arr(T.ptr(T.base(1)), 2)),
                        (4, None, 2, F.lit(None).cast(T.TREE)),
                        (5, None, None, T.sub(T.base(1))),
                        (6, None, None, T.ptmf(1, T.base(1))),
                        (7, None, None, T.arr(T.base(4), 2)),
                    ]
                ]
            )
        ).alias("r")
    ).select("r.*")
    assert dict(rows(resolve.resolve_sizes(df, pointer=8, ptmd=8, ptmf=16), "goff", "byte_size")) == {1: 4, 2: 60, 3: 16, 4: 60, 5: None, 6: 16, 7: 120}


def test_content_dedupe_remaps_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", 1), (4, "y", 2), (5, "z", 4), (6, "z", 3), (7, "self", 7), (8, "self", 8)], "goff long, c string, ref long")
    kept, bucket = dedupe.content_dedupe(df, refs=("ref",))
    assert [(r["goff"], r["ref"]) for r in kept.orderBy("goff").collect()] == [(1, None), (3, 1), (5, 3), (7, 7), (8, 8)]
    assert dict(rows(bucket, "goff", "primary")) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8}
    again, same = dedupe.content_dedupe(kept, refs=("ref",))
    assert again.count() == kept.count() and same.where("goff <> primary").count() == 0
    shuffled, _ = dedupe.content_dedupe(df.repartition(3).orderBy(F.desc("goff")), refs=("ref",))
    assert {r["goff"] for r in shuffled.collect()} == {r["goff"] for r in kept.collect()}


def test_sweep_modes(spark):
    types = spark.createDataFrame([(i,) for i in range(1, 7)], "goff long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (5, 6)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "goff long")
    assert rows(gc.sweep(types, edges, roots), "goff") == [(1,), (2,), (3,), (4,)]
    assert rows(gc.sweep(types, edges, roots, mode="reachable"), "goff") == [(1,), (2,), (3,)]


def simulate(types, names, refs):
    """Groups by brute force: union all pairs of one kind class and name, and the pairs that merged definitions imply."""
    pairs = [(a, b) for a, ka, na in names for b, kb, nb in names if a < b and na == nb and ka.removesuffix("_decl") == kb.removesuffix("_decl")]
    while True:
        group = dict(brute_components(pairs + [(g, g) for g, _ in types]))
        new = {(min(x, y), max(x, y)) for a, ra in refs.items() for b, rb in refs.items() if group[a] == group[b] for p in ra for x, y in [(ra[p], rb.get(p))] if y is not None and x != y}
        new = {p for p in new if group[p[0]] != group[p[1]]}
        if not new:
            return group
        pairs += sorted(new)


@pytest.mark.parametrize("seed", range(2))
def test_merge_by_name_equals_pairwise_simulation(spark, seed):
    rng = random.Random(seed)
    types, names, refs = [], [], {}
    shapes = {n: [rng.randrange(6) for _ in range(2)] for n in range(6)}
    for unit in range(3):
        ids = {n: 100 * unit + n + 1 for n in range(6)}
        for n, g in ids.items():
            decl = rng.random() < 0.3
            kind = "struct_decl" if decl else "struct"
            types.append((g, kind))
            if decl or rng.random() < 0.7:
                names.append((g, kind, f"N{n}"))
            if not decl:
                refs[g] = {p: ids[m] for p, m in enumerate(shapes[n])}
    want = simulate(types, names, refs)
    t = spark.createDataFrame([(g, k, "s") for g, k in types], "goff long, kind string, shape string")
    n = spark.createDataFrame(names, "goff long, kind string, name string")
    r = spark.createDataFrame([(g, str(p), x) for g, ps in refs.items() for p, x in ps.items()], "goff long, place string, ref long")
    bucket, _ = merge.merge_groups(t, n, r)
    assert dict(rows(bucket, "goff", "component")) == want


def test_merged_types_and_slots(spark):
    types = spark.createDataFrame(
        [(3, "struct_decl", "a::S", ["X"], None, None), (5, "struct", None, ["Y"], 8, ["m"]), (7, "struct", "S", [], 8, ["n"])],
        "goff long, kind string, name string, other_names array<string>, byte_size long, members array<string>",
    )
    bucket = spark.createDataFrame([(3, 3), (5, 3), (7, 3)], "goff long, component long")
    r = merge.merged_types(types, bucket).first()
    assert (r["goff"], r["kind"], r["name"], r["other_names"], r["members"]) == (3, "struct", "S", ["X", "Y", "a::S"], ["m"])
    entries = spark.createDataFrame([(1, 0, "f", 1), (1, 0, "g", 2), (1, 2, "~S", 1), (1, 3, "~S", 2)], "s long, idx long, name string, u long")
    merged, audit = layout.merge_slots(entries, group="s", index="idx", name="name", order="u")
    assert rows(merged, "idx", "name") == [(0, "f"), (2, "~S")] and audit.count() == 1


def test_destructor_places():
    assert layout.place_destructors([(0, "f"), (1, "~S"), (2, None), (3, "g")], "S") == [(0, "f"), (1, "~SD1"), (2, "~SD0"), (3, "g")]
    with pytest.raises(ValueError):
        layout.place_destructors([(0, "f"), (2, "g")], "S")


def test_layout_cleaning(spark):
    m = spark.createDataFrame(
        [(1, 0, 0, False, True), (1, 1, 0, False, True), (1, 2, 4, False, False), (1, 3, 4, True, False), (1, 4, 8, False, True), (1, 5, 12, False, True)],
        "s long, ord int, offset long, is_base boolean, bits boolean",
    )
    runs = layout.merge_bitfields(m, group="s", order=["ord"], offset="offset", is_bitfield="bits")
    assert [r["ord"] for r in runs.orderBy("ord").collect()] == [1, 2, 3, 4, 5]
    bases = layout.drop_empty_bases(runs, group="s", offset="offset", is_base="is_base", order=["ord"])
    assert [r["ord"] for r in bases.orderBy("ord").collect()] == [1, 2, 4, 5]


def test_links_and_orphans(spark):
    t = spark.createDataFrame([(1, "struct", "S"), (2, "struct_decl", "S"), (3, "enum_decl", "S")], "goff long, kind string, name string")
    assert rows(merge.link_declarations(t).fillna(-1), "decl", "definition") == [(2, 1), (3, -1)]
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "goff long, name string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    assert rows(merge.named_orphans(pairs, names), "goff", "detail") == [(1, "2")]
    n = spark.createDataFrame([(1, "struct", "x"), (2, "struct", "x"), (3, "struct_decl", "x")], "goff long, kind string, name string")
    assert rows(merge.candidate_pairs(n), "a", "b") == [(1, 2), (1, 3), (2, 3)]
