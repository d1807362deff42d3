import pytest
from pyspark.sql import functions as F

from typeweave.functions import names as N


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_string_functions(spark):
    assert one(spark, N.untemplated(F.col("n")), n="a<b<c>>") == "a"
    assert one(spark, N.without_anonymous(F.col("n")), n="a::(anonymous namespace)::b") == "a::b"
    assert tuple(one(spark, N.split_namespace(F.col("n")), n="a::b::c")) == ("a::b", "c")
    assert tuple(one(spark, N.split_namespace(F.col("n")), n="c")) == (None, "c")
    assert one(spark, N.parse_namespace(F.col("n")), n="a:: b") == ["a", "b"]
    assert one(spark, N.parse_namespace(F.col("n")), n="a<b>::c") is None


def test_mangling_is_a_single_pass_and_counts_bytes(spark):
    assert one(spark, N.mangle(F.col("n")), n="a$<b") == "____stage0_parse_a$$$ltb$$4_"
    assert one(spark, N.mangle(F.col("n")), n="é::x y") == "____stage0_parse_é$$2_x$spy$$3_"


def test_variant_positions(spark):
    assert one(spark, N.variant_positions(F.col("n"), "C", "123"), n="_ZN3FooC1EvC2") == [8, 12]
    assert one(spark, N.variant_positions(F.col("n"), "D", "012"), n="D") == []


def test_parameter_names_pass_over_taken_numbers(spark):
    assert one(spark, N.fill_param_names(F.col("n")), n=["", "a0", "", "x"]) == ["a1", "a0", "a2", "x"]
    assert one(spark, N.fill_param_names(F.col("n")), n=[]) == []


def test_rules():
    rules = N.Rules.of(["^std", "^app", "<default>", "_t$", "__"])
    order = sorted(["__x", "b_t", "app::c", "plain", "std::d"], key=rules.key_of)
    assert order == ["std::d", "app::c", "plain", "b_t", "__x"]
    assert rules.check([("std::d", "plain"), ("plain", "std::d")]) == ["plain is not preferred to std::d"]
    with pytest.raises(Exception):
        N.Rules.of(["("])


def test_permutations(spark):
    assert N.permute([]) == []
    assert N.permute([["a", "b"], ["c", "d"]]) == [("a", "c"), ("b", "c"), ("a", "d"), ("b", "d")]
    df = spark.createDataFrame([([["a", "b"], ["c", "d"], ["e"]],), ([["a"], []],), ([],)], "x array<array<string>>")
    got = [sorted(map(tuple, r["y"])) for r in df.select(N.permute_columns(F.col("x")).alias("y")).collect()]
    assert got == [sorted(N.permute([["a", "b"], ["c", "d"], ["e"]])), [], []]


def test_spellings_over_aliases_and_self_reference():
    name = lambda base, *args, path=(): N.Name(tuple(path), base, tuple(args))
    names = {
        1: [name("Foo"), name("Bar")],
        2: [name("Box", ("type", (("base", 1, None), ("ptr", None, None))))],
        3: [name("Inner", path=[("type", 2, "Box", False)])],
        4: [name("Self"), name("Again", ("type", (("base", 4, None),)))],
        5: [name("F", ("const", 3), ("static", None), ("type", (("base", 1, None), ("base", 1, None), ("sub", None, 2), ("ptr", None, None))))],
    }
    known, capped = N.spellings(names, rounds=4)
    assert known[2] == {"Box<Foo*>", "Box<Bar*>"}
    assert known[3] == {"Box<Foo*>::Inner", "Box<Bar*>::Inner"}
    assert "Again<Self>" in known[4]
    assert "F<3, [static], Foo(*)(Bar)>" in known[5]
    assert not capped
    assert N.spellings({1: [name("A"), name("B"), name("C")]}, most=2)[1] == {1}


def test_only_anonymous_scope_has_no_spelling():
    known, _ = N.spellings({1: [N.Name((("anonymous", None, None, False),), "X")]})
    assert known[1] == frozenset()


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("a::B<int>", "a::B<i32>"),
        ("B<unsigned char*, 3>", "B<u8*, 3>"),
        ("B<const a::C&, true>", "B<a::C*, 1>"),
        ("B<void (*)(int, char)>", "B<void(*)(i32, i8)>"),
        ("B<int (C::*)(int)>", "B<i32 (C::*)(i32)>"),
        ("B<int C::*>", "B<i32 C::*>"),
        ("V<P<long, float>, int[4]>", "V<P<i64, f32>, i32[4]>"),
        ("V<long unsigned int>", "V<u64>"),
    ],
)
def test_name_parser(text, shown):
    class Known(dict):
        def get(self, key, default=()):
            return {key} if isinstance(key, str) else default

    assert set(N._name(N.parse_name(text), Known())) == {shown}


@pytest.mark.parametrize("bad", ["", "a::", "B<", "B<int", "1", "a b"])
def test_name_parser_rejects(bad):
    with pytest.raises(N.BadName):
        N.parse_name(bad)
