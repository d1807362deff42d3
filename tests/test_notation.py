"""The text notation of types, against a second, recursive rendering of random types."""

import random

import pytest

from typeweave.functions.notation import NotationError, complexity, parse_notation, to_display, to_notation
from typeweave.functions.prims import CPP_NAME

NAMES = ["Shape", "geo::Box<int, 3>", "std::pair<geo::Point, Shape *>", "_x9"]


def some_type(rng, depth):
    """(notation inside the brackets, display, complexity, whether it is a function) of a random type."""
    kind = rng.choice(["leaf", "pointer", "array", "function", "member", "method"]) if depth else "leaf"
    if kind == "leaf":
        if rng.random() < 0.5:
            prim = rng.choice(list(CPP_NAME))
            return prim, prim, 0, False
        name = rng.choice(NAMES)
        return f"'\"{name}\"'", name, 0, False
    if kind in ("function", "method"):
        ret = some_type(rng, depth - 1)
        while ret[3]:
            ret = some_type(rng, depth - 1)
        args = [some_type(rng, depth - 1) for _ in range(rng.randrange(3))]
        listed, shown = ",".join(f"[ {a[0]} ]" for a in args), ", ".join(a[1] for a in args)
        if kind == "function":
            return f"{ret[0]},'()',[{listed}]", f"{ret[1]}({shown})", ret[2] + 1, True
        owner = rng.choice(NAMES)
        return f"{ret[0]},'\"{owner}\"','::','()',[{listed}],'*'", f"{ret[1]} ({owner}::*)({shown})", ret[2] + 2, False
    inner = some_type(rng, depth - 1)
    while inner[3] and kind != "pointer":
        inner = some_type(rng, depth - 1)
    if kind == "array":
        n = rng.choice([1, 12, 4096])
        return f"{inner[0]},[{n}]", f"{inner[1]}[{n}]", inner[2] + 1, False
    if kind == "member":
        owner = rng.choice(NAMES)
        return f"{inner[0]},'\"{owner}\"','::','*'", f"{inner[1]} {owner}::*", inner[2] + 2, False
    text = f"{inner[0]},'*'"
    if inner[3]:
        at = split_arguments(inner[1])
        return text, f"{inner[1][:at]} (*){inner[1][at:]}", inner[2] + 1, False
    return text, inner[1] + "*", inner[2] + 1, False


def split_arguments(shown):
    """Where the last parenthesis that is open at the end begins."""
    level = 0
    for i in range(len(shown) - 1, -1, -1):
        level += (shown[i] == ")") - (shown[i] == "(")
        if level == 0:
            return i
    raise AssertionError(shown)


@pytest.mark.parametrize("seed", range(6))
def test_random_types(seed):
    rng = random.Random(seed)
    for _ in range(120):
        inside, shown, depth, _ = some_type(rng, rng.randrange(5))
        tokens = parse_notation(f"[ {inside} ]")
        assert (to_notation(tokens), to_display(tokens), complexity(tokens)) == (f"[ {inside} ]", shown, depth)
        assert parse_notation(to_notation(tokens)) == tokens


def test_spacing_does_not_matter():
    assert parse_notation("[i16,   '*' ,[ 3 ]]") == parse_notation("[ i16,'*',[3] ]")


@pytest.mark.parametrize("bad", ["[[ i8 ]", "i8 ]", "[ i8 i8 ]", "[ '*' ]", "[ word ]", "[ i8,[-] ]", "[ i8,'()',[ i8 ] ]"])
def test_broken_text(bad):
    with pytest.raises(NotationError):
        parse_notation(bad)


def test_columns(spark):
    from pyspark.sql import functions as F

    from typeweave.functions import notation

    df = spark.createDataFrame([(1, "[ '\"geo::Box\"',[8],'*' ]"), (2, "[ no"), (3, None)], "id int, t string")
    read = notation.parse(F.col("t"))
    rows = df.orderBy("id").select(notation.notation(read).alias("a"), notation.display(read).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("[ '\"geo::Box\"',[8],'*' ]", "geo::Box[8]*"), (None, None), (None, None)]
