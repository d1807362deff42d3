"""All spellings of templated types, over the names that their arguments have."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from typeweave.functions import names as N
from typeweave.functions import tokens as T
from typeweave.operators.fixpoint import checkpointed


def _spelled(bases: pd.Series, args: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for base, own, names in zip(bases, args, known, strict=True):
        table = {int(k): frozenset(v) for k, v in (names.items() if isinstance(names, dict) else names if names is not None else [])}
        choices = []
        for a in own if own is not None else []:
            if a["k"] == "const":
                choices.append([str(int(a["c"]))])
            elif a["k"] == "static":
                choices.append(["[static]"])
            else:
                tree = [(t["op"], None if pd.isna(t["ref"]) else int(t["ref"]), None if pd.isna(t["n"]) else int(t["n"])) for t in a["ty"]]
                choices.append(sorted(N.tree_spellings(tree, table)))
        ways = itertools.islice((f"{base}<{', '.join(w)}>" for w in N.permute(choices)), N.MOST_SPELLINGS + 1)
        out.append(sorted(set(ways)))
    return pd.Series(out, dtype=object)


def spell(bases: Column, args: Column, known: Column) -> Column:
    """Spellings of a base name with template arguments, given the names of the ids in them (map<bigint, array<string>>)."""
    return F.pandas_udf(_spelled, ArrayType(StringType()))(bases, args, known)


def spellings(templated: DataFrame, names: DataFrame, *, max_rounds: int = 32) -> tuple[DataFrame, DataFrame]:
    """((goff, name) of templated types, audit rows of types with too many spellings).

    templated: (goff, base, template_args); names: (goff, name) of all other types.
    Arguments may be templated themselves: each round spells with the names of
    the round before, until nothing is new; what depends on itself alone has none.
    """
    rows = checkpointed(templated.select("goff", "base", "template_args"))
    inner = F.flatten(F.transform("template_args", lambda a: F.coalesce(T.refs(a["ty"]), F.array().cast("array<bigint>"))))
    needs = checkpointed(rows.select("goff", F.explode(inner).alias("ref")).distinct())
    fixed = checkpointed(names.groupBy("goff").agg(F.collect_set("name").alias("names")))
    found, before = rows.select("goff", F.array().cast("array<string>").alias("names")), -1
    for _ in range(max_rounds):
        known = fixed.unionByName(found).where(F.size("names") > 0).select(F.col("goff").alias("ref"), "names")
        per_type = needs.join(known, "ref").groupBy("goff").agg(F.map_from_entries(F.collect_list(F.struct("ref", "names"))).alias("known")).withColumnRenamed("goff", "g")
        made = rows.join(per_type, F.col("goff") == F.col("g"), "left")
        found = checkpointed(made.select("goff", spell(F.col("base"), F.col("template_args"), F.col("known")).alias("names")))
        now = found.agg(F.sum(F.size("names")).alias("n")).first()["n"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"spellings did not settle in {max_rounds} rounds")
    many = found.where(F.size("names") > N.MOST_SPELLINGS)
    audit = many.select("goff", F.lit("too many spellings").alias("rule"), F.size("names").cast("string").alias("detail"))
    return found.select("goff", F.explode(F.slice("names", 1, N.MOST_SPELLINGS)).alias("name")), audit
