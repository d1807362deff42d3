"""Symbols: listings, variants of constructors and destructors, merging."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.functions.names import variant_positions
from typeweave.sources.caches import cached

MAX_ADDRESS = 0xFFFFFFFF


def parse_listing(lines: DataFrame, *, address_column: int, symbol_column: int, base: int = 0, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """(listing (symbol, address), audit rows) of (line_no, line), line numbers from 0.

    Cells are separated by commas, without quoting; addresses are hexadecimal
    (0x optional) or what Spark's conv makes of them, minus `base`, and must fit 32 bits.
    Blank symbols are left out; of repeated ones the last line counts.
    """
    cells = F.split("value", ",")
    raw = F.regexp_replace(F.trim(F.get(cells, F.lit(address_column))), "^0[xX]", "")
    rows = lines.where(F.col("line_no") >= skip).select("line_no", F.trim(F.get(cells, F.lit(symbol_column))).alias("symbol"), F.when(raw.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(raw, 16, 10).cast("long")).alias("raw"))
    rows = rows.withColumn("address", F.col("raw") - base)
    usable = F.coalesce((F.col("address") >= 0) & (F.col("address") <= MAX_ADDRESS), F.lit(False))
    named = F.length("symbol") > 0
    audit = rows.where(named & ~usable).select(F.col("line_no").alias("goff"), F.lit("address out of range").alias("rule"), F.col("symbol").alias("detail"))
    return rows.where(named & usable).groupBy("symbol").agg(F.max_by("address", "line_no").alias("address")), audit


def overlay(*layers: DataFrame) -> DataFrame:
    """(symbol, address) of several listings; later ones override earlier ones."""
    every = None
    for i, layer in enumerate(layers):
        ranked = layer.select("symbol", "address", F.lit(i).alias("layer"))
        every = ranked if every is None else every.unionByName(ranked)
    return every.groupBy("symbol").agg(F.max_by("address", F.struct("layer", -F.col("address"))).alias("address"))


def demangle_batch(symbols: list[str], tool: str | None = None) -> list[str]:
    """Readable names; symbols that don't look mangled, or that no tool reads, stay."""
    tool = tool or shutil.which("llvm-cxxfilt") or shutil.which("c++filt")
    todo = [s for s in symbols if s.startswith(("_Z", "?"))]
    if not tool or not todo:
        return list(symbols)
    done = subprocess.run([tool, "-n"] if "cxxfilt" in tool or "c++filt" in tool else [tool], input="\n".join(todo), capture_output=True, text=True)
    lines = done.stdout.split("\n")[: len(todo)]
    table = dict(zip(todo, lines, strict=False)) if done.returncode == 0 and len(lines) == len(todo) else {}
    return [table.get(s, s) for s in symbols]


def demangled(df: DataFrame, column: str, out: str = "demangled", tool: str | None = None) -> DataFrame:
    """df with readable names, a process for each Arrow batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = demangle_batch([x or "" for x in s], tool)
            yield pd.Series([None if x is None else y for x, y in zip(s, found, strict=True)], dtype=object)

    return df.withColumn(out, run(F.col(column)))


def demangled_by_cache(listing: DataFrame, path: str) -> DataFrame:
    """(symbol, demangled): known symbols from a cache at `path`, others read now and kept there."""
    return cached(listing.select("symbol").distinct(), "symbol", path, "symbol string, demangled string", lambda df: demangled(df, "symbol"))


def variants(listing: DataFrame, demangle: Callable[[DataFrame, str, str], DataFrame] = demangled) -> DataFrame:
    """listing (symbol, address) with constructors' C1 and C2 and destructors' D1 and D2 made up where one is missing.

    The variant digit is the first place after C or D where all variants read
    the same; C3 and D0 are other functions and have none.  Of several
    sources of one made-up symbol, the smallest address counts.
    """
    read = demangle(listing, "symbol", "own")
    mangled = read.where("own <> symbol")
    dtor = F.col("own").startswith("~") | F.col("own").contains("::~")
    kinds = mangled.withColumn("letter", F.when(dtor, F.lit("D")).otherwise(F.lit("C")))
    places = F.when(F.col("letter") == "D", variant_positions(F.col("symbol"), "D", "012")).otherwise(variant_positions(F.col("symbol"), "C", "123"))
    at = kinds.select("symbol", "address", "own", "letter", F.explode(places).alias("place"))
    digits = F.when(F.col("letter") == "D", F.array(*map(F.lit, "012"))).otherwise(F.array(*map(F.lit, "123")))
    tries = at.withColumn("digit", F.explode(digits))
    tries = tries.withColumn("made", F.concat(F.substring("symbol", F.lit(1), F.col("place")), F.col("digit"), F.substring(F.col("symbol"), F.col("place") + 2, F.lit(1 << 20))))
    tries = demangle(tries, "made", "read")
    good = tries.groupBy("symbol", "address", "letter", "place").agg(F.min(F.col("read") == F.col("own")).alias("alike"), F.collect_list(F.struct("digit", "made")).alias("made"))
    first = good.where("alike").groupBy("symbol", "address", "letter").agg(F.min_by("made", "place").alias("made"), F.min("place").alias("place"))
    digit = F.substring(F.col("symbol"), F.col("place") + 1, F.lit(1))
    usable = first.where(~((F.col("letter") == "D") & (digit == "0")) & ~((F.col("letter") == "C") & (digit == "3")))
    made = usable.select(F.explode(F.filter("made", lambda m: m["digit"].isin("1", "2"))["made"]).alias("symbol"), "address")
    made = made.groupBy("symbol").agg(F.min("address").alias("address"))
    return listing.unionByName(made.join(listing.select("symbol"), "symbol", "left_anti").select(listing.columns))


def link_symbols(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a link name, audit rows) of symbols of several units (cu_offset, link_name, address, ty, param_names, template_args).

    The first unit's row stays, with template arguments of the first row that has
    any; rows must agree on address and parameter names; other types are reported too.
    """
    own = F.to_json(F.struct("ty"), {"ignoreNullFields": "false"})
    grouped = symbols.withColumn("t_", own).groupBy("link_name").agg(
        F.min("cu_offset").alias("cu_offset"),
        F.min_by("address", "cu_offset").alias("address"),
        F.min_by("ty", "cu_offset").alias("ty"),
        F.min_by("param_names", "cu_offset").alias("param_names"),
        F.min_by("template_args", F.when(F.size("template_args") > 0, F.col("cu_offset"))).alias("template_args"),
        F.count_distinct("address").alias("n_address"),
        F.count_distinct("param_names").alias("n_params"),
        F.count_distinct("t_").alias("n_types"),
    )
    rules = F.array(*[F.when(F.col(c) > 1, F.lit(r)) for c, r in (("n_address", "addresses differ"), ("n_params", "parameters differ"), ("n_types", "types differ"))])
    audit = grouped.select(F.col("cu_offset").alias("goff"), F.explode(F.array_compact(rules)).alias("rule"), F.col("link_name").alias("detail"))
    return grouped.drop("n_address", "n_params", "n_types"), audit
