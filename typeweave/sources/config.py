"""Configuration and compile commands."""

from __future__ import annotations

import re
import shlex
import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from typeweave.functions.names import Rules
from typeweave.functions.prims import BYTE_SIZE
from typeweave.operators.load import Config


class ConfigError(ValueError):
    """The configuration is not usable."""


@dataclass
class Listing:
    """A symbol listing: its file, columns, base address and header lines."""

    path: Path
    address_column: int
    symbol_column: int
    base: int = 0
    skip: int = 0


@dataclass
class Settings:
    loader: Config
    rules: Rules
    elf: Path | None = None
    compile_commands: Path | None = None
    data: Listing | None = None
    functions: Listing | None = None
    extra: dict = field(default_factory=dict)


def _sized(spec: object, what: str) -> tuple[str, int]:
    """A primitive and how many of it, from "u64" or ["u64", 2]."""
    prim, n = (spec, 1) if isinstance(spec, str) else (spec[0], int(spec[1])) if isinstance(spec, list) and len(spec) == 2 else (None, 0)
    if prim not in BYTE_SIZE or BYTE_SIZE[prim] is None or n < 1:
        raise ConfigError(f"{what}: {spec!r} has no size")
    return prim, n


def _pattern(text: str, what: str) -> str:
    try:
        re.compile(text)
    except re.error as e:
        raise ConfigError(f"{what}: {text!r}: {e}") from e
    return text


def _listing(section: dict | None, folder: Path) -> Listing | None:
    if section is None:
        return None
    return Listing(folder / section["path"], int(section["address-column"]), int(section["symbol-column"]), int(section.get("base-address", 0)), int(section.get("skip-rows", 0)))


def load(path: str | Path) -> Settings:
    """Settings from a TOML file; relative paths start at its folder. Rule tests must hold."""
    file = Path(path).resolve()
    with file.open("rb") as f:
        raw = tomllib.load(f)
    own, folder = raw.get("extract", {}), file.parent
    width = int(own.get("pointer-width", 64))
    if width not in (8, 16, 32, 64):
        raise ConfigError(f"pointer width {width}")
    resolution = own.get("name-resolution", {})
    try:
        rules = Rules.of(resolution.get("rules", []))
    except re.error as e:
        raise ConfigError(f"name rules: {e}") from e
    if wrong := rules.check([tuple(p) for p in resolution.get("test", [])]):
        raise ConfigError("; ".join(wrong))
    loader = Config(
        pointer_width=width,
        ptmd_repr=_sized(own.get("ptmd-repr", "i64"), "ptmd-repr"),
        ptmf_repr=_sized(own.get("ptmf-repr", ["i64", 2]), "ptmf-repr"),
        vfptr_pattern=_pattern(own.get("vfptr-field-regex", "^_vptr"), "vfptr-field-regex"),
        abandon_typedefs=[_pattern(p, "abandon-typedefs") for p in own.get("abandon-typedefs", [])],
    )
    paths = raw.get("paths", {})
    at = lambda key: folder / paths[key] if key in paths else None
    return Settings(loader, rules, at("elf"), at("compile-commands"), _listing(own.get("data-symbols"), folder), _listing(own.get("func-symbols"), folder), raw)


def read_listing(spark: SparkSession, listing: Listing) -> DataFrame:
    """(line_no, value): the lines of a listing file, numbered from 0."""
    whole = spark.read.text(str(listing.path), wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


@F.pandas_udf(ArrayType(StringType()))
def arguments(commands: pd.Series) -> pd.Series:
    """The arguments of shell commands, without the compiler; null if the shell couldn't split it."""

    def one(x: str | None) -> list[str] | None:
        try:
            return None if x is None else shlex.split(x)[1:]
        except ValueError:
            return None

    return commands.map(one)


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, arguments) of a JSON array of {file, command}; of a file's commands the last counts."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<struct<file:string,command:string>>")).alias("place", "c"))
    last = items.groupBy("c.file").agg(F.max_by("c.command", "place").alias("command"))
    return last.select("file", arguments("command").alias("arguments"))


def parser_arguments(args: list[str], *, source: str, output: str, depend: str) -> list[str]:
    """Arguments that parse `source` instead: the output and dependency files are replaced, the old source left out."""
    out, skip = [], 0
    for a in args:
        if skip:
            skip -= 1
        elif a in ("-o", "-MF", "-MT", "-MQ"):
            skip = 1
        elif a in ("-c", "-MD", "-MMD") or (not a.startswith("-") and a.endswith((".c", ".cc", ".cpp", ".cxx"))):
            continue
        else:
            out.append(a)
    return [*out, "-MD", "-MF", depend, "-o", output, source]


def run_build(command: list[str], folder: str | Path) -> None:
    """Run a build command in its folder, on the driver; failure is an error. Nothing runs it unasked."""
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise ConfigError(f"build failed with {done.returncode}: {done.stderr[-500:]}")


def join_units(units: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units (cu_offset, cu_name) with arguments, audit rows of units without a command)."""
    known = commands.select(F.col("file").alias("f"), "arguments")
    missing = units.join(known, F.col("cu_name") == F.col("f"), "left_anti").select(F.col("cu_offset").alias("goff"), F.lit("no compile command").alias("rule"), F.col("cu_name").alias("detail"))
    return units.join(known, F.col("cu_name") == F.col("f")).drop("f"), missing
