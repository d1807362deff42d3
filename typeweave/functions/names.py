"""Names: C++ sources, mangling, preference keys, and their permutations over aliases."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SEG = "struct<k:string,goff:bigint,s:string,linkage:boolean>"

# What stands for a character in a mangled identifier.
MANGLED = {
    "$": "$$",
    "<": "$lt",
    ">": "$gt",
    "=": "$eq",
    "+": "$add",
    "-": "$sub",
    "*": "$mul",
    "/": "$div",
    "(": "$l1",
    " ": "$sp",
    ")": "$r1",
    "&": "$ap",
    "^": "$ca",
    "%": "$per",
    "[": "$l2",
    "]": "$r2",
    "{": "$l3",
    "}": "$r3",
    ":": "$cl",
    ",": "$cm",
    ".": "$pe",
    "?": "$qu",
    ";": "$se",
    "|": "$or",
    "~": "$ti",
    "'": "$q1",
    '"': "$q2",
    "!": "$ex",
    "`": "$bt",
    "@": "$at",
}
MANGLE_PREFIX = "____stage0_parse_"


def untemplated(name: Column) -> Column:
    return F.substring_index(name, "<", 1)


def without_anonymous(name: Column) -> Column:
    return F.replace(name, F.lit("::(anonymous namespace)::"), F.lit("::"))


def cpp_source(segments: Column, basename: Column | None = None) -> Column:
    """`a::b::base`; anonymous segments are left out; null inside a function."""
    named = F.filter(segments, lambda s: s["k"] != "anonymous")
    path = F.transform(named, lambda s: s["s"])
    whole = F.concat(path, F.array(basename)) if basename is not None else path
    return F.when(F.exists(segments, lambda s: s["k"] == "subprogram"), F.lit(None)).otherwise(F.array_join(whole, "::"))


def contains_anonymous(segments: Column) -> Column:
    return F.exists(segments, lambda s: s["k"] == "anonymous")


def parse_namespace(source: Column) -> Column:
    """Segments of an untemplated namespace; null if it isn't one."""
    parts = F.transform(F.split(source, "::"), lambda s: F.trim(s))
    return F.when(F.length(F.trim(source)) == 0, F.array().cast("array<string>")).when(~source.rlike(r"[<>*&]"), parts)


def split_namespace(name: Column) -> Column:
    """struct(ns, base), cut at the last `::`; ns is null without one."""
    cut = F.length(name) - F.length(F.substring_index(name, "::", -1))
    return F.struct(F.when(cut > 0, F.substring(name, F.lit(1), cut - 2)).alias("ns"), F.substring_index(name, "::", -1).alias("base"))


def mangle(name: Column) -> Column:
    """An identifier that is unique to a type name: each segment mangled and followed by its length in bytes."""
    table = F.create_map(*[F.lit(x) for pair in MANGLED.items() for x in pair])

    def segment(s: Column) -> Column:
        chars = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(table, c), c))
        return F.concat(F.array_join(chars, ""), F.lit("$$"), F.octet_length(s).cast("string"), F.lit("_"))

    return F.concat(F.lit(MANGLE_PREFIX), F.array_join(F.transform(F.split(name, "::"), segment), ""))


def variant_positions(symbol: Column, letter: str, digits: str) -> Column:
    """Zero-based places of a variant digit right after a letter, as in C1 or D2."""
    places = F.sequence(F.lit(1), F.greatest(F.length(symbol) - 1, F.lit(1)))
    hit = lambda i: (F.substring(symbol, i, F.lit(1)) == letter) & F.instr(F.lit(digits), F.substring(symbol, i + 1, F.lit(1))).cast("boolean") & (i < F.length(symbol))
    return F.filter(places, hit)


def fill_param_names(names: Column) -> Column:
    """Blank names become a0, a1, ... by place; a number that an original name has is passed over."""

    def fresh(i: Column) -> Column:
        tries = F.transform(F.sequence(i, i + F.size(names)), lambda j: F.concat(F.lit("a"), j.cast("string")))
        return F.element_at(F.filter(tries, lambda t: ~F.array_contains(names, t)), 1)

    return F.transform(names, lambda x, i: F.when(F.coalesce(x, F.lit("")) == "", fresh(i)).otherwise(x))


@dataclass
class Rules:
    """Patterns of names, from the most preferred and, after `<default>`, from the least disliked."""

    prefer: list[str] = field(default_factory=list)
    dislike: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, patterns: Iterable[str]) -> Rules:
        out, side = cls(), 0
        for p in patterns:
            if p == "<default>":
                side = 1
            else:
                re.compile(p)
                (out.dislike if side else out.prefer).append(p)
        return out

    def key(self, name: Column) -> Column:
        """Sorts from the most preferred; a first dislike counts, so it is 1, and no dislike 0."""
        liked = F.lit(len(self.prefer))
        for i in reversed(range(len(self.prefer))):
            liked = F.when(name.rlike(self.prefer[i]), F.lit(i)).otherwise(liked)
        worse = F.lit(0)
        for i in reversed(range(len(self.dislike))):
            worse = F.when(name.rlike(self.dislike[i]), F.lit(i + 1)).otherwise(worse)
        return (liked * 65536 + worse).cast("long")

    def key_of(self, name: str) -> int:
        liked = next((i for i, p in enumerate(self.prefer) if re.search(p, name)), len(self.prefer))
        return liked * 65536 + next((i + 1 for i, p in enumerate(self.dislike) if re.search(p, name)), 0)

    def check(self, pairs: Iterable[tuple[str, str]]) -> list[str]:
        """What is wrong with pairs of which the first should be preferred."""
        return [f"{a} is not preferred to {b}" for a, b in pairs if self.key_of(a) >= self.key_of(b)]


def permute(choices: Sequence[Iterable[str]]) -> list[tuple[str, ...]]:
    """One of each, in all ways; none of nothing."""
    return [t[::-1] for t in itertools.product(*[list(c) for c in choices][::-1])] if choices else []


def permute_columns(arrays: Column) -> Column:
    """permute() for an array of arrays of strings, as an array of arrays."""
    empty = F.array().cast("array<array<string>>")

    def add(done: Column, options: Column) -> Column:
        singles = F.transform(options, lambda o: F.array(o))
        longer = F.flatten(F.transform(options, lambda o: F.transform(done, lambda d: F.concat(d, F.array(o)))))
        return F.struct(F.lit(False).alias("first"), F.when(started["first"], singles).otherwise(longer).alias("v"))

    started = None

    def step(state: Column, options: Column) -> Column:
        nonlocal started
        started = state
        return add(state["v"], options)

    return F.aggregate(arrays, F.struct(F.lit(True).alias("first"), empty.alias("v")), step, lambda s: s["v"])


# Names of types by their graph: (key of a part) -> set of spellings, to a least fixpoint.


@dataclass(frozen=True)
class Name:
    """A path of segments (kind, goff, text, linkage), a base name, and template arguments.

    An argument is ("const", n), ("static", None), or ("type", tokens) with
    tokens (op, id or Name, n) in postfix order.
    """

    path: tuple[tuple[str, int | None, str | None, bool], ...]
    base: str
    args: tuple[tuple[str, object], ...] = ()


#: Spellings of one type, at most.
MOST_SPELLINGS = 4096


def spellings(names: Mapping[int, Sequence[Name]], *, rounds: int = 32, most: int = MOST_SPELLINGS) -> tuple[dict[int, frozenset[str]], set[int]]:
    """All spellings of each type of a bounded group of types, and the types that have too many.

    Spellings only grow from round to round, and a name that needs a type without
    spellings yet contributes nothing: so self-reference contributes nothing.
    """
    known: dict[int, frozenset[str]] = {g: frozenset() for g in names}
    capped: set[int] = set()
    for _ in range(rounds):
        after = {}
        for g, own in names.items():
            found = {s for n in own for s in itertools.islice(_name(n, known), most + 1)}
            if len(found) > most:
                capped.add(g)
                found = set(sorted(found)[:most])
            after[g] = frozenset(found)
        if after == known:
            break
        known = after
    return known, capped


def _path(path: tuple, known: Mapping[int, frozenset[str]]) -> set[str]:
    out: set[str] = set()
    for kind, goff, text, linkage in path:
        if kind == "name":
            out = {f"{x}::{text}" for x in out} or {str(text)}
        elif kind == "type":
            out = set(known.get(goff or 0, ()))
            if not out:
                return out
        elif kind == "subprogram":
            out = {str(text)} if linkage else {f"{x}::(function {text})" for x in out}
    return out


def _name(n: Name, known: Mapping[int, frozenset[str]]) -> Iterable[str]:
    bases = [f"{x}::{n.base}" for x in sorted(_path(n.path, known))] if n.path else [n.base]
    if not n.args:
        return bases
    ways = permute([sorted(_arg(a, known)) for a in n.args])
    return (f"{b}<{', '.join(w)}>" for b in bases for w in ways)


def _arg(arg: tuple[str, object], known: Mapping[int, frozenset[str]]) -> Iterable[str]:
    kind, value = arg
    return {str(value)} if kind == "const" else {"[static]"} if kind == "static" else tree_spellings(value, known)


def tree_spellings(tokens: Sequence[tuple[str, object, int | None]], known: Mapping[int, frozenset[str]]) -> set[str]:
    """All spellings of a type expression; a pointer to a subroutine is R(*)(A) here."""

    def of(leaf: object) -> set[str]:
        return set(_name(leaf, known)) if isinstance(leaf, Name) else set(known.get(leaf, ()))

    stack: list[tuple[set[str], str]] = []
    for op, leaf, n in tokens:
        if op == "base":
            stack.append((of(leaf), op))
        elif op == "arr":
            stack.append(({f"{x}[{n}]" for x in stack.pop()[0]}, op))
        elif op == "ptmd":
            stack.append(({f"{x} {c}::*" for x in stack.pop()[0] for c in of(leaf)}, op))
        elif op == "ptr":
            inner, under = stack.pop()
            stack.append(({x.replace("\0", "(*)", 1) for x in inner} if under == "sub" else {f"{x}*" for x in inner}, op))
        else:
            parts = [{x.replace("\0", "") for x in s} for s, _ in stack[-(n or 1) :]]
            del stack[-(n or 1) :]
            ways = permute([sorted(p) for p in parts])
            if op == "sub":
                stack.append(({f"{w[0]}\0({', '.join(w[1:])})" for w in ways}, op))
                continue
            stack.append(({f"{w[0]} ({c}::*)({', '.join(w[1:])})" for w in ways for c in of(leaf)}, op))
        stack[-1] = ({x.replace("\0", "") for x in stack[-1][0]}, op)
    return {x.replace("\0", "") for x in stack[-1][0]} if stack else set()


# A parser for the names that debug information gives to templated types.

#: Spellings of builtin types, by the primitive that they are.
BUILTIN = {
    "void": "void", "bool": "bool", "char": "i8", "signed char": "i8", "unsigned char": "u8", "short": "i16", "unsigned short": "u16", "int": "i32",
    "unsigned int": "u32", "unsigned": "u32", "long": "i64", "unsigned long": "u64", "long long": "i64", "unsigned long long": "u64", "__int128": "i128",
    "unsigned __int128": "u128", "float": "f32", "double": "f64", "long double": "f128", "char16_t": "u16", "char32_t": "u32", "wchar_t": "i32",
}
_LEX = re.compile(r"\s*(::|\(anonymous namespace\)|[A-Za-z_~$][\w$]*|-?\d+|[<>,*&()\[\]])")


class BadName(ValueError):
    """Not a type name."""


def _builtin(words: list[str]) -> str:
    """The usual spelling of a builtin type whose words may come in any order."""
    sign = "unsigned" if "unsigned" in words else "signed" if "signed" in words and "char" in words else ""
    size = next((w for w in ("char", "short", "__int128", "double") if w in words), "")
    whole = " ".join(w for w in (sign, "long " * words.count("long") + size) if w).strip()
    return whole if whole in BUILTIN else "int"


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _LEX.match(text, at)
            if not m:
                raise BadName(f"cannot read {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        x = self.peek()
        if x is None or (want is not None and x != want):
            raise BadName(f"expected {want or 'more'} after {' '.join(self.tokens[: self.at])}")
        self.at += 1
        return x

    def name(self) -> Name:
        path: list[str] = []
        while True:
            part = self.take()
            if not re.match(r"[A-Za-z_~$(]", part) or part == "(":
                raise BadName(f"not a name: {part}")
            args: tuple = ()
            if self.peek() == "<":
                self.take()
                found = []
                while self.peek() != ">":
                    found.append(self.arg())
                    if self.peek() == ",":
                        self.take()
                self.take(">")
                args = tuple(found)
            if self.peek() != "::" or (self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == "*"):
                segs = tuple(("anonymous", None, None, False) if p == "(anonymous namespace)" else ("name", None, p, False) for p in path)
                return Name(segs, part, args)
            self.take("::")
            if args:
                raise BadName("a templated scope")
            path.append(part)

    def arg(self) -> tuple[str, object]:
        x = self.peek()
        if x is not None and re.fullmatch(r"-?\d+", x):
            self.take()
            return ("const", int(x))
        if x in ("true", "false"):
            self.take()
            return ("const", int(x == "true"))
        return ("type", tuple(self.type()))

    def type(self) -> list[tuple[str, object, int | None]]:
        words = []
        while (x := self.peek()) in ("const", "volatile", "struct", "class", "union", "enum", "unsigned", "signed", "long", "short", "int", "char", "double", "__int128"):
            self.take()
            if x not in ("const", "volatile", "struct", "class", "union", "enum"):
                words.append(x)
        plain = _builtin(words)
        out: list = [("base", BUILTIN[plain] if words else self._leaf(), None)]
        while (x := self.peek()) is not None:
            if x in ("const", "volatile"):
                self.take()
            elif x in ("*", "&"):
                self.take()
                if x == "&" and self.peek() == "&":
                    self.take()
                out.append(("ptr", None, None))
            elif x == "[":
                self.take()
                out.append(("arr", None, int(self.take())))
                self.take("]")
            elif x == "(":
                out = self._function(out)
            elif re.match(r"[A-Za-z_]", x):
                cls = self.name()
                self.take("::")
                self.take("*")
                out.append(("ptmd", cls, None))
            else:
                break
        return out

    def _leaf(self) -> object:
        found = self.name()
        return BUILTIN[found.base] if not found.path and not found.args and found.base in BUILTIN else found

    def _function(self, ret: list) -> list:
        self.take("(")
        mark: object = None
        if self.peek() == "*":
            self.take()
            self.take(")")
            mark = "ptr"
            self.take("(")
        elif self.peek() not in (")", None):
            start = self.at
            try:
                cls = self.name()
                self.take("::")
                self.take("*")
                self.take(")")
                self.take("(")
                mark = cls
            except BadName:
                self.at = start
        args = []
        while self.peek() != ")":
            args.append(self.type())
            if self.peek() == ",":
                self.take()
        self.take(")")
        args = [a for a in args if a != [("base", "void", None)]]
        flat = ret + [t for a in args for t in a]
        if mark is None or mark == "ptr":
            return [*flat, ("sub", None, len(args) + 1)] + ([("ptr", None, None)] if mark else [])
        return [*flat, ("ptmf", mark, len(args) + 1)]


def parse_name(text: str) -> Name:
    """A type name as debug information spells it; qualifiers are dropped, references are pointers."""
    reader = _Reader(text)
    out = reader.name()
    if reader.peek() is not None:
        raise BadName(f"cannot read on at {reader.peek()}")
    return out


def to_json(name: Name) -> str:
    """A canonical text of a name; equal names have equal texts."""
    return json.dumps(_plain(name), separators=(",", ":"), ensure_ascii=False)


def _plain(x: object) -> object:
    if isinstance(x, Name):
        return {"path": _plain(x.path), "base": x.base, "args": _plain(x.args)}
    return [_plain(y) for y in x] if isinstance(x, tuple | list) else x


def from_json(text: str) -> Name:
    def name(d: dict) -> Name:
        return Name(tuple(tuple(s) for s in d["path"]), d["base"], tuple(arg(a) for a in d["args"]))

    def arg(a: list) -> tuple[str, object]:
        kind, value = a
        return (kind, tuple((op, name(leaf) if isinstance(leaf, dict) else leaf, n) for op, leaf, n in value) if kind == "type" else value)

    return name(json.loads(text))


def parsed_names(names: Column) -> Column:
    """struct(json, error) of a column of type names: the canonical text, or why there is none."""
    return F.pandas_udf(_parsed, StructType([StructField("json", StringType()), StructField("error", StringType())]))(names)


def _parsed(values: pd.Series) -> pd.DataFrame:
    rows = []
    for x in values:
        try:
            rows.append((None if x is None else to_json(parse_name(x)), None))
        except BadName as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["json", "error"])
