"""The text notation of types, and their C++-like display.

Notation of a tree is a sequence in suffix order: a primitive's name or a quoted
name, `'*'` for pointers, `[n]` for arrays, `'()'` and a list of argument
types for subroutines, a class with `'::'` for member pointers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from typeweave.functions.prims import CPP_NAME

#: A token of a named tree: (op, name, n).
Token = tuple[str, str | None, int | None]
NAMED_TREE = "array<struct<op:string,name:string,n:int>>"


class NotationError(ValueError):
    """The text is not a type."""


def _leaf(name: str) -> str:
    return name if name in CPP_NAME else f"'\"{name}\"'"


def to_notation(tokens: Sequence[Token]) -> str:
    """Canonical text, such as `[ u32,'*' ]`."""
    stack: list[str] = []
    for op, name, n in tokens:
        if op == "base":
            stack.append(_leaf(name or "void"))
        elif op == "ptr":
            stack.append(stack.pop() + ",'*'")
        elif op == "arr":
            stack.append(f"{stack.pop()},[{n}]")
        elif op == "ptmd":
            stack.append(f"{stack.pop()},{_leaf(name or 'void')},'::','*'")
        elif op in ("sub", "ptmf"):
            first, *rest = _taken(stack, n)
            args = ",".join(f"[ {a} ]" for a in rest)
            stack.append(f"{first},'()',[{args}]" if op == "sub" else f"{first},{_leaf(name or 'void')},'::','()',[{args}],'*'")
        else:
            raise NotationError(f"unknown token {op}")
    return f"[ {_only(stack)} ]"


def to_display(tokens: Sequence[Token]) -> str:
    """C++-like text, such as `u64 (*)(bool)` or `T C::*`."""
    stack: list[tuple[str, str]] = []
    for op, name, n in tokens:
        if op == "base":
            stack.append((name or "void", op))
        elif op == "arr":
            stack.append((f"{stack.pop()[0]}[{n}]", op))
        elif op == "ptmd":
            stack.append((f"{stack.pop()[0]} {name}::*", op))
        elif op == "ptr":
            text, under = stack.pop()
            stack.append((text.replace("\0", " (*)", 1) if under == "sub" else text + "*", op))
        elif op in ("sub", "ptmf"):
            first, *rest = [t.replace("\0", "") for t, _ in _taken(stack, n)]
            stack.append((f"{first}\0({', '.join(rest)})" if op == "sub" else f"{first} ({name}::*)({', '.join(rest)})", op))
        else:
            raise NotationError(f"unknown token {op}")
        if op != "sub" and stack:
            stack[-1] = (stack[-1][0].replace("\0", ""), op)
    return _only([t for t, _ in stack]).replace("\0", "")


def _taken(stack: list, n: int | None) -> list:
    if not n or len(stack) < n:
        raise NotationError("a subroutine lacks types")
    out = stack[-n:]
    del stack[-n:]
    return out


def _only(stack: list[str]) -> str:
    if len(stack) != 1:
        raise NotationError("not one type")
    return stack[0]


_LEX = re.compile(r"""\s*(?:(?P<open>\[)|(?P<close>\])|(?P<comma>,)|'(?P<single>(?:[^']|'')*)'|"(?P<double>(?:[^"\\]|\\.)*)"|(?P<plain>[^\s\[\],'"][^\[\],\n]*))""")


def _sequence(text: str) -> list:
    """Nested lists of scalars out of a flow sequence."""
    out: list[list] = [[]]
    at = 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise NotationError(f"cannot read at {at}: {text!r}")
        at = m.end()
        if m["open"]:
            out.append([])
        elif m["close"]:
            if len(out) < 2:
                raise NotationError(f"unbalanced: {text!r}")
            done = out.pop()
            out[-1].append(done)
        elif m["single"] is not None:
            out[-1].append(m["single"].replace("''", "'"))
        elif m["double"] is not None:
            out[-1].append(re.sub(r"\\(.)", r"\1", m["double"]))
        elif m["plain"]:
            out[-1].append(m["plain"].strip())
    if len(out) != 1 or len(out[0]) != 1 or not isinstance(out[0][0], list):
        raise NotationError(f"not one sequence: {text!r}")
    return out[0][0]


def _name(spec: object) -> str:
    if not isinstance(spec, str):
        raise NotationError(f"not a name: {spec!r}")
    if spec.startswith('"'):
        if len(spec) < 2 or not spec.endswith('"'):
            raise NotationError(f"unterminated name: {spec}")
        return spec[1:-1]
    if spec not in CPP_NAME:
        raise NotationError(f"not a primitive: {spec}")
    return spec


def _tokens(parts: list) -> list[Token]:
    if not parts:
        raise NotationError("empty type")
    out: list[Token] = [("base", _name(parts[0]), None)]
    i = 1
    while i < len(parts):
        x, rest = parts[i], parts[i + 1 :]
        if x == "*":
            out.append(("ptr", None, None))
            i += 1
        elif isinstance(x, list):
            if len(x) != 1 or not str(x[0]).isdigit():
                raise NotationError(f"not a length: {x}")
            out.append(("arr", None, int(x[0])))
            i += 1
        elif x == "()":
            if not rest or not isinstance(rest[0], list):
                raise NotationError("a subroutine lacks arguments")
            args = [_tokens(a) for a in rest[0]]
            out += [t for a in args for t in a] + [("sub", None, len(args) + 1)]
            i += 2
        elif rest[:1] == ["::"] and rest[1:2] == ["*"]:
            out.append(("ptmd", _name(x), None))
            i += 3
        elif rest[:1] == ["::"] and rest[1:2] == ["()"] and len(rest) >= 4 and isinstance(rest[2], list) and rest[3] == "*":
            args = [_tokens(a) for a in rest[2]]
            out += [t for a in args for t in a] + [("ptmf", _name(x), len(args) + 1)]
            i += 5
        else:
            raise NotationError(f"cannot read {x!r}")
    return out


def parse_notation(text: str) -> list[Token]:
    """The tokens of a type in notation; NotationError if it is none."""
    return _tokens(_sequence(text))


def complexity(tokens: Sequence[Token]) -> int:
    """Nesting depth along the first child; member pointers add two."""
    stack: list[int] = []
    for op, _, n in tokens:
        if op == "base":
            stack.append(0)
        elif op in ("sub", "ptmf"):
            first = _taken(stack, n)[0]
            stack.append(first + (2 if op == "ptmf" else 1))
        else:
            stack.append(stack.pop() + (2 if op == "ptmd" else 1))
    return stack[-1] if stack else 0


def _each(values: pd.Series, f) -> pd.Series:
    return values.map(lambda ts: None if ts is None else f([(t["op"], t["name"], None if pd.isna(t["n"]) else int(t["n"])) for t in ts]))


def _notation(values: pd.Series) -> pd.Series:
    return _each(values, to_notation)


def _display(values: pd.Series) -> pd.Series:
    return _each(values, to_display)


def notation(tokens: Column) -> Column:
    """Text of a column of named trees; null stays null."""
    return F.pandas_udf(_notation, "string")(tokens)


def display(tokens: Column) -> Column:
    return F.pandas_udf(_display, "string")(tokens)


def parse(text: Column) -> Column:
    """Named trees of a column of notation; text that is no type becomes null, which audits report."""

    def run(values: pd.Series) -> pd.Series:
        def one(x: str | None):
            try:
                return None if x is None else [{"op": o, "name": n, "n": k} for o, n, k in parse_notation(x)]
            except NotationError:
                return None

        return values.map(one)

    return F.pandas_udf(run, NAMED_TREE)(text)
