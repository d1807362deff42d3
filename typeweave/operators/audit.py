"""Integrity rules as tables of violations (goff, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


class AuditError(RuntimeError):
    """Some rows break a rule."""


def union(*audits: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.select("goff", "rule", "detail") for a in audits])


def enforce(audit: DataFrame, *, show: int = 5) -> None:
    """Raise with the first violations, if there is one."""
    found = audit.limit(show).collect()
    if found:
        raise AuditError("; ".join(f"{r['rule']} at {r['goff']} ({r['detail']})" for r in found))
