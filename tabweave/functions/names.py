"""Columns by their exact names: in a name that a user gave, dots and backticks are part of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def named(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]
