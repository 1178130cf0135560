"""Small shared helpers for column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\.^$|?*+()[]{}")


def col_of(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def regex_escape(s: str) -> str:
    """Escape regex metacharacters in a way both Java regex and RE2 accept."""
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def r6(c, digits: int = 6) -> Column:
    """Round a double for engine-independent comparison."""
    return F.round(col_of(c).cast("double"), digits)
