"""Expression plumbing shared by the function modules.

Expressions are built as Spark SQL text and turned into a Column with one
``F.expr`` call: building them node by node through the Python API costs a
JVM round trip per node, which dominated planning for the HTML operators.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ids = itertools.count()


def lit(s: str) -> str:
    """Spark SQL string literal for ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind SQL ``value`` once and use it several times in ``body``.

    A one-element ``transform`` evaluates the input once and passes it as a
    lambda variable, so nested helpers do not copy their input expression at
    every reference.
    """
    v = f"_v{next(_ids)}"
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def nonempty(x: str) -> str:
    """NULL for '' (single evaluation)."""
    return let(x, lambda v: f"CASE WHEN {v} != '' THEN {v} END")


def col(sql: str | Column) -> Column:
    return sql if isinstance(sql, Column) else F.expr(sql)


def sql_of(c: str | Column) -> str:
    """SQL text of a column name / expression string (Columns are rejected)."""
    if isinstance(c, Column):
        raise TypeError("pass a column name or SQL expression string")
    return c
