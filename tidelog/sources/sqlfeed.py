"""SQL over the change feed.

A bound on ``seq`` in a query does not pass below the feed's window, so a
query's lower bounds are read off first and become the feed's ``since``; the
query then runs unchanged over a feed that starts there.  Bounds are read from
the parsed condition, so what stands in a text or in a subquery is none.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.table import KeyedTable


def _number(expression) -> int | None:
    """The value of a whole literal."""
    if expression.getClass().getSimpleName() != "Literal" or expression.dataType().simpleString() not in ("int", "bigint"):
        return None
    return int(expression.value())


def _is_seq(expression) -> bool:
    return expression.getClass().getSimpleName() == "UnresolvedAttribute" and expression.sql() == "seq"


def _implied(expression) -> int:
    """The greatest ``since`` that a parsed condition implies."""
    kind = expression.getClass().getSimpleName()
    if kind == "And":
        return max(_implied(expression.left()), _implied(expression.right()))
    if kind in ("GreaterThan", "GreaterThanOrEqual") and _is_seq(expression.left()):
        bound = _number(expression.right())
    elif kind in ("LessThan", "LessThanOrEqual") and _is_seq(expression.right()):
        bound = _number(expression.left())
    else:
        return 0
    return 0 if bound is None else max(0, bound - kind.endswith("OrEqual"))


def lower_bound(where: str) -> int:
    """The ``since`` that a conjunction implies: from ``seq > n``, ``seq >= n`` and their mirror images.

    Everything else counts for nothing: what a feed from there has too much, the
    query's own condition takes out.  A condition that cannot be parsed implies nothing.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        return 0
    try:
        return _implied(spark._jsparkSession.sessionState().sqlParser().parseExpression(where))
    except PySparkException:  # the query itself will say what is wrong
        return 0


def select_changes(table: KeyedTable, columns: str = "*", where: str | None = None, since: int = 0, rest: str = "") -> DataFrame:
    """``SELECT columns FROM changes WHERE where rest`` over the feed after ``since``.

    A query within it may look at the feed too, so its bounds are then left where they are.
    """
    nested = any(re.search(r"\bselect\b|\{changes\}", part, re.I) for part in (columns, where or "", rest))
    start = max(since, lower_bound(where) if where and not nested else 0)
    feed = table.changes(start)
    query = f"SELECT {columns} FROM {{changes}}" + (f" WHERE {where}" if where else "") + f" {rest}"
    return table._spark.sql(query, changes=feed)
