"""Free query text behind a read-only gate: the parsed plan decides, not the words in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(ValueError):
    """Text that is no single query."""


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """Runs one query; anything that would write, change or configure is refused. A column may be called OFFSET."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotReadOnly(f"not one query: {str(e).splitlines()[0]}") from e
    names, todo = [], [plan]
    while todo:
        node = todo.pop()
        names.append(node.getClass().getSimpleName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    bad = [n for n in names if any(w in n for w in ("Command", "Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Replace", "Truncate", "Refresh", "Cache", "Set"))]
    bad = [n for n in bad if n not in ("SetOperation", "ResolveSetOps")]
    if bad:
        raise NotReadOnly(f"refused: {bad[0]}")
    return spark.sql(sql)
