"""Named queries over the driver's tables, with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    """Name a piece of check SQL and the pieces it reads."""
    CTES[name] = (sql, needs)


def with_ctes(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTES[name][1]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return select
    parts = [f"{name} as ({CTES[name][0]})" for name in order]
    return "with recursive " + ",\n".join(parts) + "\n" + select


def flat(df: DataFrame) -> DataFrame:
    """Columns in types both engines print alike: bigint, rounded double, string, boolean."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (t.ByteType, t.ShortType, t.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(kind, (t.FloatType, t.DoubleType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(kind, (t.TimestampType, t.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, t.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(key: str, sql: str | None = None, *needs: str):
    """Register a query; ``sql`` is its check, built on the named pieces it needs."""

    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = with_ctes(sql, *needs)
        return fn

    return wrap
