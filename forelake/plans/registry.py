"""Named queries over the test tables, each with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forelake.functions.numeric import rounded
from forelake.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(views) -> DataFrame``; ``views`` names the SQL views the text needs."""
    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(views.split(), sql)
        return fn

    return register


def shown(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Round every floating column of a final result for comparison; ``own`` gives a column's own digits."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[rounded(c, own.get(c, digits)).alias(c) if c in floats else F.col(c) for c in df.columns])


def r(expression: str, name: str | None = None, digits: int = 4) -> str:
    """The same rounding as SQL text."""
    return f"round(CAST({expression} AS DOUBLE) + {3.0 * 10.0 ** -(digits + 4)!r}, {digits}) AS {name or expression}"


def rs(*columns: str, digits: int = 4) -> str:
    return ", ".join(r(c, c, digits) for c in columns)
