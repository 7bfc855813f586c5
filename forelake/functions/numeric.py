"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forelake.functions.clock import as_col


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (Spark sorts NaN largest)."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def rounded(value, digits: int = 6) -> Column:
    """Round for comparison across engines.

    A shift far below the last kept digit moves exact decimal halves off the
    rounding boundary, where engines differ.
    """
    return F.round(as_col(value) + F.lit(3.0 * 10.0 ** -(digits + 4)), digits)


def share(condition: Column) -> Column:
    """Fraction of non-null rows for which ``condition`` holds."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def mc_pvalue(hits: Column, draws: Column) -> Column:
    """Monte-Carlo p-value (1 + hits) / (draws + 1)."""
    return (hits + 1) / (draws + 1)


def mc_error(p: Column, draws: Column) -> Column:
    return F.sqrt(p * (1 - p) / (draws + 1))


def explode_values(values) -> Column:
    """Rows for a short Python list of scenarios; replaces a join with a grid table."""
    return F.explode(F.array(*[F.lit(v) for v in values]))
