"""Curve-table scans, overlays and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forelake.functions.numeric import nan_to_null


def load_curves(
    spark: SparkSession, path: str, policies: Sequence[str] | None = None, cutoff: int | None = None, phase: str | None = None,
    span: tuple[str, str] | None = None, columns: Sequence[str] | None = None, target: str = "target", policy_column: str = "policy",
    cutoff_column: str = "cutoff_minutes", phase_column: str = "phase",
) -> DataFrame:
    """Parquet scan whose predicates and columns reach the reader; NaN becomes null, so that it joins no average."""
    df = spark.read.parquet(path)
    if policies is not None:
        df = df.filter(F.col(policy_column).isin(*policies))
    if cutoff is not None:
        df = df.filter(F.col(cutoff_column) == cutoff)
    if phase is not None:
        df = df.filter(F.col(phase_column) == phase)
    if span is not None:
        start, end = (F.lit(x).cast("timestamp_ntz") for x in span)
        df = df.filter((F.col(target) >= start) & (F.col(target) < end))
    return nan_to_null(df.select(*columns) if columns else df)


def overlay_sources(sources: Sequence[DataFrame], keys: Sequence[str], span: tuple[str, str] | None = None, target: str = "target") -> DataFrame:
    """Rows of the first source that has each key, optionally within [start, end).

    The winner is an aggregate over source priority, combined before the shuffle.
    """
    columns = sources[0].columns
    stacked = None
    for priority, df in enumerate(sources):
        part = df.select(*columns)
        if span is not None:
            start, end = (F.lit(x).cast("timestamp_ntz") for x in span)
            part = part.filter((F.col(target) >= start) & (F.col(target) < end))
        part = part.withColumn("_priority", F.lit(priority))
        stacked = part if stacked is None else stacked.unionByName(part)
    rest = [c for c in columns if c not in keys]
    first = F.min(F.struct("_priority", *rest)).alias("_f")
    return stacked.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in columns])


#: Microseconds, which the default JSON text cuts off.
JSON_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that ``write_table`` wrote as JSON."""
    return spark.read.schema(schema).options(**JSON_STAMPS).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), significant_digits: int = 12) -> None:
    """Write once; an existing target is an error. CSV floats get ``%.12g``-style text."""
    if fmt == "csv":
        floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
        df = df.select(*[general_format(c, significant_digits).alias(c) if c in floats else F.col(c) for c in df.columns])
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.options(**JSON_STAMPS).json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def general_format(column: str, digits: int = 12):
    """Shortest decimal or exponent text with ``digits`` significant digits, trailing zeros removed.

    An exact decimal tie rounds up.
    """
    x = F.col(column).cast("double")
    size = F.abs(x)
    # Rounding to the kept digits may carry into the next power of ten.
    carried = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.when(size > 0, F.regexp_extract(carried, r"e([+-]\d+)$", 1).cast("int")).otherwise(F.lit(0))
    places = F.greatest(F.lit(0), F.lit(digits - 1) - exponent)
    fixed = F.lit(None).cast("string")
    for p in range(0, digits + 4):
        fixed = F.when(places == p, F.format_string(f"%.{p}f", x)).otherwise(fixed)
    trimmed = F.when(F.contains(fixed, F.lit(".")), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    mantissa = F.regexp_extract(carried, r"^(.*)e", 1)
    mantissa = F.when(F.contains(mantissa, F.lit(".")), F.regexp_replace(mantissa, r"\.?0+$", "")).otherwise(mantissa)
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(carried, r"e([+-]\d+)$", 1))
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(
        (exponent < -4) | (exponent >= digits), scientific
    ).otherwise(trimmed)
