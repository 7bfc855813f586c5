"""Fingerprints, tolerant table comparison and manifest reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.numeric import count_if


def row_digest(columns: Sequence[str]):
    """sha256 of the row's values; nulls are written as an empty marker."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free digest: the sum of 52-bit row-hash prefixes."""
    prefix = F.conv(F.substring(row_digest(columns or df.columns), 1, 13), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(prefix).cast("string").alias("digest"))


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = 1e-8, rtol: float = 1e-12) -> DataFrame:
    """Per value column: rows compared, largest error, null-pattern and tolerance breaks, unmatched keys."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in values], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(1).alias("_in_b"))
    joined = left.join(right, list(keys), "full_outer")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    types = {f.name: f.dataType.typeName() for f in a.schema.fields}
    numeric = ("double", "float", "long", "integer", "short", "byte")
    entries = []
    for c in values:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if types[c] in numeric:
            error = F.abs(x - y).cast("double")
            beyond = error > atol + rtol * F.abs(y)
        else:
            error = F.when(x.isNotNull() & y.isNotNull(), (x != y).cast("double"))
            beyond = error > 0
        entries.append(F.struct(
            F.lit(c).alias("column"),
            count_if(both).alias("compared"),
            F.max(F.when(both, error)).alias("max_error"),
            count_if(both & (x.isNull() != y.isNull())).alias("null_mismatches"),
            count_if(both & beyond).alias("beyond_tolerance"),
            count_if(F.col("_in_b").isNull()).alias("only_in_a"),
            count_if(F.col("_in_a").isNull()).alias("only_in_b"),
        ))
    return joined.agg(F.array(*entries).alias("_d")).select(F.explode("_d").alias("d")).select("d.*")


def unsafe_name(path) -> Column:
    """Absolute, parent-relative, backslashed or empty path parts."""
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike(r"^/|\\|(^|/)\.{1,2}(/|$)|//|^$|^[A-Za-z]:")


def reconcile_manifest(declared: DataFrame, actual: DataFrame, omitted: DataFrame | None = None) -> DataFrame:
    """State of every declared or present path.

    ``declared`` and ``actual`` hold (path, bytes, sha256); ``omitted`` lists
    declared paths a checkout may leave out. One row per path: a path listed
    twice is verified only if all its rows agree.

    Rows are dealt by the lower-cased path, which serves both the paths and their
    collisions: one shuffle.
    """
    sides = [(declared, "d"), (actual, "p")] + ([(omitted, "o")] if omitted is not None else [])
    rows = None
    for df, side in sides:
        content = F.struct("bytes", "sha256") if side != "o" else F.lit(None).cast("struct<bytes:bigint,sha256:string>")
        part = df.select("path", content.cast("struct<bytes:bigint,sha256:string>").alias("_content"), F.lit(side).alias("_side"))
        rows = part if rows is None else rows.unionByName(part)
    low = F.lower("path")
    paths = rows.repartition(low).groupBy(low.alias("_low"), "path").agg(
        *[F.max(F.col("_side") == side).alias(f"_{side}") for side in "dpo"],
        F.min("_content").eqNullSafe(F.max("_content")).alias("_alike"),
    )
    spelled = count_if(F.col("_d")).over(Window.partitionBy("_low"))
    state = (
        F.when(F.col("_d") & unsafe_name("path"), "unsafe_name")
        .when(F.col("_d") & (F.col("_spelled") > 1), "case_collision")
        .when(~F.col("_d") & F.col("_p"), "unexpected")
        .when(F.col("_d") & ~F.col("_p") & F.col("_o"), "omitted")
        .when(F.col("_d") & ~F.col("_p"), "missing")
        .when(~F.col("_alike"), "mismatch")
        .otherwise("verified")
    )
    return paths.withColumn("_spelled", spelled).filter(F.col("_d") | F.col("_p")).select("path", state.alias("state"))


def manifest_status(states: DataFrame) -> DataFrame:
    """Counts per state and the overall verdict."""
    names = ("verified", "mismatch", "missing", "omitted", "unexpected", "unsafe_name", "case_collision")
    counted = states.agg(*[count_if(F.col("state") == s).alias(s) for s in names])
    bad = F.col("mismatch") + F.col("missing") + F.col("unexpected") + F.col("unsafe_name") + F.col("case_collision")
    return counted.withColumn("status", F.when(bad > 0, "FAIL").when(F.col("omitted") > 0, "INCOMPLETE_CHECKOUT").otherwise("PASS"))


def check_table(checks: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """One row per named check: its single value, tolerance and verdict."""
    out = None
    for name, df, tolerance in checks:
        value = F.col(df.columns[0]).cast("double")
        row = df.select(
            F.lit(name).alias("name"), value.alias("value"), F.lit(float(tolerance)).alias("tolerance"), (value <= tolerance).alias("pass")
        )
        out = row if out is None else out.unionByName(row)
    return out
