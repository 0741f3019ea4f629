"""Data contracts. Counting forms are lazy frames; require_* act at once and fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def duplicate_counts(df: DataFrame, *keys: str) -> DataFrame:
    """extra_rows counts rows beyond the first of their key, rows_in_groups all rows of repeated keys."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("extra_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_in_groups"))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"rows are not unique by {keys}")
    return df


def require_none(df: DataFrame, bad: Column, what: str) -> DataFrame:
    if not df.filter(bad).isEmpty():
        raise ValueError(what)
    return df


def publication_audit(df: DataFrame, decision: str, *publish: str) -> DataFrame:
    """For each column: rows published after the decision, and rows without a publication."""
    parts = [df.agg(F.lit(c).alias("publish_column"), F.count_if(F.col(c) > F.col(decision)).alias("future_rows"), F.count_if(F.col(c).isNull()).alias("missing_rows")) for c in publish]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forbidden_fields(df: DataFrame, *names: str) -> list[str]:
    """Paths of fields with a forbidden name, at any depth of the schema."""
    found: list[str] = []

    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", ()):
            at = f"{path}.{f.name}" if path else f.name
            found.extend([at] if f.name in names else [])
            walk(f.dataType, at)
        for part in ("elementType", "valueType"):
            if hasattr(kind, part):
                walk(getattr(kind, part), path)

    walk(df.schema, "")
    return found


def grid_counts(grid: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """expected, on_grid, off_grid (distinct keys) and missing, of an observed key against a grid."""
    seen = observed.select(key).distinct().withColumn("seen", F.lit(1))
    both = grid.select(key).withColumn("planned", F.lit(1)).join(seen, key, "full_outer")
    return both.agg(F.count("planned").alias("expected"), F.count_if(F.col("planned").isNotNull() & F.col("seen").isNotNull()).alias("on_grid"), F.count_if(F.col("planned").isNull()).alias("off_grid"), F.count_if(F.col("seen").isNull()).alias("missing"))
