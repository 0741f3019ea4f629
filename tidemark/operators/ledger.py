"""Append-only hash-chained ledgers. A row's digest is of its canonical JSON; a link is sha256(previous + newline + digest)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON of text columns with sorted keys; quotes, backslashes and control characters are escaped."""
    return F.to_json(F.struct(*sorted(columns)))


def row_digests(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn("row_sha256", F.sha2(canonical_json(columns), 256))


def _chained(seed: str, by: Sequence[str]):
    """Rows come sorted by chain and order; of a chain one digest is carried from row to row."""
    start = hashlib.sha256(seed.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, start
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in by), strict=True)) or [()] * b.num_rows
            links = []
            for key, row in zip(keys, b.column("row_sha256").to_pylist(), strict=True):
                if key != at:
                    at, last = key, start
                last = hashlib.sha256(f"{last}\n{row}".encode()).hexdigest()
                links.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(links, pa.string())], [*b.schema.names, "chain_sha256"])

    return run


def build(rows: DataFrame, columns: Sequence[str], order: str, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with row_sha256 and chain_sha256, in the order of `order` (unique in a chain), one chain for each `by`.

    Digests of rows are computed in parallel. Each link needs the one before it, so a chain passes through one task, sorted,
    in time linear in its length and with one digest in memory; what passes is the order and a digest a row, not the row.
    """
    digested = row_digests(rows, columns)
    narrow = digested.select(*by, order, "row_sha256")
    dealt = narrow.repartition(*by) if by else narrow.repartition(1)
    sorted_ = dealt.sortWithinPartitions(*by, order)
    links = sorted_.mapInArrow(_chained(seed, by), StructType([*sorted_.schema.fields, StructField("chain_sha256", StringType())]))
    return digested.join(links.drop("row_sha256"), [*by, order])


def verify(ledger: DataFrame, columns: Sequence[str], order: str, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of rows whose digest, link or order is wrong. Every link is checked on its own, from the one before it."""
    w = Window.partitionBy(*by).orderBy("position")
    before = F.coalesce(F.lag("chain_sha256").over(w), F.sha2(F.lit(seed), 256))
    checked = ledger.withColumns({"_row": F.sha2(canonical_json(columns), 256), "_link": F.sha2(F.concat(before, F.lit("\n"), F.col("row_sha256")), 256), "_last": F.lag(order).over(w)})
    return checked.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("_row") != F.col("row_sha256")).alias("bad_digests"), F.count_if(F.col("_link") != F.col("chain_sha256")).alias("bad_links"), F.count_if(F.col("_last") >= F.col(order)).alias("bad_order"))


def verify_prefix(current: DataFrame, locked: DataFrame) -> DataFrame:
    """Whether the locked rows stand unchanged at the same positions of the current ledger."""
    a = current.select("position", F.col("chain_sha256").alias("_now"))
    met = locked.select("position", "chain_sha256").join(a, "position", "full_outer")
    out = met.agg(F.count("chain_sha256").alias("locked_rows"), F.count("_now").alias("current_rows"), F.count_if(F.col("chain_sha256").isNotNull() & ~F.col("chain_sha256").eqNullSafe(F.col("_now"))).alias("changed_rows"))
    return out.withColumns({"new_rows": F.col("current_rows") - F.col("locked_rows"), "status": F.when(F.col("changed_rows") == 0, "LOCKED_PREFIX_REPRODUCED").otherwise("LOCKED_PREFIX_CHANGED")})
