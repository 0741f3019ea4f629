"""Packing into optimal length buckets.

Every document is padded to the boundary of its bucket. A dynamic programme over the global histogram of lengths chooses
the BUCKETS boundaries with the least padding over all documents. The histogram is exact: it has one row for each of the D
distinct lengths, and D lengths that differ sum to D * (D - 1) / 2 at least, so D is at most about the square root of twice
the tokens, whatever the longest text is. The cost obeys the quadrangle inequality, so each layer is filled by divide and
conquer in D log D steps, all intervals of one depth at a time.

Inside a bucket, documents fill batches of at most BUDGET padded tokens: `BUDGET // boundary` of them, or one if the
boundary is larger. A bucket is dealt over shards of about SHARD_ROWS rows by a hash of the id, as many as its count in the
histogram asks for, so no task receives a whole bucket; each shard fills its batches in order of length and id, and only
its last may be short.

Lengths are tokens of the byte-level vocabulary. Null and empty texts have length 0 and go to the first bucket. Repeated
rows are packed one by one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table
from .token_counts import token_counts

BUCKETS, BUDGET, SHARD_ROWS = 16, 65_536, 20_000


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Boundaries (each the largest length of its bucket) with the least sum of boundary minus length."""
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.int64)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    #: Cost of lengths i..j-1 in one bucket: their rows times the largest length. The sum of lengths itself is constant.
    cost = np.concatenate([[0], size * rows[1:]])
    best, choice = cost.copy(), []
    for _ in range(1, min(buckets, n)):
        layer, pick = best.copy(), np.zeros(n + 1, np.int64)
        lo, hi, a, b = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            width = np.minimum(mid - 1, b) - a + 1
            start = np.cumsum(width) - width
            of = np.repeat(np.arange(len(mid)), width)
            i = np.arange(len(of)) - (start - a)[of]
            total = best[i] + (rows[mid[of]] - rows[i]) * size[mid[of] - 1]
            layer[mid] = np.minimum.reduceat(total, start)
            least = np.flatnonzero(total == layer[mid[of]])
            k = i[least[np.searchsorted(of[least], np.arange(len(mid)))]]
            pick[mid] = k
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (a, k), (k, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        choice.append(pick)
        best = layer
    ends, at = [], n
    for pick in reversed(choice):
        ends.append(int(size[at - 1]))
        at = int(pick[at])
        if not at:
            break
    if at:
        ends.append(int(size[at - 1]))
    return ends[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: id, n_tokens, bucket, boundary, batch_id, position, padding."""
    rows = lengths.select(F.col(id_col).cast("long").alias("id"), F.col(length_col).cast("long").alias("n"))
    histogram = rows.groupBy("n").count().toArrow().sort_by("n")  # about the square root of twice the tokens, at most
    sizes, counts = (histogram[c].to_numpy() for c in ("n", "count"))
    ends = best_boundaries(sizes, counts, buckets) or [0]
    held = np.bincount(np.searchsorted(ends, sizes), counts, len(ends)).astype(np.int64).tolist()
    spec = F.array(*(F.struct(F.lit(e).cast("long").alias("boundary"), F.lit(max(1, -(-h // shard_rows))).cast("long").alias("shards"), F.lit(max(1, budget // max(1, e))).cast("long").alias("room")) for e, h in zip(ends, held, strict=True)))
    bucket = F.coalesce(*(F.when(F.col("n") <= e, F.lit(k)) for k, e in enumerate(ends)))
    dealt = rows.withColumn("bucket", bucket).withColumn("spec", F.element_at(spec, F.col("bucket") + 1)).select("id", "n", "bucket", F.col("spec.boundary").alias("boundary"), F.col("spec.room").alias("room"), F.pmod(F.xxhash64("id"), "spec.shards").alias("shard"))
    k = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n", "id")) - 1
    return dealt.withColumn("k", k).select(
        F.col("id").alias(id_col), F.col("n").alias(length_col), "bucket", "boundary",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("k") / F.col("room"))).alias("batch_id"),
        F.pmod("k", "room").cast("long").alias("position"), (F.col("boundary") - F.col("n")).alias("padding"),
    )


def pack_documents(docs: DataFrame, path: str, **limits) -> DataFrame:
    """Counts come from the workers' caches alone: one pass over the texts, whose counts are settled for the histogram."""
    return pack(settle(token_counts(docs, path, table_size=0).select("doc_id", "n_tokens")), **limits)


def query(spark, sf_dir: str) -> DataFrame:
    """op5_length_buckets over the whole of documents. The dynamic programme is not expressible in SQL; tests compare with brute force."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
