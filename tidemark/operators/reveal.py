"""Evaluation of a sealed window that can be asked for once: a write-once claim comes first, figures after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AlreadyRevealed(RuntimeError):
    pass


def claim(spark: SparkSession, path: str, owner: str) -> None:
    """Create the claim file or fail: of any number of drivers that ask at once the file system lets one create it.

    Distributed file systems create exclusively by themselves. For folders that are mounted Hadoop looks first and creates afterwards, so there
    the operating system is asked. Object stores that have no exclusive creation are not fit for claims.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with open(at.toUri().getPath(), "x", encoding="utf-8") as out:
                out.write(owner)
        except FileExistsError as e:
            raise AlreadyRevealed(f"{path} has been claimed") from e
        return
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise AlreadyRevealed(f"{path} has been claimed") from e
        raise
    out.write(bytearray(owner.encode()))
    out.close()


def reveal(spark: SparkSession, judged: DataFrame, path: str, owner: str, evaluate: Callable[[], DataFrame]) -> DataFrame:
    """The figures of `evaluate`, if the window is complete and nobody has revealed it before; else the blinded counts alone.

    judged: one row of counts with the `status` that governance.sealed_status gives them. The claim stands before figures are
    computed, so a crash in between leaves the window revealed, not open.
    """
    if judged.first().status != "SEALED_REVEAL_ELIGIBLE":
        return judged
    claim(spark, path, owner)
    return evaluate().withColumn("status", F.lit("SEALED_CONFIRMATORY_REVEALED"))


def classify(low: str = "low", high: str = "high"):
    """What an interval of model error minus reference error says."""
    return F.when(F.col(high) < 0, "CONFIRMATORY_POSITIVE").when(F.col(low) > 0, "CONFIRMATORY_NEGATIVE").otherwise("CONFIRMATORY_INCONCLUSIVE")
