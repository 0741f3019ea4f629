"""A paged record store as a Spark data source: one partition a page, filters pushed to the pages, restart by page.

A store is a folder of JSON-lines pages and an index of them: file, rows, and the smallest and largest key of each page. It
stands for any source that serves records in pages of known bounds. The reader asks for the pages that a filter on the key
can meet and for no others, and leaves out those that an earlier, interrupted download has finished.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME, INDEX = "tidemark_pages", "index"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def write_pages(df: DataFrame, path: str, key: str, pages: int) -> None:
    """df as a store of about `pages` pages of consecutive keys; the index is made from what was written."""
    df.repartitionByRange(pages, key).sortWithinPartitions(key).write.mode("errorifexists").json(f"{path}/pages")
    spark = df.sparkSession
    written = spark.read.schema(df.schema).json(f"{path}/pages")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    index = written.groupBy(file.alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    index.coalesce(1).write.json(f"{path}/{INDEX}")


class Page(InputPartition):
    def __init__(self, file: str, rows: int) -> None:
        self.file, self.rows = file, rows


class PagedSource(DataSource):
    """Options: path, key (the column that pages are bounded by), done (names of finished pages, separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema of the records: spark.read.format(...).schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.key, self.path = schema, options["key"], options["path"]
        self.done = {x for x in options.get("done", "").split(",") if x}
        self.bounds: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the key choose pages. Spark still applies every filter to the rows, as a page holds others too."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.key,):
                self.bounds.append((type(f).__name__, f.value))
            yield f

    def _may_hold(self, page: dict) -> bool:
        first, last = page["first"], page["last"]
        meets = {"EqualTo": lambda v: first <= v <= last, "GreaterThan": lambda v: last > v, "GreaterThanOrEqual": lambda v: last >= v, "LessThan": lambda v: first < v, "LessThanOrEqual": lambda v: first <= v}
        return all(meets[kind](value) for kind, value in self.bounds)

    def partitions(self) -> Sequence[InputPartition]:
        wanted = [p for p in read_index(self.path) if p["file"] not in self.done and self._may_hold(p)]
        return [Page(p["file"], p["rows"]) for p in sorted(wanted, key=lambda p: p["first"])] or [Page("", 0)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, base = pafs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.columns)
        with fs.open_input_stream(f"{base}/pages/{partition.file}") as stream:
            table = pajson.read_json(stream, read_options=pajson.ReadOptions(use_threads=False), parse_options=pajson.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")).select(schema.names).cast(schema)
        if table.num_rows != partition.rows:
            raise ValueError(f"page {partition.file} has {table.num_rows} rows, its index says {partition.rows}")
        yield from table.to_batches(max_chunksize=10_000)


def read_index(path: str) -> list[dict]:
    """The index of a store: one small record a page."""
    fs, base = pafs.FileSystem.from_uri(path)
    out = []
    for f in fs.get_file_info(pafs.FileSelector(f"{base}/{INDEX}")):
        if f.base_name.startswith("part-"):
            with fs.open_input_stream(f.path) as stream:
                out += [json.loads(x) for x in stream.read().decode().splitlines()]
    return out


def read_pages(spark: SparkSession, path: str, schema: StructType, key: str, done: Sequence[str] = ()) -> DataFrame:
    """The records of a store but those of finished pages, with the page that each comes from left to its index."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format(NAME).schema(schema).options(path=path, key=key, done=",".join(done)).load()


def windows(spark: SparkSession, start: str, end_exclusive: str, days: int) -> DataFrame:
    """(number, start, end) of half-open windows of whole days that cover [start, end_exclusive); the last may be shorter."""
    if days <= 0:
        raise ValueError("a window has a day at least")
    span = F.datediff(F.to_date(F.lit(end_exclusive)), F.to_date(F.lit(start)))
    ids = spark.range(1).select(span.alias("span")).filter("span > 0").select("span", F.explode(F.sequence(F.lit(0), F.floor((F.col("span") - 1) / days).cast("int"))).alias("number"))
    first = F.date_add(F.to_date(F.lit(start)), F.col("number") * days)
    return ids.select("number", first.alias("start"), F.least(F.date_add(first, days), F.to_date(F.lit(end_exclusive))).alias("end"))


def outside_window(records: DataFrame, windows_: DataFrame, number: str, day: str) -> DataFrame:
    """Records that a window's payload holds although their day is not in it; a good download has none."""
    few = F.broadcast(windows_.withColumnRenamed("number", number))  # a row for each window of a download
    return records.join(few, number, "left").filter(F.col("start").isNull() | (F.to_date(day) < F.col("start")) | (F.to_date(day) >= F.col("end"))).drop("start", "end")
