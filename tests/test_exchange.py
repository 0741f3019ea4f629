import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged
from tidemark.sources.observed import record_set, sound_records, write_observed


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("näme "), F.col("id"))).alias("t"), F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    path = f"file://{tmp_path_factory.mktemp('pages')}/s"
    paged.write_pages(rows, path, "key", 10)
    return rows, path


def parts(df):
    return df.rdd.getNumPartitions()


def test_pages_hold_all_rows_and_filters_choose_pages(spark, store):
    rows, path = store
    index = sorted(paged.read_index(path), key=lambda p: p["first"])
    assert sum(p["rows"] for p in index) == 1000 and all(a["last"] < b["first"] for a, b in zip(index, index[1:]))
    read = lambda done=(): paged.read_pages(spark, path, rows.schema, "key", done)
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, rows.collect())) or {tuple(r) for r in read().collect()} == {tuple(r) for r in rows.collect()}
    assert parts(read()) == len(index)
    for where in ("key >= 200 and key < 230", "key = 500", "key > 990", "key <= 3", "key < 0", "x = 2.0"):
        some = read().filter(where)
        assert {r.key for r in some.collect()} == {r.key for r in rows.filter(where).collect()}, where
        met = [p for p in index if rows.filter(where).filter((F.col("key") >= p["first"]) & (F.col("key") <= p["last"])).count()]
        assert parts(some) == (len(index) if where.startswith("x") else max(1, len(met))), where


def test_a_download_goes_on_after_its_finished_pages(spark, store):
    rows, path = store
    index = sorted(paged.read_index(path), key=lambda p: p["first"])
    done = [p["file"] for p in index[:4]]
    rest = paged.read_pages(spark, path, rows.schema, "key", done)
    assert parts(rest) == len(index) - 4 and rest.count() == 1000 - sum(p["rows"] for p in index[:4])
    assert rest.filter(F.col("key") <= index[3]["last"]).count() == 0


def test_a_page_that_is_not_what_the_index_says_stops_the_job(spark, store, tmp_path):
    rows, _ = store
    path = f"file://{tmp_path}/s"
    paged.write_pages(rows.limit(50), path, "key", 3)
    victim = next(p for p in (tmp_path / "s" / "pages").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    victim.write_text("\n".join(victim.read_text().splitlines()[1:]) + "\n")
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="its index says"):
        paged.read_pages(spark, path, rows.schema, "key").collect()


def test_windows_are_half_open_and_cover_all_days(spark):
    got = [(r.start, r.end) for r in paged.windows(spark, "2024-02-25", "2024-03-10", 5).orderBy("number").collect()]
    assert got[0][0] == dt.date(2024, 2, 25) and got[-1][1] == dt.date(2024, 3, 10) and all(a[1] == b[0] for a, b in zip(got, got[1:])) and len(got) == 3
    assert paged.windows(spark, "2024-01-01", "2024-01-01", 3).count() == 0
    with pytest.raises(ValueError):
        paged.windows(spark, "2024-01-01", "2024-01-02", 0)
    records = spark.createDataFrame([(0, "2024-02-25"), (0, "2024-03-01"), (1, "2024-03-01"), (9, "2024-03-01")], "w int, day string")
    assert sorted((r.w, r.day) for r in paged.outside_window(records, paged.windows(spark, "2024-02-25", "2024-03-10", 5), "w", "day").collect()) == [(0, "2024-03-01"), (9, "2024-03-01")]


def test_a_write_reports_on_itself(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") - 40)
    figures = write_observed(rows, str(tmp_path / "w"), {"n": F.count("*"), "largest": F.max("x"), "below": F.count_if(F.col("x") < 0)})
    assert figures == {"n": 100, "largest": 59, "below": 40} and spark.read.parquet(str(tmp_path / "w")).count() == 100
    with pytest.raises(Exception, match="exists"):
        write_observed(rows, str(tmp_path / "w"), {"n": F.count("*")})


def test_faults_of_a_record_set_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"target": 1, "v": 1.5}\n{"target": 2, "v": 2.5}\n{"target": 3, "v"')
    (tmp_path / "b.json").write_text('{"target": 2, "v": 9.0}\n{"v": 4.0}\n{"target": 7, "v": "no"}\n')
    schema = spark.createDataFrame([], "target long, v double").schema
    rows = record_set(spark, str(tmp_path), schema, "target")
    got = sorted((str(r.target), r.file.rsplit("/", 1)[1], r.fault, r.n_files) for r in rows.collect())
    assert got == [("1", "a.json", None, 1), ("2", "a.json", "REPEATED_TARGET", 2), ("2", "b.json", "REPEATED_TARGET", 2), ("7", "b.json", "UNREADABLE", 1), ("None", "a.json", "UNREADABLE", 1), ("None", "b.json", "MISSING_KEY", 1)]
    with pytest.raises(Exception, match="REPEATED_TARGET|UNREADABLE|MISSING_KEY"):
        sound_records(rows, ["target", "v"]).collect()
    (tmp_path / "sound").mkdir()
    (tmp_path / "sound" / "c.json").write_text('{"target": 1, "v": 1.5}\n')
    assert [tuple(r) for r in sound_records(record_set(spark, str(tmp_path / "sound"), schema, "target"), ["target", "v"]).collect()] == [(1, 1.5)]
