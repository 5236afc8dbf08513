"""Ordered export: order over files, odd texts, headers, and nothing left by a failed task."""

import pathlib

import pytest
from pyspark.sql import functions as F

from swipewatch.sources import readers
from swipewatch.sources.ordered import read_ordered, write_ordered

SCHEMA = "k int, t string, v double"


@pytest.mark.parametrize("file_rows", [3, 1_000_000])
def test_round_trip_keeps_order_nulls_and_odd_texts(spark, tmp_path, file_rows):
    texts = ["", None, 'a "quoted", comma', "two\nlines\r\nand more", " spaces ", "ünï,\"", "\\", '"', "NULL"]
    rows = [(i % 4 if i % 9 else None, texts[i % len(texts)], None if i % 5 == 0 else i / 7) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    path = str(tmp_path / "out")
    write_ordered(df, path, [F.asc_nulls_first("k"), F.desc_nulls_last("v")], file_rows=file_rows)
    got = [tuple(r) for r in read_ordered(spark, path, SCHEMA).orderBy("position").collect()]
    assert [r[0] for r in got] == list(range(1, 201))
    place = lambda r: (r[0] is not None, r[0] or 0, r[2] is None, -(r[2] or 0))
    assert [place(r[1:]) for r in got] == sorted(place(r) for r in rows)
    missing = sorted(set(map(str, rows)) ^ {str(r[1:]) for r in got})[:6]
    assert not missing and len(got) == len(rows)


def test_many_rows_of_one_key_are_spread_over_files(spark, tmp_path):
    path = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("t"), F.lit(0.5).alias("v")), str(path), ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [sum(1 for _ in open(f)) for f in path.glob("part-*")]
    assert len(sizes) == 8 and max(sizes) < 4_000
    assert read_ordered(spark, str(path), SCHEMA).select("position").distinct().count() == 10_000


def test_empty_tables(spark, tmp_path):
    write_ordered(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), ["k"])
    assert read_ordered(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_failed_task_leaves_no_file(spark, tmp_path):
    path = tmp_path / "out"
    broken = spark.range(100).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 63, F.raise_error(F.lit("stop here"))).otherwise("x").alias("t"), F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="stop here"):
        write_ordered(broken, str(path), ["k"])
    assert not list(path.rglob("part-*")) and not (path / "_SUCCESS").exists()


def test_second_file_with_another_header_or_a_byte_order_mark(spark, tmp_path):
    def folder(name, second):
        d = tmp_path / name
        d.mkdir()
        (d / "a.csv").write_bytes(b"k,t,v\n1,x,0.5\n")
        (d / "b.csv").write_bytes(second)
        return str(d)

    mark = b"\xef\xbb\xbf"
    good = folder("good", mark + b"k,t,v\n2,y,1.5\n")
    assert [tuple(r) for r in read_ordered(spark, good, SCHEMA).orderBy("position").collect()] == [(1, 1, "x", 0.5), (2, 2, "y", 1.5)]
    for name, text in (("other", b"k,v,t\n2,1.5,y\n"), ("fewer", b"k,t\n2,y\n"), ("none", b"2,y,1.5\n")):
        with pytest.raises(Exception):  # noqa: B017
            read_ordered(spark, folder(name, text), SCHEMA).collect()
    # the raw table's contract, too
    assert readers.read_raw_csv(spark, good, ("k", "t", "v")).orderBy("k").collect()[1]["t"] == "y"
    first = tmp_path / "first"
    first.mkdir()
    (pathlib.Path(first) / "a.csv").write_bytes(mark + b"k,t,v\n1,x,0.5\n")
    assert readers.read_raw_csv(spark, str(first), ("k", "t", "v")).count() == 1
