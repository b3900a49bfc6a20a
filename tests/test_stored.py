"""Versions of stored tables, refresh of applications and objects together, writers, and very long text records."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import catalog
from corvane.sources import tables, text_records
from corvane.sources.versions import VersionedTables
from corvane.streaming.refresh import refresh_stored

NOW = dt.datetime(2024, 1, 10)


def day(n):
    return dt.datetime(2024, 1, n)


def apps(spark, rows):
    return spark.createDataFrame(rows, "app string, modified timestamp, title string")


def objects(spark, rows):
    return spark.createDataFrame(rows, "app string, object string, modified timestamp, payload string")


def test_refresh_moves_both_tables(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "store"))
    assert store.read() == {} and store.versions() == []
    old_apps, old_objects = [("a", day(1), "A"), ("b", day(9), "B"), ("gone", day(1), "G")], [("a", "x", day(1), "1"), ("b", "y", day(1), "1"), ("gone", "z", day(9), "1")]
    assert store.write({"apps": apps(spark, old_apps), "objects": objects(spark, old_objects)}) == 1
    first = store.read()["objects"]
    new_apps = apps(spark, [("a", NOW, "A2"), ("b", NOW, "B2"), ("c", NOW, "C")])
    new_objects = objects(spark, [("a", "x", NOW, "2"), ("a", "w", NOW, "2"), ("b", "y", NOW, "2"), ("c", "v", NOW, "2")])
    assert refresh_stored(store, new_apps, new_objects, F.lit(NOW), 86400 * 3, 86400 * 3) == 2
    now = store.read()
    assert {(r.app, r.title, r.modified.day) for r in now["apps"].collect()} == {("a", "A2", 10), ("b", "B", 9), ("gone", "G", 1), ("c", "C", 10)}
    assert {(r.app, r.object, r.payload) for r in now["objects"].collect()} == {("a", "x", "2"), ("a", "w", "2"), ("b", "y", "1"), ("gone", "z", "1"), ("c", "v", "2")}
    assert {r.payload for r in first.collect()} == {"1"} and store.versions() == [2, 1]  # an open version stays readable
    assert store.read(1)["apps"].count() == 3
    with pytest.raises(ValueError):
        store.read(7)


def test_the_first_refresh_fills_an_empty_store(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "store"))
    assert refresh_stored(store, apps(spark, [("a", NOW, "A")]), objects(spark, [("a", "x", NOW, "1")]), F.lit(NOW)) == 1
    assert store.read()["apps"].count() == store.read()["objects"].count() == 1


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "store"))
    store.write({"apps": apps(spark, [("a", day(1), "A")]), "objects": objects(spark, [("a", "x", day(1), "1")])})
    broken = objects(spark, [("a", "x", NOW, "2")]).withColumn("payload", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        store.write({"apps": apps(spark, [("a", NOW, "B")]), "objects": broken})
    assert store.versions() == [1] and store.read()["apps"].first().title == "A"
    assert store.write({"apps": apps(spark, [("a", NOW, "C")])}) == 2 and store.read()["apps"].first().title == "C"


def test_writers(spark, tmp_path):
    commands = spark.createDataFrame([("p.a.X", "p", 1), ("q.b.X", "q", 2), ("q.c.X", "q", 3)], "command string, app string, n int")
    tables.write_catalog(commands, str(tmp_path / "catalog"))
    assert sorted(p.name for p in (tmp_path / "catalog").glob("app=*")) == ["app=p", "app=q"]
    back = spark.read.parquet(str(tmp_path / "catalog")).select("command", "app", "n")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, commands.collect()))
    samples = spark.createDataFrame([(t, f"c{i}", f"u{i}") for i in range(200) for t in (1, 2)], "type int, commands string, utterances string")
    orders = []
    for seed in ("1", "1", "2"):
        tables.write_samples(samples.repartition(5), str(tmp_path / f"samples{len(orders)}"), seed)
        orders.append([tuple(r) for r in spark.read.parquet(str(tmp_path / f"samples{len(orders)}")).coalesce(1).collect()])
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(map(tuple, samples.collect())) != orders[0]


def test_accounts(spark):
    accounts = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "app string, account string")
    assert catalog.accounts_of(accounts).count() == 4
    wanted = spark.createDataFrame([("a",), ("a",), ("c",)], "app string")
    assert sorted(r.account for r in catalog.accounts_of(accounts, wanted).collect()) == ["1", "2"]


def test_a_record_of_a_million_lines(spark):
    n = 1_000_000
    lines = spark.range(n + 3).select(
        F.lit("f").alias("file"), F.floor(F.col("id") / 50_000).alias("chunk"), F.col("id").alias("pos"),
        F.when(F.col("id") == 0, "start").when(F.col("id") == n + 1, "@other").when(F.col("id") == n + 2, "next").otherwise(F.concat(F.lit(" l"), F.col("id") % 10)).alias("line"),
    ).repartition(6)
    start = time.time()
    got = {(r.record, len(r.sample), r.sample[:9], r.sample[-3:]) for r in text_records.group_records(lines, variations=True).collect()}
    print("seconds", time.time() - start)
    assert got == {(1, 5 + 3 * n, "start\nl1\n", "\nl0"), (1, 5, "other", "her"), (2, 4, "next", "ext")}
