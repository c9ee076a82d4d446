"""Incremental roll-ups: late rows, repeated calls, half-written batches, compaction, empty and null values."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill.operators.increments import RollupStore, merged, partial_state

SCHEMA = "timestamp timestamp_ntz, Name string, PTID int, Load double, zone string"
START = datetime(2024, 3, 1)


def rows(n, offset=0, base=1e9):
    """Values far from zero, where sums of squares would cancel."""
    out = []
    for i in range(offset, offset + n):
        value = None if i % 11 == 0 else base + (i * 37 % 101) / 7
        out.append((START + timedelta(minutes=i % 300), "AB"[i % 2] if i % 13 else None, 1, value, f"z{i % 3}"))
    return out


@pytest.fixture
def store(spark, tmp_path):
    return RollupStore(spark, str(tmp_path / "store"), measures=["Load"], label="zone")


def reader(spark):
    return lambda paths: spark.read.schema(SCHEMA).parquet(*paths)


def check(spark, store, held):
    full = spark.createDataFrame(held, SCHEMA).groupBy(
        (F.to_date("timestamp").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("timestamp"))).alias("timestamp"),
        "Name",
        "PTID",
    )
    want = {
        (r.timestamp, r.Name): r
        for r in full.agg(
            F.count("*").alias("rows"), F.avg("Load").alias("avg"), F.stddev("Load").alias("std"), F.min("Load").alias("low"),
            F.max("Load").alias("high"), F.count("Load").alias("n"), F.min(F.struct(F.col("timestamp").alias("at"), "zone")).alias("first"),
        ).collect()
    }
    got = {(r.timestamp, r.Name): r for r in store.rollup().collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g.rows, g.Load_n, g.Load_min, g.Load_max, g.zone) == (w.rows, w.n, w.low, w.high, w["first"].zone)
        for a, b in ((g.Load_avg, w.avg), (g.Load_std, w.std)):
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-6), (key, a, b)


def test_increments_equal_one_run(spark, tmp_path, store):
    feed, held = tmp_path / "feed", []
    for i in range(4):
        part = rows(150, 150 * i)
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.parquet(str(feed / str(i)))
        held += part
        assert store.take(f"{feed}/*/*.parquet", reader(spark)) == 2
        assert store.take(f"{feed}/*/*.parquet", reader(spark)) == 0
        if i == 2:
            store.compact()
            assert len(store.batches()) == 1
        check(spark, store, held)
    assert store.ledger().where("path IS NOT NULL").count() == 8


def test_a_batch_without_ledger_entry_does_not_count(spark, tmp_path, store, monkeypatch):
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows(40), SCHEMA).coalesce(1).write.parquet(feed)

    def lost(entries):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(store, "_commit", lost)
    with pytest.raises(RuntimeError):
        store.take(f"{feed}/*.parquet", reader(spark))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no batch"):
        store.rollup()
    assert store.take(f"{feed}/*.parquet", reader(spark)) == 1
    check(spark, store, rows(40))


def test_only_new_files_are_read(spark, tmp_path, store):
    feed = tmp_path / "feed"
    for i in range(2):
        spark.createDataFrame(rows(20, 20 * i), SCHEMA).coalesce(1).write.parquet(str(feed / str(i)))
        asked = []
        store.take(f"{feed}/*/*.parquet", lambda paths: asked.extend(paths) or reader(spark)(paths))
        assert len(asked) == 1 and f"/feed/{i}/" in asked[0]


def test_a_filter_on_the_hours_reaches_the_states(spark, tmp_path, store):
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows(400), SCHEMA).write.parquet(feed)
    store.take(f"{feed}/*.parquet", reader(spark))
    late = store.rollup().where(F.col("timestamp") >= F.lit(START + timedelta(hours=4)).cast("timestamp_ntz"))
    assert {r.timestamp.hour for r in late.collect()} == {4}
    assert "GreaterThanOrEqual(bucket" in late._jdf.queryExecution().executedPlan().toString()


def test_states_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, Load double")
    states = df.groupBy("k").agg(partial_state("Load").alias("s"))
    both = states.agg(merged(F.array_sort(F.collect_list("s"))).alias("m")).first().m
    assert (both.n, both.mean, both.m2, both.low, both.high) == (1, 2.0, 0.0, 2.0, 2.0)
    none = states.where("k = 'a'").agg(merged(F.collect_list("s")).alias("m")).first().m
    assert (none.n, none.mean, none.low) == (0, None, None)
