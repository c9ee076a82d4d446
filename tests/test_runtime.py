import pytest
from pyspark.sql import functions as F

from panelmill import runtime
from panelmill.operators.models import run_together
from panelmill.operators.rollup import rollup_load
from panelmill.plans.panels import featured_panel
from workload.queries import hourly_panel


@pytest.fixture()
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    return lambda: sorted(p.name for p in tmp_path.glob("panelmill-*/*"))


def test_released_table_goes_with_its_last_reader(spark, folder):
    table = runtime.materialize(spark.range(10), "numbers")
    with runtime.reading(table.where("id > 3")):
        runtime.release(table)
        assert len(folder()) == 1 and table.where("id > 3").count() == 6
    assert folder() == []
    runtime.release(table.sparkSession.range(3), None)


def test_scope_removes_all_but_what_is_kept(spark, folder):
    with runtime.scope(spark) as outer:
        with runtime.scope(spark) as inner:
            runtime.materialize(spark.range(3), "gone")
            kept = inner.keep(runtime.materialize(spark.range(4), "kept"))
            work = {n: lambda: runtime.materialize(spark.range(5), "thread") for n in "ab"}
            assert len(run_together(spark, work)) == 2 and len(folder()) == 4
        assert [f.split("-")[0] for f in folder()] == ["kept"] and kept.count() == 4
        assert outer.folders
    assert folder() == []


def test_scope_ends_with_an_error(spark, folder):
    with pytest.raises(ValueError), runtime.scope(spark):
        runtime.materialize(spark.range(3), "gone")
        raise ValueError
    assert folder() == []


def test_featured_panel_leaves_nothing_behind(spark, small, folder):
    plain = featured_panel(hourly_panel(spark, small)).count()
    assert folder()
    before = folder()
    with runtime.scope(spark):
        assert featured_panel(hourly_panel(spark, small)).count() == plain
        assert len(folder()) > len(before)
    assert folder() == before


def test_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    side = runtime.materialize(spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).alias("v")))

    def hinted():
        return "broadcast" in runtime.attach(df, side, ["k"], rows=5)._jdf.queryExecution().analyzed().toString()

    assert runtime.planned_bytes(side) > 0 and hinted()
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 10)
    assert not hinted() and runtime.attach(df, side, ["k"], rows=5).count() == 100


def test_writes_leave_no_shuffle_files(spark):
    assert spark.conf.get(runtime.SHUFFLE_CLEANUP, None) != "true"
    table = runtime.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and spark.conf.get(runtime.SHUFFLE_CLEANUP, None) != "true"


def test_earliest_label_without_a_sort_of_raw_rows(spark):
    rows = [(f"2024-01-01 00:{m:02d}:00", "A", load, zone) for m, load, zone in
            [(5, 2.0, "EST"), (5, 4.0, "EDT"), (9, None, "AAA"), (30, 6.0, None)]]
    rows += [("2024-01-01 01:00:00", "A", None, None), ("2024-01-01 01:00:00", "A", None, "EST")]
    df = spark.createDataFrame(rows, "t string, Name string, Load double, `Time Zone` string")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("timestamp"), "Name", "Load", "Time Zone")
    out = rollup_load(df, zone_label="Time Zone")
    got = {r["timestamp"].hour: (r["Load_MW"], r["Time_Zone"]) for r in out.collect()}
    assert got == {0: (4.0, "EDT"), 1: (None, None)}
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    # The last two aggregates of the plan see the raw rows.
    assert [line.split("(")[0].strip(" +-:") for line in plan if "Aggregate" in line][-2:] == ["HashAggregate"] * 2
