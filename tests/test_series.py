from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.operators.series import change, lags, rolling, with_series_columns

SCHEMA = "Name string, timestamp timestamp_ntz, v double"
START = datetime(2024, 1, 1)


def frame(spark, series):
    rows = [(name, START + timedelta(hours=h), v) for name, points in series.items() for h, v in points]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df, reach):
    w = W.partitionBy("Name").orderBy("timestamp")
    back = w.rowsBetween(-reach, -1)
    return df.withColumns(
        {
            "ma": F.avg("v").over(back),
            "low": F.min("v").over(back),
            "back": F.lag("v", reach).over(w),
        }
    )


def specs(reach):
    return [
        lambda w: {"ma": F.avg("v").over(w.rowsBetween(-reach, -1)), "low": F.min("v").over(w.rowsBetween(-reach, -1))},
        lags("v", (reach,), name=lambda k: "back"),
    ]


def same(a, b):
    rows = [sorted((tuple(r) for r in df.select(*a.columns).collect()), key=repr) for df in (a, b)]
    assert rows[0] == rows[1]


def test_row_frames_ignore_gaps(spark):
    df = frame(spark, {"A": [(h, float(h)) for h in (0, 1, 2, 50, 51)]})
    out = with_series_columns(df, [rolling("v", (24,), ("ma",))], reach=24).orderBy("timestamp")
    assert [r.v_ma_24 for r in out.collect()] == [None, 0.0, 0.5, 1.0, 13.25]


def test_change_plus_lag_gives_the_value_back(spark):
    df = frame(spark, {"A": [(h, h * 1.5) for h in range(30)]})
    out = with_series_columns(df, [change("v", 3, "step"), lags("v", (3,))], reach=3)
    assert out.where(F.col("step") + F.col("v_lag_3") != F.col("v")).isEmpty()
    assert out.where(F.col("step").isNull()).count() == 3


def test_rolling_bounds(spark):
    df = frame(spark, {"A": [(h, float((h * 7) % 13)) for h in range(60)]})
    out = with_series_columns(df, [rolling("v", (24,))], reach=24).where(F.col("v_ma_24").isNotNull())
    assert out.where((F.col("v_min_24") > F.col("v_ma_24")) | (F.col("v_ma_24") > F.col("v_max_24"))).isEmpty()


@pytest.mark.parametrize("block_rows", [24, 40, 100, 1000])
def test_blocks_equal_whole_series(spark, block_rows):
    # hours far apart in A cross many calendar cells; B is short; C is dense
    series = {
        "A": [(h * 200, float(h)) for h in range(150)],
        "B": [(h, 1.0) for h in range(5)],
        "C": [(h, float(h % 17)) for h in range(2000)],
    }
    df = frame(spark, series)
    same(with_series_columns(df, specs(24), reach=24, block_rows=block_rows), plain(df, 24))


@settings(max_examples=6, deadline=None, database=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    gaps=st.lists(st.integers(1, 900), min_size=1, max_size=120),
    reach=st.integers(1, 12),
    extra=st.integers(0, 20),
)
def test_blocks_equal_whole_series_for_any_gaps(spark, gaps, reach, extra):
    hours, points = 0, []
    for i, gap in enumerate(gaps):
        hours += gap
        points.append((hours, float(i * i % 31)))
    df = frame(spark, {"A": points, None: points[:3]})
    same(with_series_columns(df, specs(reach), reach=reach, block_rows=reach + extra), plain(df, reach))


def test_cells_get_finer_where_a_month_is_crowded(spark):
    # 30 rows an hour: a month, and even a day, exceed the block size
    rows = [("A", START + timedelta(hours=h), float(h * 100 + i)) for h in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = with_series_columns(df, [lags("v", (7,), name=lambda k: "back")], reach=7, ties=["v"], block_rows=50)
    same(out, df.withColumn("back", F.lag("v", 7).over(W.partitionBy("Name").orderBy("timestamp", "v"))))
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


@pytest.mark.parametrize("backwards", [False, True])
def test_blocks_with_missing_timestamps(spark, backwards):
    rows = [("A", None, float(-i)) for i in range(30)]
    rows += [("A", START + timedelta(hours=40 * h), float(h)) for h in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    spec = [lags("v", (5,), name=lambda k: "back")]
    got = with_series_columns(df, spec, reach=5, ties=["v"], backwards=backwards, block_rows=20)
    order = [F.desc("timestamp"), F.desc("v")] if backwards else ["timestamp", "v"]
    same(got, df.withColumn("back", F.lag("v", 5).over(W.partitionBy("Name").orderBy(*order))))


def test_backwards_blocks_look_ahead(spark):
    df = frame(spark, {"A": [(h * 30, float(h)) for h in range(300)]})
    ahead = with_series_columns(
        df, [lags("v", (5,), name=lambda k: "ahead")], reach=5, backwards=True, block_rows=40
    )
    want = df.withColumn("ahead", F.lead("v", 5).over(W.partitionBy("Name").orderBy("timestamp")))
    same(ahead, want)


def test_block_smaller_than_reach_is_refused(spark):
    with pytest.raises(ValueError):
        with_series_columns(frame(spark, {"A": [(0, 1.0)]}), specs(24), reach=24, block_rows=10)
