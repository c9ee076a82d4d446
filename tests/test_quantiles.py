import math

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from panelmill.functions.ordering import leading, sort_key
from panelmill.operators import quantiles
from panelmill.operators.quantiles import exact_percentiles

NAMES = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def brute(values):
    return {n: float(np.percentile(values, p * 100)) for n, p in NAMES.items()}


def check(row, values):
    want = brute(values)
    for name in NAMES:
        assert abs(row[name] - want[name]) <= 1e-9 * max(1.0, abs(want[name])), (name, row, want)


@settings(max_examples=5, deadline=None, database=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    groups=st.dictionaries(
        st.sampled_from(["a", "b", "c"]),
        st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=40),
        min_size=1,
    )
)
def test_percentiles_equal_brute_force(spark, groups):
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    rows = {r.k: r for r in exact_percentiles(df, ["k"], "v", NAMES).collect()}
    assert rows.keys() == groups.keys()
    for k, values in groups.items():
        check(rows[k], values)


@pytest.mark.parametrize("slot_rows", [0, 3, 100_000])
def test_depth_of_the_search_changes_nothing(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(quantiles, "SLOT_ROWS", slot_rows)
    values = [float((i * 7919) % 1000) for i in range(3000)] + [1e9] * 5
    df = spark.createDataFrame([("hot", v) for v in values] + [("one", 4.0), (None, 2.0), (None, 3.0)], "k string, v double")
    rows = {r.k: r for r in exact_percentiles(df, ["k"], "v", NAMES).collect()}
    check(rows["hot"], values)
    check(rows["one"], [4.0])
    check(rows[None], [2.0, 3.0])


def test_whole_column_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,), (float("nan"),)], "v double")
    assert [tuple(r) for r in exact_percentiles(df, [], "v", {"median": 0.5}).collect()] == [(2.0,)]


def test_group_without_values_keeps_its_other_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    out = exact_percentiles(df, ["k"], "v", {"median": 0.5}, alongside={"rows": F.count(F.lit(1))})
    assert {r.k: (r.rows, r.median) for r in out.collect()} == {"a": (2, 2.0), "b": (1, None)}


def test_keys_order_as_doubles_do(spark):
    values = [-math.inf, -1e308, -2.0, -1.0000000000000002, -1.0, -5e-324, 0.0, 5e-324, 1.0, 2.0, 1e308, math.inf, math.nan]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, -0.0, None])], "i int, v double")
    keyed = df.select("i", sort_key(F.col("v")).alias("k")).select("*", *[leading(F.col("k"), d).alias(f"d{d}") for d in (1, 2, 3, 4)])
    rows = {r.i: r for r in keyed.collect()}
    for part in ("k", "d4"):
        found = [rows[i][part] for i in range(len(values))]
        assert found == sorted(found) and len(set(found)) == len(found)
    assert all(rows[i]["d1"] <= rows[i + 1]["d1"] for i in range(len(values) - 1))
    assert rows[len(values)].k == rows[6].k and rows[len(values) + 1].k is None


def test_gap_beside_the_wanted_rank(spark):
    """Half of the values lie within one part in 10^12 of each other, the rest far away: ranks next to the gap are exact."""
    values = [1.0 + i * 1e-13 for i in range(500)] + [1e300 - i for i in range(499)] + [-1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_percentiles(df, [], "v", {"q": 0.5, "r": 0.25, "low": 0.0}).first()
    want = np.sort(values)
    assert row.low == -1e-300
    assert row.r == pytest.approx(float(np.percentile(want, 25)), rel=1e-15)
    assert row.q == pytest.approx(float((want[499] + want[500]) / 2), rel=1e-15)


def test_input_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(1000).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS v").mapInArrow(seen, "k long, v double")
    out = exact_percentiles(df, ["k"], "v", NAMES, alongside={"rows": F.count(F.lit(1)), "mean": F.avg("v")})
    assert out.count() == 3 and out.first()["rows"] in (333, 334)
    assert read.value == 1000


def test_places_by_function(spark):
    rows = [("a", float(v)) for v in (5, 1, 4, 2, 3)] + [("b", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = exact_percentiles(df, ["k"], "v", {"second": lambda n: F.least(F.lit(1), n - 1), "half": 0.5})
    assert {r.k: (r.second, r.half) for r in got.collect()} == {"a": (2.0, 3.0), "b": (7.0, 7.0), "c": (None, None)}
