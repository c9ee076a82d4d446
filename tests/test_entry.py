from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of
from panelmill import runtime
from workload.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, db, name):
    df = entry.queries()[name](spark, small)
    text = plan(df)
    for node in ("PythonUDF", "EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan(spark, small):
    text = plan(entry.queries()["featured_panel"](spark, small))
    assert text.count("Window [") == 1
    assert text.count("Exchange ") == 1
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_rollup_prunes_columns_and_combines_before_the_shuffle(spark, small):
    text = plan(entry.queries()["rollup_load_hourly"](spark, small))
    assert "partial_avg" in text
    assert "user_id" not in text.split("ReadSchema")[1]


def test_side_beyond_the_bound_is_not_broadcast(spark, monkeypatch):
    df = spark.range(100).withColumnRenamed("id", "k")
    side = spark.range(50).selectExpr("id AS k", "id * 2 AS v").union(spark.sql("SELECT NULL, -1L"))
    df = df.union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    near = runtime.attach(df, side, ["k"], how="left")
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = runtime.attach(df, side, ["k"], how="left")
        assert "SortMergeJoin" in plan(far) and "BroadcastHashJoin" in plan(near)
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert near.where("k IS NULL").first().v == -1


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert runtime.scratch_path(spark, "x").startswith(folder)
