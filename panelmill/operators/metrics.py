"""Regression and classification quality, overall and per group, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.functions.ordering import DIGITS, leading, sort_key


def absolute_error(actual: str, predicted: str) -> Column:
    return F.abs(residual(actual, predicted))


def residual(actual: str, predicted: str) -> Column:
    return F.col(actual) - F.col(predicted)


def percentage_error(actual: str, predicted: str) -> Column:
    """Absolute error in percent of the actual; a zero actual counts as 0 percent, a missing side not at all."""
    y, error = F.col(actual), residual(actual, predicted)
    return F.when(y != 0, F.abs(error / y) * 100).when(error.isNotNull(), F.lit(0.0))


def regression_measures(actual: str, predicted: str) -> dict[str, Column]:
    """Aggregate expressions rmse, mae, r2 and mape over the rows that have both sides.

    The total sum of squares comes from the population variance, which Spark
    merges stably across partitions.
    """
    error = residual(actual, predicted)
    squared = F.avg(error * error)
    paired = F.when(error.isNotNull(), F.col(actual))
    return {
        "rmse": F.sqrt(squared),
        "mae": F.avg(F.abs(error)),
        "r2": 1 - F.try_divide(squared, F.nullif(F.var_pop(paired), F.lit(0.0))),
        "mape": F.coalesce(F.avg(percentage_error(actual, predicted)), F.lit(0.0)),
    }


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """rmse, mae, r2 and mape as one row, from one pass."""
    return df.agg(*[column.alias(name) for name, column in regression_measures(actual, predicted).items()])


def error_by(df: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """mae, mape and count of the rows with both sides, per group; groups without rows are absent."""
    return df.groupBy(group).agg(
        F.avg(absolute_error(actual, predicted)).alias("mae"),
        F.avg(percentage_error(actual, predicted)).alias("mape"),
        F.count(residual(actual, predicted)).alias("count"),
    )


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy, weighted precision, recall and f1 as one row.

    One aggregation of the rows gives the confusion matrix; the rest runs over
    its few cells.
    """
    cells = df.groupBy(F.col(label).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    as_label = F.struct(F.col("y").alias("class"), F.col("n").alias("support"), hit.alias("hits"), zero.alias("claimed"))
    as_claim = F.struct(F.col("p").alias("class"), zero.alias("support"), zero.alias("hits"), F.col("n").alias("claimed"))
    classes = (
        cells.select(F.inline(F.array(as_label, as_claim)))
        .groupBy("class")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "hits", "claimed")])
    )
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("claimed")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def weighted(measure: Column) -> Column:
        return F.try_divide(F.sum(measure * F.col("support")), F.sum("support"))

    return classes.agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve as one row; ``score`` is a number or a probability vector (its second entry).

    The area is the share of (positive, negative) pairs in which the positive
    has the higher score, ties counting half; NULL where a class is missing.
    Rows without label or score are left out; NaN scores highest.

    A pair first differs in one digit of its order-preserving keys.  So each
    row is counted under its first one to four digits, which combines before the
    shuffle, and negatives with a smaller digit behind the same leading ones are
    a running sum over at most 65,536 rows.  Nothing runs while this is planned.
    """
    kind = df.schema[score].dataType
    x = vector_to_array(score)[1] if isinstance(kind, VectorUDT) else F.col(score).cast("double")
    y = F.col(label).cast("double")
    keyed = df.select((y == 1).alias("hit"), sort_key(x).alias("key")).where("hit IS NOT NULL AND key IS NOT NULL")
    heads = [F.lit(0).cast("long"), *[leading(F.col("key"), d) for d in range(1, DIGITS + 1)]]
    levels = [
        F.struct(F.lit(d + 1).alias("level"), heads[d].alias("head"), heads[d + 1].alias("digits")) for d in range(DIGITS)
    ]
    counts = keyed.select("hit", F.inline(F.array(*levels))).groupBy("level", "head", "digits")
    counts = counts.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    along = W.partitionBy("level", "head").orderBy("digits").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("misses").over(along), F.lit(0))
    tied = F.when(F.col("level") == DIGITS, F.col("misses")).otherwise(0)
    # Products of counts outgrow a long.
    won = (F.col("hits").cast("double") * (below + tied / 2)).alias("won")
    top = F.col("level") == 1
    return counts.select("level", "hits", "misses", won).agg(
        F.try_divide(
            F.sum("won"),
            F.nullif(F.sum(F.when(top, F.col("hits"))).cast("double") * F.sum(F.when(top, F.col("misses"))), F.lit(0.0)),
        ).alias("auc_roc")
    )


def model_report(df: DataFrame, model_name: str, actual: str, predicted: str, features: int) -> DataFrame:
    """Evaluation record of a regressor: name, metrics map, time, test size and feature count.

    The test size counts rows with both sides; ``left_out`` in ``data_info`` the others.  Everything comes from one aggregation of the predictions.
    """
    measures = regression_measures(actual, predicted)
    entries = [part for name, column in measures.items() for part in (F.lit(name), column)]
    facts = df.agg(
        F.create_map(*entries).alias("metrics"),
        F.count(residual(actual, predicted)).alias("test_size"),
        F.count_if(residual(actual, predicted).isNull()).alias("left_out"),
    )
    return _record(facts, model_name, features)


def classifier_report(
    df: DataFrame, model_name: str, label: str, predicted: str, score: str, features: int
) -> DataFrame:
    """Evaluation record of a classifier: auc_roc, accuracy, precision, recall, f1 and spike_rate.

    Hand in stored predictions: the area, the confusion matrix and the counts each read them.
    """
    scored = df.select(label, predicted, score)
    area, marks = roc_auc(scored, label, score), classification_metrics(scored, label, predicted)
    rate = F.coalesce(F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)), F.lit(0.0)).alias("spike_rate")
    facts = scored.agg(F.count(F.lit(1)).alias("test_size"), rate)
    # Three frames of one row each, side by side.
    one = facts.withColumns({n: frame.select(n).scalar() for frame in (area, marks) for n in frame.columns})
    named = [part for n in (*area.columns, *marks.columns, "spike_rate") for part in (F.lit(n), F.col(n))]
    return _record(one.select(F.create_map(*named).alias("metrics"), "test_size"), model_name, features)


def _record(facts: DataFrame, model_name: str, features: int) -> DataFrame:
    counts = [c for c in ("test_size", "left_out") if c in facts.columns]
    pairs = [part for c in counts for part in (F.lit(c), F.col(c))]
    sizes = F.create_map(*pairs, F.lit("features"), F.lit(features).cast("long"))
    return facts.select(
        F.lit(model_name).alias("model_name"),
        "metrics",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        sizes.alias("data_info"),
    )


def append_history(records: Sequence[DataFrame]) -> DataFrame:
    """Evaluation records of several models, in order of evaluation."""
    history = records[0]
    for record in records[1:]:
        history = history.unionByName(record)
    return history


def compare_models(history: DataFrame, metric: str = "rmse", *, ascending: bool = True) -> DataFrame:
    """Models ranked by one metric; models that lack it are left out."""
    ranked = history.select(
        F.col("model_name").alias("model"), F.try_element_at("metrics", F.lit(metric)).alias(metric), "timestamp"
    ).where(F.col(metric).isNotNull())
    return ranked.orderBy(F.col(metric).asc() if ascending else F.col(metric).desc(), "model")
