"""Model metrics from (label, prediction) rows: all from small tables of counts and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import group_key, ref
from factsieve.plans.ordering import running_total
from factsieve.plans.store import materialize

MAX_LABELS = 400


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mae, mse, rmse, r2, n."""
    y, p = ref(label).cast("double"), ref(prediction).cast("double")
    s = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("var"))
    return s.select("n", "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("mse"), F.col("var"))).alias("r2"))


def label_pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(ref(label).cast("string").alias("label"), ref(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, max_labels: int = MAX_LABELS) -> DataFrame:
    """label, prediction, count for every pair of labels, zero cells included; a missing label or prediction is the label ``nan``."""
    named = df.select(group_key(ref(label)).alias("label"), group_key(ref(prediction)).alias("prediction"))
    pairs = materialize(label_pairs(named, "label", "prediction"), "confusion")
    seen = pairs.select(F.explode(F.array("label", "prediction")).alias("v")).distinct().limit(max_labels + 1)
    labels = [r["v"] for r in seen.orderBy("v").collect()]
    if len(labels) > max_labels:
        raise ValueError(f"More than {max_labels} labels.")
    spine = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "label string, prediction string")
    return spine.join(pairs, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("count", F.lit(0)).alias("count"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy and support-weighted precision, recall, f1; an undefined ratio counts 0."""
    pairs = label_pairs(df, label, prediction)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("count").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("support"), F.col("count").alias("called"),
                 F.lit(0).cast("long").alias("hit")))
    per = pairs.select(F.inline(sides)).groupBy("c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"),
                                                       F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit") * 1.0, F.col("called")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit") * 1.0, F.col("support")), zero)
    per = per.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")), zero))
    n = F.sum("support")
    return per.agg(n.alias("n"), (F.sum("hit") * 1.0 / n).alias("accuracy"), *[
        (F.sum(F.col("support") * F.col(m)) / n).alias(m) for m in ("precision", "recall", "f1")])


def roc_auc(df: DataFrame, positive: str, score: str, rows_per_slice: int | None = None) -> DataFrame:
    """Area under the curve by mid-ranks over distinct scores; null without both classes."""
    by_score = df.where(ref(score).isNotNull() & ref(positive).isNotNull()).groupBy(ref(score).cast("double").alias("s")).agg(
        F.count_if(ref(positive)).alias("pos"), F.count_if(~ref(positive)).alias("neg"))
    args = {} if rows_per_slice is None else {"rows_per_slice": rows_per_slice}
    placed = running_total(materialize(by_score, "scores"), [], ["s"], "neg", "before", **args)
    won = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0).cast("double"))
    return placed.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"),
                      F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
