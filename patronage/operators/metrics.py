"""Model metrics as Spark aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import attach_row
from .rank import prefix_sums


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       group: str | None = None) -> DataFrame:
    """RMSE, MAE, R^2 (per ``group`` when given) in one aggregate."""
    err = F.col(label) - F.col(prediction)
    aggs = [F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
            # null for a constant label
            (1 - F.try_divide(F.sum(err * err), F.sum((F.col(label) - F.col("__ybar")) ** 2))).alias("r2")]
    ybar = pred.groupBy(*([group] if group else [])).agg(F.avg(label).alias("__ybar"))
    if group:
        j = pred.join(F.broadcast(ybar), group)
    else:
        j = attach_row(pred, ybar)
    return j.groupBy(*([group] if group else [])).agg(*aggs)


def classification_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return pred.agg(F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
                    F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
                    F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
                    F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn"))


def auc_frame(pred: DataFrame, label: str = "label", score: str = "score", group: str | None = None,
              decimals: int | None = None) -> DataFrame:
    """Exact tie-aware ROC AUC by the rank-sum over grouped scores.

    Rows are first reduced to one row per (group, score) with positive and
    negative counts (a map-side partial aggregate); negatives below each
    score come from a distributed prefix sum (range-sorted, no group in one
    task). ``decimals`` optionally bins the scores first.
    """
    s = F.col(score) if decimals is None else F.round(F.col(score), decimals)
    keys = [group] if group else []
    by = (pred.groupBy(*keys, s.alias("__s"))
          .agg(F.sum(F.col(label).cast("long")).alias("pos"),
               F.sum(1 - F.col(label).cast("long")).alias("neg")))
    by = prefix_sums(by, [F.col("__s")], ["neg"], keys, suffix="_below")
    return by.groupBy(*keys).agg(
        # null when one class is absent
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))),
                     F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str = "score") -> DataFrame:
    """accuracy, precision, recall, f1 (0 on an empty denominator), roc_auc."""
    c = classification_counts(pred, label, prediction)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    m = c.select(F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                 F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))
    a = auc_frame(pred, label, score)
    return attach_row(m, a)


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2 x 2 counts over a fixed 4-row scaffold (zero cells kept)."""
    spark = pred.sparkSession
    grid = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "actual int, predicted int")
    c = (pred.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted"))
         .agg(F.count(F.lit(1)).alias("n")))
    return grid.join(c, ["actual", "predicted"], "left").select("actual", "predicted",
                                                                 F.coalesce("n", F.lit(0)).alias("count"))


def roc_points(pred: DataFrame, label: str = "label", score: str = "score", decimals: int | None = None) -> DataFrame:
    """ROC and precision-recall points per distinct score (``decimals`` merges
    scores on request), from the highest threshold down: threshold, fpr, tpr, precision, recall. The
    running counts are distributed prefix sums; totals are one-row
    aggregates."""
    s = F.col(score) if decimals is None else F.round(F.col(score), decimals)
    by = (pred.groupBy(s.alias("threshold"))
          .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")))
    by = prefix_sums(by, [F.col("threshold").desc()], ["pos", "neg"], inclusive=True, suffix="_cum")
    by = attach_row(by.withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp"),
                    by.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    return by.select("threshold",
                     F.when(F.col("N") > 0, F.col("fp") / F.col("N")).otherwise(0.0).alias("fpr"),
                     F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0).alias("tpr"),
                     (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0).alias("recall"))
