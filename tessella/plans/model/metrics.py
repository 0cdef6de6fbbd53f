"""Evaluation of scores against truth, by sorting and cumulative counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranges import numbered, running_sums


def roc_points(df: DataFrame, truth: str, score: str, by: list[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, tpr, fpr) for each distinct score, highest first.

    Counts are summed per score before they are sorted, so the running sums are over distinct scores, range by range.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(truth).cast("long").alias("p"), F.sum(1 - F.col(truth)).cast("long").alias("n"))
    points = running_sums(counts, {"tp": "p", "fp": "n"}, [F.desc("threshold")], by, {"all_p": "p", "all_n": "n"})
    return points.withColumns({"tpr": F.col("tp") / F.nullif(F.col("all_p"), F.lit(0)), "fpr": F.col("fp") / F.nullif(F.col("all_n"), F.lit(0))})


def auc(df: DataFrame, truth: str, score: str, by: list[str] = ()) -> DataFrame:
    """(by, n, positives, roc_auc, pr_auc): area by trapezoids, and average precision; null with one class only."""
    by = list(by)
    points = roc_points(df, truth, score, by)
    area = (F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.col("all_p") * F.col("all_n"))
    precision = F.col("p") / F.col("all_p") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    one_class = (F.max("all_p") == 0) | (F.max("all_n") == 0)
    return points.groupBy(*by).agg(
        F.sum(F.col("p") + F.col("n")).alias("n"),
        F.max("all_p").alias("positives"),
        F.when(~one_class, F.sum(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), area))).alias("roc_auc"),
        F.when(~one_class, F.sum(F.when(F.col("all_p") > 0, precision))).alias("pr_auc"),
    )


def yearly_auc(df: DataFrame, truth: str, score: str, year: str, min_rows: int = 10, min_positives: int = 2) -> DataFrame:
    return auc(df, truth, score, [year]).where((F.col("n") >= min_rows) & (F.col("positives") >= min_positives))


def best_threshold(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, youden): where tpr - fpr is largest; of equal ones the highest threshold."""
    return roc_points(df, truth, score).agg(F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("youden"), "threshold")).alias("b")).select("b.threshold", "b.youden")


def recall_at_fpr(df: DataFrame, truth: str, score: str, most: float = 0.1) -> DataFrame:
    """(threshold, recall, precision) of the lowest threshold whose false positive rate is within the limit."""
    ok = roc_points(df, truth, score).where(F.col("fpr") <= most)
    return ok.agg(F.min(F.struct("threshold", "tpr", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))).alias("b")).select("b.threshold", F.col("b.tpr").alias("recall"), "b.precision")


def binary_summary(df: DataFrame, truth: str, score: str, cut: float = 0.5) -> DataFrame:
    """Brier score, confusion counts, precision, recall, F1, accuracy and MCC at a cut, in one pass."""
    t, p = F.col(truth), (F.col(score) >= cut).cast("int")
    counts = df.agg(F.avg(F.pow(F.col(score) - t, 2)).alias("brier"), F.sum(t * p).cast("double").alias("tp"), F.sum((1 - t) * p).cast("double").alias("fp"), F.sum(t * (1 - p)).cast("double").alias("fn"), F.sum((1 - t) * (1 - p)).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def recall_in_top(df: DataFrame, truth: str, score: str, key: str, share: float = 0.1) -> DataFrame:
    """(k, recall, lift): of the positives, those within the first int(n * share) rows by score, then key.

    Rows are numbered range by range of (score, key), so ties are dealt out too.
    """
    total = df.agg(F.floor(F.count("*") * share).alias("k"), F.sum(truth).alias("positives"))
    placed = numbered(df, "_r", [F.desc(score), F.col(key)])
    found = placed.crossJoin(F.broadcast(total)).agg(F.max("k").alias("k"), F.sum(F.when(F.col("_r") <= F.col("k"), F.col(truth)).otherwise(0)).alias("hits"), F.max("positives").alias("positives"))
    return found.select("k", (F.col("hits") / F.col("positives")).alias("recall"), (F.col("hits") / F.col("positives") / share).alias("lift"))


def count_errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """RMSE, RMSE and MAE of the rows above 0, and mean Poisson deviance."""
    y, m = F.col(truth), F.greatest(F.col(predicted), F.lit(1e-9))
    deviance = 2 * (F.when(y > 0, y * F.log(y / m)).otherwise(0.0) - (y - m))
    err = y - F.col(predicted)
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.sqrt(F.avg(F.when(y > 0, err * err))).alias("rmse_positive"), F.avg(F.when(y > 0, F.abs(err))).alias("mae_positive"), F.avg(deviance).alias("deviance"))


def tier_recall(df: DataFrame, truth: str, tier: str, tiers: tuple[str, ...]) -> DataFrame:
    """(tier, n, recall, precision) of all rows within a tier or a better one."""
    by_tier = df.groupBy(tier).agg(F.count("*").alias("n"), F.sum(truth).alias("p"))
    w = Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, 0)
    all_p = F.sum("p").over(Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by_tier.where(F.col(tier).isin(*tiers)).select(tier, F.sum("n").over(w).alias("n"), (F.sum("p").over(w) / all_p).alias("recall"), (F.sum("p").over(w) / F.sum("n").over(w)).alias("precision"))


def onset_kind(now, before, recent):
    """onset: above 0 after none recently; escalation: more than before; else other (null truth stays null)."""
    return F.when(now.isNull(), None).when((now > 0) & (F.coalesce(recent, F.lit(0)) == 0), "onset").when(now > F.coalesce(before, F.lit(0)), "escalation").otherwise("other")
