"""How good the scores are: reports, curves, areas and calibration.

Labels are 0/1 integers and scores doubles. Curves are cumulated over distinct
scores, range-partitioned, so neither rows nor ties gather in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators.binning import assign_bins
from cohortlift.operators.numbering import running_totals


def classification_report(scored: DataFrame, label: str, score: str,
                          threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, and their averages.

    A row is predicted 1 above the threshold. Ratios with nothing below the
    line are 0. Accuracy is given in all three columns.
    """
    said, truth = F.col(score) > threshold, F.col(label) == 1
    counts = scored.agg(
        F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"),
        F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn"))
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    rows = tp + fp + fn + tn

    def measures(hit, wrongly_said, wrongly_not):
        precision, recall = ratio(hit, hit + wrongly_said), ratio(hit, hit + wrongly_not)
        return precision, recall, ratio(2 * precision * recall, precision + recall)

    zero, one = measures(tn, fn, fp), measures(tp, fp, fn)
    share = ratio(tp + fn, rows)
    line = lambda name, values, support: F.struct(
        F.lit(name).alias("class"),
        *[v.alias(n) for n, v in zip(("precision", "recall", "f1_score"), values)],
        support.alias("support"))
    lines = F.array(
        line("0", zero, tn + fp),
        line("1", one, tp + fn),
        line("accuracy", [ratio(tp + tn, rows)] * 3, rows),
        line("macro avg", [(a + b) / 2 for a, b in zip(zero, one)], rows),
        line("weighted avg", [a * (1 - share) + b * share for a, b in zip(zero, one)], rows),
    )
    return counts.select(F.explode(lines).alias("line")).select("line.*")


def threshold_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """For each distinct score as threshold: precision, recall, fpr and tpr.

    ``roc_part`` and ``pr_part`` are the areas between this threshold and the
    one above it; they add up to the areas under the curves.
    """
    per_score = (
        scored.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("_hits"), F.count("*").alias("_rows")))
    curve, totals = running_totals(
        per_score, [F.desc("threshold")], {"tp": F.col("_hits"), "said": F.col("_rows")})
    positives, negatives = totals["tp"] or 0, (totals["said"] or 0) - (totals["tp"] or 0)
    of = lambda count, total: count / F.lit(float(total)) if total else F.lit(0.0)
    tp, said = F.col("tp"), F.col("said")
    fp = said - tp
    tp_above, said_above = tp - F.col("_hits"), said - F.col("_rows")
    fp_above = said_above - tp_above
    precision = tp / said
    precision_above = F.when(said_above > 0, tp_above / said_above).otherwise(1.0)
    return curve.select(
        "threshold", tp.alias("tp"), fp.alias("fp"),
        precision.alias("precision"), of(tp, positives).alias("recall"),
        of(fp, negatives).alias("fpr"), of(tp, positives).alias("tpr"),
        (of(fp - fp_above, negatives) * (of(tp, positives) + of(tp_above, positives)) / 2)
        .alias("roc_part"),
        (of(tp - tp_above, positives) * (precision + precision_above) / 2).alias("pr_part"),
    )


def areas(curve: DataFrame) -> DataFrame:
    """One row: areas under the ROC and the precision-recall curve."""
    return curve.agg(F.sum("roc_part").alias("roc_auc"), F.sum("pr_part").alias("pr_auc"))


def calibration_table(scored: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score against actual rate in equal bins of [0, 1]; empty bins drop out."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    return (
        scored.withColumn("bin", assign_bins(score, edges))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.avg(score).alias("mean_score"),
             (F.sum(label) / F.count("*")).alias("actual_rate"),
             F.count("*").alias("rows"))
    )


def union_reports(reports: dict[str, DataFrame], name: str = "model") -> DataFrame:
    """Stack reports of several models, naming each."""
    named = [df.select(F.lit(key).alias(name), "*") for key, df in reports.items()]
    return reduce(DataFrame.unionByName, named)
