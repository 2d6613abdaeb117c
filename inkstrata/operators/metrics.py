"""Evaluation: rates, rank metrics, token and boundary scores, thresholds, hard cases.

All are conditional aggregates or ranks inside groups. Ratios are doubles; empty classes give null
where the measure is undefined and 0 where the guard of the definition says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(hits: Column, total: Column) -> Column:
    """hits / total with the total floored at 1."""
    return F.count_if(hits) / F.greatest(F.count_if(total), F.lit(1))


def binary_rates(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """False positive and negative rate and accuracy on mixed documents; a mixed prediction is wrong for either pure class."""
    t, p = F.col(truth), F.col(predicted)
    return df.groupBy(*by).agg(F.count("*").alias("n"), ratio((t == "human") & (p != "human"), t == "human").alias("fpr"), ratio((t == "ai") & (p != "ai"), t == "ai").alias("fnr"), ratio((t == "mixed") & (p == "mixed"), t == "mixed").alias("mixed_accuracy"))


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC with half credit for ties; null if a class is empty.

    Scores are first counted, so ranks run over distinct scores only.
    """
    by = df.where(f"{score} is not null").groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = by.select("p", "n", (F.col("p") * (below + F.col("n") / F.lit(2.0))).alias("w"))
    return wins.agg(F.try_divide(F.sum("w"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def tpr_at_fpr(df: DataFrame, score: str, positive: str, fpr: float) -> DataFrame:
    """Share of positives at or above the k-th largest negative, k = floor(fpr * negatives); above all negatives where k is 0."""
    by = df.where(f"{score} is not null").groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    totals = by.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"), F.max(F.when(F.col("n") > 0, F.col("s"))).alias("top"))
    above = F.sum("n").over(W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0))
    k = F.floor(F.lit(fpr) * F.col("all_n"))
    at = by.withColumn("above", above).crossJoin(F.broadcast(totals))  # one row
    threshold = at.agg(F.max(F.when((k > 0) & (F.col("above") >= k) & (F.col("n") > 0), F.col("s"))).alias("kth"), F.max("top").alias("top"), F.max("all_p").alias("all_p")).select(F.coalesce("kth", F.col("top") + 1e-9).alias("threshold"), "all_p")
    hits = by.crossJoin(F.broadcast(threshold)).agg(F.first("threshold").alias("threshold"), F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("p")).otherwise(0)).alias("hits"), F.first("all_p").alias("all_p"))
    return hits.select("threshold", F.try_divide(F.col("hits"), F.col("all_p")).alias("tpr"))


def token_scores(df: DataFrame, truth: str, predicted: str, classes: int = 3) -> DataFrame:
    """Accuracy, F1 of each class and their mean over classes that occur on either side."""
    t, p = F.col(truth), F.col(predicted)
    f1 = [F.try_divide(2.0 * F.count_if((t == c) & (p == c)), F.count_if(t == c) + F.count_if(p == c)) for c in range(classes)]
    row = df.agg(F.try_divide(F.count_if(t == p), F.count("*")).alias("accuracy"), *[f1[c].alias(f"f1_{c}") for c in range(classes)])
    sums = reduce(lambda a, b: a + b, [F.coalesce(f"f1_{c}", F.lit(0.0)) for c in range(classes)])
    seen = reduce(lambda a, b: a + b, [F.when(F.col(f"f1_{c}").isNotNull(), 1).otherwise(0) for c in range(classes)])
    return row.withColumn("macro_f1", F.try_divide(sums, seen))


def boundaries(tokens: DataFrame, doc: str, pos: str, label: str) -> DataFrame:
    """Positions after which the label changes."""
    follow = F.lead(label).over(W.partitionBy(doc).orderBy(pos))
    return tokens.withColumn("_next", follow).where(F.col("_next").isNotNull() & (F.col("_next") != F.col(label))).select(doc, (F.col(pos) + 1).alias("pos"))


def boundary_scores(tokens: DataFrame, doc: str, pos: str, truth: str, predicted: str, tolerance: int = 8) -> DataFrame:
    """Precision, recall and F1 of label changes within a tolerance, per document; 1 where neither side has any.

    The range condition is met by bins of the tolerance: an equi-join on neighbouring bins, not a cross join.
    """
    t, p = boundaries(tokens, doc, pos, truth), boundaries(tokens, doc, pos, predicted)
    size = tolerance + 1
    near = lambda b: b.select(doc, F.col("pos").alias("other"), F.explode(F.array(*[(F.floor(F.col("pos") / size) + d) for d in (-1, 0, 1)])).alias("bin"))
    hit = lambda a, b: a.withColumn("bin", F.floor(F.col("pos") / size)).join(near(b), [doc, "bin"]).where(F.abs(F.col("pos") - F.col("other")) <= tolerance).select(doc, "pos").distinct().groupBy(doc).count()
    docs = tokens.select(doc).distinct()
    count = lambda b, name: b.groupBy(doc).agg(F.count("*").alias(name))
    rows = docs.join(count(t, "n_t"), doc, "left").join(count(p, "n_p"), doc, "left").join(hit(t, p).withColumnRenamed("count", "h_t"), doc, "left").join(hit(p, t).withColumnRenamed("count", "h_p"), doc, "left").na.fill(0)
    none = (F.col("n_t") == 0) & (F.col("n_p") == 0)
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide("h_p", "n_p"), F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide("h_t", "n_t"), F.lit(0.0)))
    return rows.select(doc, precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(df: DataFrame, truth: str, predicted: str, classes: int = 4) -> DataFrame:
    """Rows of the confusion matrix with the recall of each true class."""
    counts = [F.count_if(F.col(predicted) == c).alias(f"predicted_{c}") for c in range(classes)]
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth")).agg(*counts, F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("recall"))


def best_threshold(df: DataFrame, score: str, positive: str) -> DataFrame:
    """First of the scores rounded to 3 places that minimises false positive plus false negative rate (positive from the threshold on)."""
    by = df.where(f"{score} is not null").groupBy(F.round(score, 3).alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    up = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fpr, fnr = F.sum("n").over(up) / F.greatest(F.sum("n").over(every), F.lit(1)), 1.0 - F.sum("p").over(up) / F.greatest(F.sum("p").over(every), F.lit(1))
    rows = by.select("threshold", fpr.alias("fpr"), fnr.alias("fnr")).withColumn("loss", F.round(F.col("fpr") + F.col("fnr"), 9))
    return rows.agg(F.min_by(F.struct("threshold", "fpr", "fnr"), F.struct("loss", "threshold")).alias("b")).select("b.*")


def hard_cases(df: DataFrame, truth: str, predicted: str, f_ai: str, margin: float, mixed: bool = False) -> DataFrame:
    """Wrong documents and near misses (human above the margin, ai below one minus it), with the reason."""
    t, p, f = F.col(truth), F.col(predicted), F.col(f_ai)
    near = ((t == "human") & (f > margin)) | ((t == "ai") & (f < 1 - margin))
    reason = F.when(t != p, "error").when(near, "near_miss")
    kept = df if mixed else df.where(t != "mixed")
    return kept.withColumn("reason", reason).where("reason is not null")


def mining_counters(df: DataFrame, truth: str, predicted: str, f_ai: str, margin: float) -> DataFrame:
    t, p, f = F.col(truth), F.col(predicted), F.col(f_ai)
    near = (t == p) & (((t == "human") & (f > margin)) | ((t == "ai") & (f < 1 - margin)))
    return df.agg(F.count("*").alias("seen"), F.count_if((t == "human") & (p != "human")).alias("false_positives"), F.count_if((t == "ai") & (p != "ai")).alias("false_negatives"), F.count_if(near).alias("near_misses"), F.round(F.count_if(t != p) / F.greatest(F.count("*"), F.lit(1)), 5).alias("error_rate"))
