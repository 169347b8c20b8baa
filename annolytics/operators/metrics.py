"""Classification, ranking, calibration and abstention metrics from contingency cells and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def confusion(df: DataFrame, by: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """by, y_true, y_pred, n: what all label metrics are computed from; one hash aggregate over the rows."""
    return df.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, label, tp, support, predicted over the union of true and predicted labels."""
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")),
    )
    x = cells.select(*by, F.explode(sides).alias("x")).select(*by, "x.*")
    return x.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))


def per_class(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, label, precision, recall, f1, support; zero where a denominator is zero."""
    c = class_counts(cells, by)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select(
        *by, "label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support",
    )


def classification_metrics(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, n, accuracy, f1_macro, precision_macro, recall_macro, f1_weighted, mcc (0 when degenerate)."""
    c = class_counts(cells, by)
    p = per_class(cells, by)
    macro = p.groupBy(*by).agg(
        F.avg("f1").alias("f1_macro"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )
    d = lambda x: F.col(x).cast("double")
    sums = c.groupBy(*by).agg(F.sum("tp").alias("hit"), F.sum("support").alias("n"), F.sum(d("support") * d("predicted")).alias("tp_"), F.sum(d("support") * d("support")).alias("tt"), F.sum(d("predicted") * d("predicted")).alias("pp"))
    n = d("n")
    below = F.sqrt((n * n - d("pp")) * (n * n - d("tt")))
    sums = sums.withColumns({"accuracy": d("hit") / n, "mcc": F.when(below > 0, (d("hit") * n - d("tp_")) / below).otherwise(0.0)})
    joined = sums.join(macro, by) if by else sums.crossJoin(macro)  # one row each
    return joined.select(*by, "n", "accuracy", "f1_macro", "precision_macro", "recall_macro", "f1_weighted", "mcc")


def roc_auc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """One row: auc and average_precision of a score against a binary label; ties share their rank (step interpolation).

    Counts are taken by distinct score first, so the running sums go over score values, not rows.
    """
    g = df.select(score.alias("s"), positive.cast("int").alias("y")).groupBy("s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    w = W.orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    g = g.withColumns({"tp": F.sum("p").over(w), "k": F.sum("c").over(w), "positives": F.sum("p").over(every), "negatives": F.sum(F.col("c") - F.col("p")).over(every)})
    neg = (F.col("c") - F.col("p")).cast("double")
    above = F.col("tp") - F.col("p") / 2.0
    auc = F.sum(neg * above) / F.max(F.col("positives").cast("double") * F.col("negatives"))
    return g.agg(auc.alias("roc_auc"), F.sum(F.col("p") / F.col("positives") * F.col("tp") / F.col("k")).alias("average_precision"))


def brier(scores: dict[str, Column], true: Column) -> Column:
    return sum(((F.when(true == c, 1.0).otherwise(0.0) - s) ** 2 for c, s in scores.items()), F.lit(0.0))


def reliability(df: DataFrame, confidence: Column, correct: Column, *, n_bins: int = 10) -> DataFrame:
    """bin (from 0), n, mean_confidence, accuracy: equal-width, right-closed bins; empty ones are left out."""
    b = F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.ceil(F.round(confidence * n_bins, 9)) - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def negative_log_likelihood(p_true: Column) -> Column:
    return -F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p_true)))


def temperature_scaled(scores: dict[str, Column], temperature: float) -> dict[str, Column]:
    powered = {c: F.pow(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), s)), F.lit(1 / temperature)) for c, s in scores.items()}
    total = sum(powered.values(), F.lit(0.0))
    return {c: p / total for c, p in powered.items()}


def abstention(df: DataFrame, confidence: Column, correct: Column, threshold: float) -> DataFrame:
    """One row: coverage, answered, accuracy_answered, accuracy_abstained, accuracy_all at a threshold."""
    c, ok = confidence >= threshold, correct.cast("double")
    return df.agg(
        F.avg(c.cast("double")).alias("coverage"), F.count_if(c).alias("answered"), F.avg(F.when(c, ok)).alias("accuracy_answered"),
        F.avg(F.when(~c, ok)).alias("accuracy_abstained"), F.avg(ok).alias("accuracy_all"),
    )


def mcnemar_cells(df: DataFrame, true: Column, a: Column, b: Column) -> DataFrame:
    """One row: both right, only a, only b, neither, odds ratio (with 0.5 added), accuracy difference."""
    ra, rb = true == a, true == b
    x = df.agg(F.count_if(ra & rb).alias("both"), F.count_if(ra & ~rb).alias("a_only"), F.count_if(~ra & rb).alias("b_only"), F.count_if(~ra & ~rb).alias("neither"))
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    return x.withColumns({"odds_ratio": (F.col("a_only") + 0.5) / (F.col("b_only") + 0.5), "accuracy_difference": (F.col("a_only") - F.col("b_only")) / n})
