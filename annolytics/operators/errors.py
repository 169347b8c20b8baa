"""Error attribution, slices, gold references and diagnostic targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Patterns of the slices and names of error sources and categories.
NEGATION = r"(?i)(?<![\p{L}\p{N}_])(?:n[aã]o|nunca|jamais|nem|nada|ningu[eé]m|nenhum[a]?|nao|sem|tampouco|n)(?![\p{L}\p{N}_])"
HASHTAG = r"#[\p{L}\p{N}_]+"
SOURCES = ("acerto", "erro_do_modelo", "erro_do_rotulo_de_treino", "modelo_reproduz_rotulo_errado", "ambos_errados_e_discordam")
LENGTHS = ("1_curto", "2_medio", "3_longo")


def error_source(label: Column, predicted: Column, reference: Column) -> Column:
    """Who is wrong, given the training label, the prediction and the reference."""
    right, labelled = predicted == reference, label == reference
    return F.when(right & labelled, SOURCES[0]).when(right, SOURCES[2]).when(labelled, SOURCES[1]).when(predicted == label, SOURCES[3]).otherwise(SOURCES[4])


def error_sources(df: DataFrame, by: list[str], label: str, predicted: str, reference: str) -> DataFrame:
    """by, source, n, share."""
    counts = df.groupBy(*by, error_source(F.col(label), F.col(predicted), F.col(reference)).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def length_edges(df: DataFrame, words: Column) -> tuple[float, float]:
    low, high = df.agg(F.percentile(words, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    return low, high


def length_slice(words: Column, edges: tuple[float, float]) -> Column:
    return F.when(words <= edges[0], LENGTHS[0]).when(words <= edges[1], LENGTHS[1]).otherwise(LENGTHS[2])


def slice_flags(t: Column) -> dict[str, Column]:
    from annolytics.functions.text import EMOJI

    flag = lambda pattern, name: F.when(t.rlike(pattern), f"com_{name}").otherwise(f"sem_{name}")
    return {name: flag(pattern, name) for name, pattern in (("emoji", EMOJI), ("hashtag", HASHTAG), ("negacao", NEGATION))}


def top_errors(df: DataFrame, *, category: str, confidence: str, top_n: int = 50, id_column: str = "id") -> DataFrame:
    """The surest errors (y_true <> y_pred) of each category, ranked; a null confidence comes last."""
    order = W.partitionBy(category).orderBy(F.coalesce(confidence, F.lit(-1.0)).desc(), id_column)
    return df.where(F.col("y_true") != F.col("y_pred")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def gold_references(golds: dict[str, DataFrame], classes: tuple[str, ...]) -> DataFrame:
    """reference, id, label: each gold set's valid rows, and with two or more the ids on which all agree."""
    parts = [g.where(F.col("sentiment_label").isin(*classes)).select(F.lit(name).alias("reference"), F.col("id").cast("string").alias("id"), F.col("sentiment_label").alias("label")) for name, g in golds.items()]
    every = reduce(DataFrame.unionByName, parts)
    if len(golds) < 2:
        return every
    same = every.groupBy("id").agg(F.count_distinct("reference").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    same = same.where((F.col("n") == len(golds)) & (F.col("lo") == F.col("hi"))).select(F.lit("consenso_gold").alias("reference"), "id", F.col("lo").alias("label"))
    return every.unionByName(same)


def disagreement_target(df: DataFrame, columns: list[str]) -> DataFrame:
    """id, target: 1 where the models' labels differ; rows with a null label are left out."""
    kept = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return kept.select("id", (F.size(F.array_distinct(F.array(*columns))) > 1).cast("int").alias("target"))


def uncertainty_target(df: DataFrame) -> DataFrame:
    return df.select("id", (1 - F.col("agreement_score")).alias("target"))


def gold_error_target(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col("gold_label").isNotNull()).select("id", (F.col(column) != F.col("gold_label")).cast("int").alias("target"))


def agreement_of_labels(columns: list[str]) -> Column:
    """Largest share of equal labels among those not null; 0 without any."""
    labels = F.filter(F.array(*columns), lambda x: x.isNotNull())
    best = F.array_max(F.transform(F.array_distinct(labels), lambda x: F.size(F.filter(labels, lambda y: y == x))))
    return F.when(F.size(labels) > 0, best / F.size(labels)).otherwise(0.0)


def flag_anomalies(df: DataFrame, error: str, percentile: float) -> DataFrame:
    edge = df.agg(F.percentile(error, F.lit(percentile / 100)).alias("_edge"))
    return df.crossJoin(F.broadcast(edge)).withColumn("is_anomaly", F.col(error) > F.col("_edge")).drop("_edge")  # one row


def risk_coverage(df: DataFrame, confidence: str, correct: Column, coverages: tuple[float, ...], *, id_column: str = "id") -> DataFrame:
    """coverage, n_kept, threshold, accuracy: the surest max(1, ceil(c * n)) rows.

    Rows are summed by distinct confidence; only those at a threshold's own confidence are counted in part, by their mean.
    """
    g = df.select(F.col(confidence).alias("c"), correct.cast("int").alias("y")).groupBy("c").agg(F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.col("c").desc()).rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumns({"upto": F.sum("n").over(w), "hits": F.sum("hit").over(w), "total": F.sum("n").over(W.partitionBy())})
    x = g.withColumn("coverage", F.explode(F.array(*[F.lit(float(c)) for c in coverages])))
    x = x.withColumn("kept", F.greatest(F.lit(1), F.ceil(F.round(F.col("coverage") * F.col("total"), 6))))
    at = x.where((F.col("upto") >= F.col("kept")) & (F.col("upto") - F.col("n") < F.col("kept")))
    part = (F.col("kept") - F.col("upto") + F.col("n")) * F.col("hit") / F.col("n")
    return at.select("coverage", F.col("kept").cast("long").alias("n_kept"), F.col("c").alias("threshold"), ((F.col("hits") - F.col("hit") + part) / F.col("kept")).alias("accuracy"))
