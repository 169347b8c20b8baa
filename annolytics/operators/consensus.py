"""Votes, consensus levels and label-source comparison."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CLASSES = ("negativo", "neutro", "positivo")
UNDEFINED = "indefinido"
LEVELS = ("unanimidade", "maioria", "pluralidade", "empate")
NO_CONSENSUS = "sem_consenso"
BAND_EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)


def class_id(label: Column) -> Column:
    return reduce(lambda c, i: c.when(label == CLASSES[i], i), range(1, len(CLASSES)), F.when(label == CLASSES[0], 0))


def weighted_label_scores(results: DataFrame) -> DataFrame:
    """id, sentiment_label, score: confidence times weight summed over labelers."""
    return results.groupBy("id", "sentiment_label").agg(F.sum(F.col("confidence_score") * F.col("weight")).alias("score"))


def weighted_majority_vote(results: DataFrame) -> DataFrame:
    """id, sentiment_label, agreement_ratio, discordance_score: the label with the highest score (ties to the first in order)."""
    scores = weighted_label_scores(results)
    best = F.max_by("sentiment_label", F.struct(F.round("score", 9).alias("s"), F.col("rank")))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("sentiment_label").desc()))
    total = F.sum("score")
    out = scores.withColumn("rank", rank).groupBy("id").agg(best.alias("sentiment_label"), F.when(total > 0, F.max("score") / total).otherwise(0.0).alias("agreement_ratio"))
    return out.withColumn("discordance_score", 1 - F.col("agreement_ratio"))


def flag_low_confidence(df: DataFrame, *, low_confidence_threshold: float = 0.5, discordance_threshold: float = 0.3) -> DataFrame:
    return df.withColumn("is_low_confidence", (F.col("agreement_ratio") < low_confidence_threshold) | (F.col("discordance_score") > discordance_threshold))


def consensus_frame(frame: DataFrame, raters: list[str]) -> DataFrame:
    """frame (id, label_<rater>...) without rows undefined for a rater, with votes, level, label and polarity conflict."""
    labels = [F.col(f"label_{r}") for r in raters]
    frame = frame.where(reduce(lambda a, b: a & b, [c.isNotNull() & (c != UNDEFINED) for c in labels]))
    votes = {c: sum((F.when(x == c, 1).otherwise(0) for x in labels), F.lit(0)).cast("long") for c in CLASSES}
    frame = frame.withColumns({f"votes_{c}": v for c, v in votes.items()})
    counts = [F.col(f"votes_{c}") for c in CLASSES]
    frame = frame.withColumn("top_votes", F.greatest(*counts))
    at_top = sum((F.when(c == F.col("top_votes"), 1).otherwise(0) for c in counts), F.lit(0))
    level = (
        F.when(F.col("top_votes") == len(raters), LEVELS[0]).when(at_top > 1, LEVELS[3]).when(F.col("top_votes") * 2 > len(raters), LEVELS[1]).otherwise(LEVELS[2])
    )
    frame = frame.withColumn("consensus_level", level)
    label = reduce(lambda w, c: w.when(F.col(f"votes_{c}") == F.col("top_votes"), c), CLASSES, F.when(F.col("consensus_level") == LEVELS[3], NO_CONSENSUS))
    return frame.withColumns({"consensus_label": label, "polarity_conflict": (F.col("votes_negativo") > 0) & (F.col("votes_positivo") > 0)})


def consensus_levels(consensus: DataFrame) -> DataFrame:
    """consensus_level, n, share, for all levels; an empty input has zeros."""
    levels = consensus.sparkSession.createDataFrame([(x,) for x in LEVELS], "consensus_level string")
    counts = consensus.groupBy("consensus_level").agg(F.count(F.lit(1)).alias("n"))
    out = levels.join(F.broadcast(counts), "consensus_level", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))  # four rows
    total = F.sum("n").over(W.partitionBy())
    return out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def consensus_by_class(consensus: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("consensus_level") == x).alias(x) for x in LEVELS]
    out = consensus.groupBy(F.col("consensus_label").alias("label")).agg(*counts, F.count(F.lit(1)).alias("n"))
    return out.withColumn("unanimity_rate", F.col(LEVELS[0]) / F.col("n"))


def disputed(consensus: DataFrame, *, top_n: int = 50) -> DataFrame:
    order = (F.col("polarity_conflict").desc(), F.col("top_votes").asc(), F.col("id").asc())
    return consensus.where(F.col("consensus_level") != LEVELS[0]).orderBy(*order).limit(top_n)


def comparison_frame(frame: DataFrame, first: str, second: str) -> DataFrame:
    """id, label_a, label_b, confidence_a, confidence_b with agree, label_distance, min_confidence, word_count kept if there."""
    a, b = F.col(f"label_{first}"), F.col(f"label_{second}")
    kept = frame.where(a.isin(*CLASSES) & b.isin(*CLASSES))
    out = kept.select("id", a.alias("label_a"), b.alias("label_b"), F.col(f"confidence_{first}").alias("confidence_a"), F.col(f"confidence_{second}").alias("confidence_b"), "word_count")
    return out.withColumns({
        "agree": F.col("label_a") == F.col("label_b"), "label_distance": F.abs(class_id(F.col("label_a")) - class_id(F.col("label_b"))),
        "min_confidence": F.least("confidence_a", "confidence_b"),
    })


def class_distribution(frame: DataFrame) -> DataFrame:
    """model, label, n, proportion: zero where a model never gives a label."""
    long = frame.select(F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("label_a").alias("label")), F.struct(F.lit("b").alias("model"), F.col("label_b").alias("label")))).alias("x")).select("x.*")
    counts = long.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))
    grid = frame.sparkSession.createDataFrame([(m, c) for m in "ab" for c in CLASSES], "model string, label string")
    out = grid.join(F.broadcast(counts), ["model", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))  # six rows
    return out.withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy("model")))


def agreement_matrix(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label_a").agg(*[F.count_if(F.col("label_b") == c).alias(c) for c in CLASSES])


def transitions(frame: DataFrame) -> DataFrame:
    out = frame.where(~F.col("agree")).groupBy("label_a", "label_b")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_a").alias("mean_confidence_a"), F.avg("confidence_b").alias("mean_confidence_b"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def transition_examples(frame: DataFrame, *, per_transition: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("label_a", "label_b").orderBy(F.col("min_confidence").desc(), "id"))
    return frame.where(~F.col("agree")).withColumn("rank", rank).where(F.col("rank") <= per_transition)


def top_divergences(frame: DataFrame, *, top_n: int = 50) -> DataFrame:
    return frame.where(~F.col("agree")).orderBy(F.col("label_distance").desc(), F.col("min_confidence").desc(), "id").limit(top_n)


def confidence_conflicts(frame: DataFrame, *, high: float = 0.8, low: float = 0.5) -> DataFrame:
    a, b = F.col("confidence_a"), F.col("confidence_b")
    out = frame.where(((a >= high) & (b <= low)) | ((b >= high) & (a <= low)))
    return out.withColumns({"gap": F.abs(a - b), "more_confident": F.when(a > b, "a").otherwise("b")})


def ambiguous_cases(frame: DataFrame, *, low: float = 0.5) -> DataFrame:
    """case_type, n, proportion (of all rows)."""
    a, b = F.col("confidence_a") < low, F.col("confidence_b") < low
    kind = F.when(a & b, "ambos_incertos").when(a, "primario_incerto").when(b, "referencia_incerta").when(~F.col("agree"), "divergencia_confiante")
    total = F.sum("n").over(W.partitionBy())
    out = frame.groupBy(kind.alias("case_type")).agg(F.count(F.lit(1)).alias("n")).withColumn("proportion", F.col("n") / total)
    return out.where(F.col("case_type").isNotNull())


def band(c: Column) -> Column:
    """Left-closed confidence bands; the last one includes 1."""
    out = None
    for lo, hi in zip(BAND_EDGES, BAND_EDGES[1:], strict=False):
        hit = (c >= lo) & ((c < hi) if hi < 1 else (c <= hi))
        out = F.when(hit, f"{lo:.2f}–{hi:.2f}") if out is None else out.when(hit, f"{lo:.2f}–{hi:.2f}")
    return out


def agreement_by_band(frame: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(m).alias("model"), band(F.col(f"confidence_{m}")).alias("band")) for m in "ab"])
    return frame.select("agree", F.explode(sides).alias("x")).groupBy("x.model", "x.band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement_rate"))


def agreement_by_band_pair(frame: DataFrame) -> DataFrame:
    return frame.groupBy(band(F.col("confidence_a")).alias("band_a"), band(F.col("confidence_b")).alias("band_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement_rate")
    )


def confidence_summary(frame: DataFrame) -> DataFrame:
    """Per model: mean, sample deviation, median, and means where both agree and where not."""
    sides = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"confidence_{m}").alias("c")) for m in "ab"])
    x = frame.select("agree", F.explode(sides).alias("x")).select("agree", "x.*")
    return x.groupBy("model").agg(
        F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.percentile("c", F.lit(0.5)).alias("median"),
        F.avg(F.when(F.col("agree"), F.col("c"))).alias("mean_agree"), F.avg(F.when(~F.col("agree"), F.col("c"))).alias("mean_diverge"),
    )


def rater_cells(consensus: DataFrame, raters: list[str]) -> DataFrame:
    """rater_a, rater_b, label_a, label_b, n for every pair of raters: K² cells a pair, from one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), F.col(f"label_{a}").alias("label_a"), F.col(f"label_{b}").alias("label_b")) for a, b in combinations(raters, 2)])
    return consensus.select(F.explode(pairs).alias("x")).select("x.*").groupBy("rater_a", "rater_b", "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def kappa_of_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, n, agreement_rate, kappa (1 where chance agreement is total) from cells (by, label_a, label_b, n)."""
    n = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    a = cells.groupBy(*by, F.col("label_a").alias("label")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(*by, F.col("label_b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    out = n.join(chance, by, "left").withColumns({"po": F.col("same") / F.col("n"), "pe": F.coalesce("chance", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))})
    return out.select(*by, "n", F.col("po").alias("agreement_rate"), F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss_and_alpha(consensus: DataFrame, raters: int) -> DataFrame:
    """One row: n, fleiss_kappa, krippendorff_alpha (nominal, complete data), unanimity_rate, from vote counts."""
    v = [F.col(f"votes_{c}").cast("double") for c in CLASSES]
    pairs = sum((x * (x - 1) for x in v), F.lit(0.0))
    s = consensus.agg(F.count(F.lit(1)).alias("n"), F.avg(pairs / (raters * (raters - 1))).alias("po"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(v)], F.avg((F.col("top_votes") == raters).cast("double")).alias("unanimity_rate"))
    total = F.col("n") * raters
    pe = sum(((F.col(f"s{i}") / total) * (F.col(f"s{i}") / total) for i in range(len(v))), F.lit(0.0))
    expected = sum((F.col(f"s{i}") * (F.col(f"s{i}") - 1) for i in range(len(v))), F.lit(0.0)) / (total * (total - 1))
    return s.select("n", ((F.col("po") - pe) / (1 - pe)).alias("fleiss_kappa"), (1 - (1 - F.col("po")) / (1 - expected)).alias("krippendorff_alpha"), "unanimity_rate")
