"""Rows picked out: slices below a threshold, review tables, gold splits, strata and partitions. Draws are by seeded hash, as in sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annolytics.operators import sampling as S

LEVELS = ((0.3, "baixa"), (0.5, "media"))
NO_LABEL = "sem_rotulo"


def underperforming(slices: DataFrame, *, metric: str = "f1_macro", threshold: float = 0.65) -> DataFrame:
    """Slices whose metric is below a threshold, the worst first."""
    return slices.where(F.col(metric) < threshold).orderBy(metric)


def human_review(df: DataFrame, *, confidence: str, threshold: float) -> DataFrame:
    """id and confidence of rows below a threshold, the least sure first: without texts."""
    return df.where(F.col(confidence) < threshold).select("id", confidence).orderBy(confidence, "id")


def of_quality(df: DataFrame, *, min_coverage: float = 0.8, min_specificity: float = 0.6) -> DataFrame:
    """Interpretations that cover enough and are specific enough; those without the two figures (plain texts) always stay."""
    plain = F.col("coverage").isNull() & F.col("specificity").isNull()
    return df.where(plain | ((F.col("coverage") >= min_coverage) & (F.col("specificity") >= min_specificity)))


def prepared_corpus(df: DataFrame, *, text_column: str, confidence_column: str, threshold: float, id_column: str = "id") -> DataFrame:
    """One row a text that isn't blank (the first by id), with low_confidence."""
    kept = df.where(F.trim(text_column) != "")
    rest = [c for c in df.columns if c != text_column]
    first = kept.groupBy(text_column).agg(F.min_by(F.struct(*rest), id_column).alias("r")).select("r.*", text_column)
    return first.select(*df.columns).withColumn("low_confidence", F.col(confidence_column) < threshold)


def top_hypotheses(df: DataFrame, k: int, *, score: str | None = None) -> DataFrame:
    """The k best of distinct hypotheses: by the score, else by the size of their separation; nulls last."""
    order = F.col(score) if score else F.abs("separation")
    once = df.where("hypothesis is not null").groupBy("hypothesis").agg(F.max(order).alias("_score"), F.max_by(F.struct("*"), F.coalesce(order, F.lit(float("-inf")))).alias("r"))
    return once.orderBy(F.col("_score").desc_nulls_last(), "hypothesis").limit(k).select("r.*")


def best_by_category(df: DataFrame, *, metric: str = "f1_macro", category: str = "category") -> DataFrame:
    """The model with the highest metric of each category, ties to the first by name."""
    rank = F.row_number().over(W.partitionBy(category).orderBy(F.col(metric).desc_nulls_last(), "model"))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def stratified_head(df: DataFrame, n: int, *, label_column: str = "sentiment_label", id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """max(1, round(h * n / rows)) rows of each label."""
    return S.stratified_subset(df, stratify_column=label_column, sample_size=n, id_column=id_column, seed=seed)


def discovery_and_eval(df: DataFrame, *, eval_fraction: float, label_column: str = "sentiment_label", id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """df with part: of each label round(h * fraction) rows to eval, the rest to discovery."""
    ranked = S.ranked(df, [label_column], id_column, seed)
    return ranked.withColumn("part", F.when(F.col("_rank") <= F.bround(F.col("_size") * eval_fraction), "eval").otherwise("discovery")).drop("_rank", "_size")


def confidence_level(c: Column) -> Column:
    return F.when(c < LEVELS[0][0], LEVELS[0][1]).when(c < LEVELS[1][0], LEVELS[1][1]).otherwise("moderada")


def for_human_validation(df: DataFrame, *, confidence: str = "agreement_ratio", flag: str = "is_low_confidence", sample_size: int = 500, by_level: bool = True, id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """A sample of the flagged rows, in proportion to their levels of confidence."""
    flagged = df.where(F.col(flag)).withColumn("confidence_level", confidence_level(F.col(confidence)))
    if not by_level:
        return S.random_subset(flagged, sample_size=sample_size, id_column=id_column, seed=seed)
    return S.stratified_subset(flagged, stratify_column="confidence_level", sample_size=sample_size, id_column=id_column, seed=seed)


def terciles(df: DataFrame, confidence: str) -> DataFrame:
    """df with stratum baixa, media or alta, cut at the nearest-rank terciles."""
    edges = df.agg(F.percentile_approx(confidence, F.array(F.lit(1 / 3), F.lit(2 / 3)), 1_000_000).alias("_e"))
    out = df.crossJoin(F.broadcast(edges))  # one row
    c = F.col(confidence)
    return out.withColumn("stratum", F.when(c <= F.col("_e")[0], "baixa").when(c <= F.col("_e")[1], "media").otherwise("alta")).drop("_e")


def equal_allocation(df: DataFrame, *, sample_size: int, stratum: str = "stratum", id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """The same number from each stratum (one more from the first ones for what is left over), with weight: rows it stands for."""
    ranked = S.ranked(df, [stratum], id_column, seed)
    strata = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    k = W.orderBy(stratum)
    strata = strata.withColumn("_k", F.row_number().over(k)).withColumn("_s", F.count(F.lit(1)).over(W.partitionBy()))  # a row a stratum
    share = F.floor(F.lit(sample_size) / F.col("_s")) + F.when(F.col("_k") <= F.lit(sample_size) % F.col("_s"), 1).otherwise(0)
    strata = strata.withColumn("_take", F.least(share, F.col("_c"))).select(stratum, "_take")
    out = S.null_safe_join(ranked, F.broadcast(strata), [stratum]).where(F.col("_rank") <= F.col("_take"))
    return out.withColumn("weight", F.col("_size") / F.col("_take")).drop("_rank", "_size", "_take")


def partitions(df: DataFrame, labels: list[str], *, holdout_size: float, validation_size: float, id_column: str = "id", text_column: str = "text_normalized", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """One row a text, split within its first label (NO_LABEL without one) into holdout, validation and train, under partition."""
    first = S.first_occurrences(df, key=text_column, ordinal=id_column).withColumn("_stratum", F.coalesce(*[F.col(c) for c in labels], F.lit(NO_LABEL)))
    split = S.stratified_split(first, label_column="_stratum", id_column=id_column, test_size=holdout_size, validation_size=validation_size, seed=seed, split_column="partition")
    name = F.when(F.col("partition") == "teste", "holdout").when(F.col("partition") == "validacao", "validation").otherwise("train")
    return split.withColumn("partition", name).drop("_stratum")


def few_shot(df: DataFrame, *, per_class: int = 2, label_column: str = "sentiment_label", id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """`per_class` rows of each label."""
    return S.ranked(df, [label_column], id_column, seed).where(F.col("_rank") <= per_class).drop("_rank", "_size")


def folds(df: DataFrame, k: int, *, label_column: str = "sentiment_label", id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """df with fold, from 0: each label's rows dealt in turn."""
    return S.ranked(df, [label_column], id_column, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def by_concept(texts: DataFrame, annotations: DataFrame, *, per_concept: int, seed: int = S.DEFAULT_SEED) -> DataFrame:
    """id, concept: up to per_concept texts of each concept, an id with several in its rarest."""
    counts = annotations.where("present").groupBy("concept").agg(F.count(F.lit(1)).alias("_c"))
    held = annotations.where("present").join(F.broadcast(counts), "concept")  # a row a concept
    own = held.groupBy("id").agg(F.min_by("concept", F.struct("_c", "concept")).alias("concept")).join(texts.select("id"), "id", "left_semi")
    return S.ranked(own, ["concept"], "id", seed).where(F.col("_rank") <= per_concept).select("id", "concept")


def top_and_zero(df: DataFrame, *, n: int, id_column: str = "id", seed: int = S.DEFAULT_SEED) -> DataFrame:
    """neuron, id, kind: the n / 2 highest activations of each neuron and n / 2 of its zeros, by seeded hash."""
    positive = df.where("activation > 0").withColumn("_r", F.row_number().over(W.partitionBy("neuron").orderBy(F.col("activation").desc(), id_column))).withColumn("kind", F.lit("top"))
    zero = df.where("activation <= 0").withColumn("_r", F.row_number().over(W.partitionBy("neuron").orderBy(S.draw(id_column, seed), id_column))).withColumn("kind", F.lit("zero"))
    return positive.unionByName(zero).where(F.col("_r") <= n // 2).select("neuron", id_column, "kind")


def mean_confidence(scores: list[Column]) -> Column:
    return F.avg(F.greatest(*scores))


def one_vs_rest(true: Column, labels: tuple[str, ...]) -> Column:
    return F.array(*[(true == x).cast("int") for x in labels])


def confidence_threshold(df: DataFrame, confidence: str, coverage: float) -> DataFrame:
    """One row, threshold: the smallest confidence that is at least the (1 - coverage) quantile, found in counts by value."""
    g = df.groupBy(F.col(confidence).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    upto = F.sum("n").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, 0))
    at = F.ceil(F.round((F.col("total") - 1) * (1 - coverage), 9)) + 1
    return g.withColumn("upto", upto).crossJoin(F.broadcast(total)).where(F.col("upto") >= at).agg(F.min("c").alias("threshold"))  # one row


def dataset_summary(df: DataFrame, *, label_column: str, low: str) -> DataFrame:
    """label, n, low_confidence_rate."""
    return df.groupBy(F.col(label_column).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(low).cast("double")), 4).alias("low_confidence_rate"))


def datasheet(df: DataFrame, *, split: str = "split", words: str = "word_count") -> DataFrame:
    """split, n, mean_words, median_words, p95_words."""
    q = F.percentile(words, F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(words).alias("mean_words"), q[0].alias("median_words"), q[1].alias("p95_words"))


def rater_agreement(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row over ids that all models label: n, disagreement_rate, mean_agreement (the share of the most frequent label)."""
    every = F.array(*labels)
    kept = df.where(F.forall(every, lambda x: x.isNotNull()))
    top = F.array_max(F.transform(every, lambda x: F.size(F.filter(every, lambda y: y == x))))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.avg((top < len(labels)).cast("double")).alias("disagreement_rate"), F.avg(top / len(labels)).alias("mean_agreement"))


def error_patterns(df: DataFrame) -> DataFrame:
    """category, model, suggested, n, share (within the category)."""
    c = df.groupBy("category", "model", "suggested").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("category")))


def error_by_group(df: DataFrame, groups: list[str]) -> DataFrame:
    """grouping, group, n, mean_error, anomaly_rate for each column: one pass."""
    items = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("group")) for g in groups])
    x = df.select("error", "is_anomaly", F.explode(items).alias("x")).select("error", "is_anomaly", "x.*")
    return x.groupBy("grouping", "group").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"))
