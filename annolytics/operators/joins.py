"""Tables put together: author keys, merged labels, predictions beside references, diagnostic corpora and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annolytics.functions import privacy, text
from annolytics.operators import consensus as C, metrics as M

UNDEFINED = C.UNDEFINED
EVERY = "__todos__"


#: Values from which numbered() takes the bounds of its ranges, and the binary digits of the number of ranges, at most.
SAMPLE, DIGITS = 16_384, 10


def ranges(df: DataFrame, order: str) -> Column:
    """The number from 0 of a value's range, by bounds that are fixed here: it depends on the value only, nulls are in a range after all others."""
    values = df.select(F.col(order).alias("v")).where("v is not null")
    some = [v for (v,) in values.orderBy(F.xxhash64("v")).limit(SAMPLE).sort("v").collect()]
    digits = min(DIGITS, (len(some) + 1).bit_length() - 1)
    bounds = F.array(*[F.lit(some[i * len(some) >> digits]).cast(values.schema["v"].dataType) for i in range(1, 1 << digits)])
    steps = F.array(*[F.lit(1 << d) for d in reversed(range(digits))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(bounds, at + step) <= F.col(order), at + step).otherwise(at)) if digits else F.lit(0)
    return F.when(F.col(order).isNull(), F.lit(1 << DIGITS)).otherwise(found)


def numbered(df: DataFrame, order: str, name: str = "row_number") -> DataFrame:
    """df with its rows' number from 1 in the order of a column that doesn't repeat, nulls last.

    Rows are dealt by ranges of the column and sorted there; each range starts after the counts of those before it, so no task sees all
    rows. Partitions of repartitionByRange would not do: counts and rows are computed apart, and then get other bounds.
    """
    parts = df.withColumn("_p", ranges(df, order))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    parts = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(F.col(order).asc_nulls_last())))
    return parts.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_i", "_before")


def author_keys(df: DataFrame, *, key: bytes, author_column: str, order: str) -> DataFrame:
    """id (t0000001 on, in the order of the file's lines) and author_key, null without an author; the author himself does not come out."""
    author = F.col(author_column).cast("string")
    rows = numbered(df.select(F.col(order).alias("_order"), privacy.pseudonymize_value(author, key).alias("author_key")), "_order")
    return rows.select(text.row_id(F.col("row_number")).alias("id"), "author_key")


def merge_consensus(corpus: DataFrame, consensus: DataFrame, *, id_column: str = "id", suffix: str = "_huggingface") -> DataFrame:
    """corpus with the consensus columns of its ids, and those again under a suffix."""
    added = [c for c in consensus.columns if c != id_column]
    clean = corpus.drop(*added)
    return clean.join(consensus, id_column, "left").withColumns({c + suffix: F.col(c) for c in added})


def with_human_labels(consensus: DataFrame, human: DataFrame, *, id_column: str = "id", label_column: str = "sentiment_label") -> DataFrame:
    """consensus with manual_label, is_human_validated, and the manual label in place of the automatic one where there is one."""
    given = human.select(id_column, F.col(label_column).alias("manual_label"))
    out = consensus.join(given, id_column, "left")
    return out.withColumn("is_human_validated", F.col("manual_label").isNotNull()).withColumn(label_column, F.coalesce("manual_label", label_column))


def labeling_error_rate(consensus: DataFrame, human: DataFrame, *, id_column: str = "id", label_column: str = "sentiment_label") -> DataFrame:
    """One row: n, error_rate over ids in both."""
    j = consensus.select(id_column, F.col(label_column).alias("a")).join(human.select(id_column, F.col(label_column).alias("b")), id_column)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("error_rate"))


def agreement_with_gold(predicted: DataFrame, gold: DataFrame, *, id_column: str = "id", label_column: str = "sentiment_label", minimum_kappa: float = 0.6) -> DataFrame:
    """One row: n, agreement_rate, kappa, acceptable."""
    j = predicted.select(id_column, F.col(label_column).alias("label_a")).join(gold.select(id_column, F.col(label_column).alias("label_b")), id_column)
    cells = j.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    return C.kappa_of_cells(cells, ["_all"]).drop("_all").withColumn("acceptable", F.col("kappa") >= minimum_kappa)


def predictions_table(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """id, model, y_pred, y_true in long form: models join once by id, not one join a model; wide() turns it."""
    return predictions.select("id", "model", "y_pred").join(truth.select("id", "y_true"), "id")


def wide(table: DataFrame, models: list[str]) -> DataFrame:
    """id, y_true, pred_<model> for each model, null where one has no prediction; one aggregate, no join."""
    of = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"pred_{m}") for m in models]
    return table.groupBy("id", "y_true").agg(*of)


def long_predictions(frame: DataFrame, models: list[str], *, prefix: str = "pred_", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, model, y_pred and columns to keep, without nulls."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(prefix + m).cast("string").alias("y_pred")) for m in models])
    return frame.select("id", *keep, F.explode(items).alias("x")).select("id", *keep, "x.*").where("y_pred is not null")


def models_against_references(predictions: DataFrame, references: DataFrame, *, least: int = 2) -> DataFrame:
    """reference, model, n, accuracy, f1_macro, mcc, kappa of long predictions (id, model, y_pred) on references (reference, id, label).

    One join and one cell aggregate for all models and references; of fewer than `least` rows nothing is said.
    """
    j = predictions.withColumn("id", F.col("id").cast("string")).join(references, "id")
    cells = M.confusion(j, ["reference", "model"], true="label")
    cells = cells.persist()  # at most references x models x classes squared rows, read by two aggregates
    by = ["reference", "model"]
    scores = M.classification_metrics(cells, by).where(F.col("n") >= least)
    kappa = C.kappa_of_cells(cells.withColumnsRenamed({"y_true": "label_a", "y_pred": "label_b"}), by)
    return scores.join(kappa.drop("n", "agreement_rate"), by).select(*by, "n", "accuracy", "f1_macro", "mcc", "kappa")


def label_noise(training: DataFrame, references: DataFrame, *, label_column: str = "sentiment_label") -> DataFrame:
    """The training labels themselves scored as a model against each reference."""
    return models_against_references(training.select("id", F.lit("rotulador").alias("model"), F.col(label_column).alias("y_pred")), references).drop("model")


def labeled_corpus(corpus: DataFrame, labels: DataFrame, *, id_column: str = "id") -> DataFrame:
    """corpus with its labels; rows without one, or with the undefined one, are left out."""
    known = labels.where(F.col("sentiment_label") != UNDEFINED)
    return merge_consensus(corpus, known, id_column=id_column).where(F.col("sentiment_label").isNotNull())


def rater_table(bases: dict[str, DataFrame], classes: tuple[str, ...] = C.CLASSES) -> DataFrame:
    """id and label_<name> of ids that all bases label with a class."""
    sides = [b.where(F.col("sentiment_label").isin(*classes)).select("id", F.col("sentiment_label").alias(f"label_{n}")) for n, b in bases.items()]
    return reduce(lambda a, b: a.join(b, "id"), sides)


def restricted_to_sample(base: DataFrame, sample: DataFrame, *, id_column: str = "id") -> DataFrame:
    """The rows of base whose ids are in sample; a sample id that base lacks is an error."""
    ids = sample.select(id_column).distinct()
    missing = [r[0] for r in ids.join(base, id_column, "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"the base lacks ids of the sample, such as {missing}")
    return base.join(ids, id_column, "left_semi")


def diagnostic_corpus(frame: DataFrame, models: dict[str, str], *, text_column: str = "text_normalized", agreement: Column | None = None, gold_column: str | None = None) -> DataFrame:
    """id, text_normalized, agreement_score, lab_<model>..., gold_label of a frame: the diagnostic contract.

    agreement: the smaller of two confidences where not given.
    """
    score = F.least("confidence_a", "confidence_b") if agreement is None else agreement
    gold = F.col(gold_column) if gold_column else F.lit(None)
    labels = [F.col(c).cast("string").alias(f"lab_{m}") for m, c in models.items()]
    return frame.select(F.col("id").cast("string").alias("id"), F.col(text_column).alias("text_normalized"), score.cast("double").alias("agreement_score"), *labels, gold.cast("string").alias("gold_label"))


def partition_slice(target: DataFrame, discovery: DataFrame, partition: str) -> DataFrame:
    """target of the ids of one partition (id, partition)."""
    return target.join(discovery.where(F.col("partition") == partition).select("id"), "id", "left_semi")


def hypothesis_evidence(activations: DataFrame, texts: DataFrame, *, k: int) -> DataFrame:
    """hypothesis, rank, id, activation and the text's columns: the k rows that activate each hypothesis most, of those above 0."""
    rank = F.row_number().over(W.partitionBy("hypothesis").orderBy(F.col("activation").desc(), "id"))
    top = activations.where("activation > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(texts, "id", "left")


def pivoted_features(long: DataFrame, terms: list[str], *, id_column: str = "id", term_column: str = "term", weight_column: str = "tfidf_weight") -> DataFrame:
    """A row an id with a column a term, 0 where it is missing: for named terms, so the width is the caller's choice."""
    of = [F.coalesce(F.max(F.when(F.col(term_column) == t, F.col(weight_column))), F.lit(0.0)).alias(t) for t in terms]
    return long.groupBy(id_column).agg(*of)


def feature_groups(df: DataFrame, groups: dict[str, list[str]], enabled: list[str], *, id_column: str = "id") -> DataFrame:
    """The id and the columns of the enabled groups."""
    unknown = [g for g in enabled if g not in groups]
    if unknown:
        raise ValueError(f"unknown groups {unknown}")
    return df.select(id_column, *dict.fromkeys(c for g in enabled for c in groups[g]))


def standard_predictions(df: DataFrame, *, label: str = "label", confidence: str = "confidence", classes: tuple[str, ...] = C.CLASSES) -> DataFrame:
    """df with sentiment_label (trimmed, lower-cased; null unless a class) and confidence_score held to 0..1."""
    clean = F.lower(F.trim(label))
    return df.withColumns({"sentiment_label": F.when(clean.isin(*classes), clean), "confidence_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence).cast("double")))})


def run_metrics(metrics: DataFrame, *, run_id: str, git_sha: str, dataset_hash: str) -> DataFrame:
    """run_id, model_name, metric_name, metric_value, ... in long form of a table (model, metrics...)."""
    names = [c for c, t in metrics.dtypes if c not in ("model", "n") and t == "double"]
    items = F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(c).alias("metric_value")) for c in names])
    out = metrics.select(F.lit(run_id).alias("run_id"), F.col("model").alias("model_name"), F.explode(items).alias("x"), F.lit(git_sha).alias("git_sha"), F.lit(dataset_hash).alias("dataset_hash"))
    return out.select("run_id", "model_name", "x.*", "git_sha", "dataset_hash")


def results_table(df: DataFrame, metric: str, low: str, high: str) -> DataFrame:
    """model and the metric as `value [low, high]` with four decimals."""
    return df.select("model", F.format_string("%.4f [%.4f, %.4f]", metric, low, high).alias(metric))


def kappa_matrix(pairs: DataFrame, raters: list[str]) -> DataFrame:
    """rater and a column for each rater: kappa of the pair, 1 with itself."""
    both = pairs.select("rater_a", "rater_b", "kappa").union(pairs.select("rater_b", "rater_a", "kappa"))
    of = [F.when(F.col("rater_a") == r, 1.0).otherwise(F.max(F.when(F.col("rater_b") == r, F.col("kappa")))).alias(r) for r in raters]
    return both.groupBy("rater_a").agg(*of).withColumnRenamed("rater_a", "rater")


def models_by_concept(frame: DataFrame, models: list[str], *, concept: str = "concept", true: str = "y_true") -> DataFrame:
    """concept (EVERY for all rows), model and its metrics: one aggregate for all."""
    both = long_predictions(frame, models, keep=(concept, true)).withColumn("concept", F.explode(F.array(F.lit(EVERY), F.col(concept))))
    by = ["concept", "model"]
    return M.classification_metrics(M.confusion(both, by, true=true), by)
