"""Stages: composite jobs over tables in a layered folder, each a function of a session and a root path."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolytics import contracts
from annolytics.functions import text
from annolytics.operators import consensus as C, features as X, metrics as M, models, sampling as S, stats
from annolytics.sources import files

STAGES: dict[str, Callable] = {}


class StageError(RuntimeError):
    pass


def stage(name: str):
    def add(f):
        STAGES[name] = f
        return f

    return add


def run_stage(name: str, spark: SparkSession, root: str, **options):
    if name not in STAGES:
        raise StageError(f"no stage {name!r}; there are {', '.join(STAGES)}")
    try:
        return STAGES[name](spark, root, **options)
    except Exception as e:
        raise StageError(f"stage {name}: {e}") from e


def run_workflow(stages: list[str], spark: SparkSession, root: str, options: dict[str, dict] | None = None) -> dict[str, object]:
    return {name: run_stage(name, spark, root, **(options or {}).get(name, {})) for name in stages}


def preprocess(df: DataFrame, *, text_column: str = "text", exclude_retweets: bool = True, required_language: str | None = "pt", portuguese: bool = True, drop_duplicates: bool = True, ordinal: str = "id") -> DataFrame:
    """Raw rows filtered by metadata, normalised, filtered by content, and without later copies of a normalised text.

    Metadata filters stand on plain columns, so they reach the scan; the window that drops copies comes last.
    """
    if exclude_retweets and "is_retweet" in df.columns:
        df = df.where(~F.col("is_retweet"))
    if required_language and "language" in df.columns:
        df = df.where(F.col("language") == required_language)
    df = df.withColumn("text_normalized", text.normalize_tweet_text(F.col(text_column)))
    t = F.col("text_normalized")
    df = df.where(text.is_minimum_length_content(t))
    df = df.where(text.is_probable_portuguese_text(t)) if portuguese else df
    df = df.where(~text.is_spam_like(t))
    return S.first_occurrences(df, key="text_normalized", ordinal=ordinal) if drop_duplicates else df


@stage("preprocessing")
def preprocessing(spark: SparkSession, root: str, **options) -> str:
    out = f"{root}/silver/tweets_normalizados.parquet"
    files.write_dataset(preprocess(files.load_raw_batch(spark, f"{root}/bronze"), **options), out)
    return out


@stage("labeling")
def labeling(spark: SparkSession, root: str, *, source: str, classify: Callable, text_column: str = "text_normalized") -> str:
    """Label what a source's table doesn't hold yet; rows whose batch failed stay for the next run."""
    out = f"{root}/silver/rotulos_{source}.parquet"
    corpus = spark.read.parquet(f"{root}/silver/tweets_normalizados.parquet").select("id", F.col(text_column).alias("text"))
    try:
        done = spark.read.parquet(out).select("id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        corpus = corpus.join(done, "id", "left_anti")
    found = models.classify_batches(corpus, classify, tagger=source).where("sentiment_label is not null").drop("error")
    found.write.mode("append").parquet(out)
    return out


@stage("label_consensus")
def label_consensus(spark: SparkSession, root: str, *, sources: list[str]) -> dict[str, DataFrame]:
    """Consensus tables over sources that label the same ids."""
    if len(sources) < 2:
        raise ValueError("at least two sources")
    frames = [spark.read.parquet(f"{root}/silver/rotulos_{s}.parquet").select("id", F.col("sentiment_label").alias(f"label_{s}")) for s in sources]
    joined = frames[0]
    for f in frames[1:]:
        joined = joined.join(f, "id", "full_outer")
    missing = joined.where(" or ".join(f"label_{s} is null" for s in sources)).select("id").limit(5).collect()
    if missing:
        raise ValueError(f"sources differ in their ids, such as {[r.id for r in missing]}")
    frame = C.consensus_frame(joined, sources)
    return {
        "levels": C.consensus_levels(frame), "by_class": C.consensus_by_class(frame), "disputed": C.disputed(frame),
        "pairwise": C.kappa_of_cells(C.rater_cells(frame, sources), ["rater_a", "rater_b"]), "agreement": C.fleiss_and_alpha(frame, len(sources)),
    }


def compare(frame: DataFrame) -> dict[str, DataFrame]:
    """All tables of a comparison frame: siblings over one persisted frame."""
    frame = frame.persist()
    return {
        "class_distribution": C.class_distribution(frame), "agreement_matrix": C.agreement_matrix(frame), "confidence_summary": C.confidence_summary(frame),
        "ambiguous": C.ambiguous_cases(frame), "transitions": C.transitions(frame), "examples": C.transition_examples(frame), "bands": C.agreement_by_band(frame),
        "band_grid": C.agreement_by_band_pair(frame), "top_divergences": C.top_divergences(frame), "conflicts": C.confidence_conflicts(frame),
        "per_class": M.per_class(M.confusion(frame, [], true="label_b", pred="label_a"), []),
    }


@stage("features")
def features(spark: SparkSession, root: str, *, label_column: str = "sentiment_label", test_size: float = 0.2, validation_size: float = 0.1, **bounds) -> str:
    """Split the labelled corpus and write its TF-IDF weights, fitted on the training rows."""
    corpus = contracts.LABELED_CORPUS.validate(spark.read.parquet(f"{root}/silver/corpus_rotulado.parquet"))
    split = S.stratified_split(corpus, label_column=label_column, test_size=test_size, validation_size=validation_size)
    split.write.mode("overwrite").parquet(f"{root}/gold/corpus_dividido.parquet")
    train = split.where("split = 'treino'").select("id", X.ngrams(text.tokenize_and_normalize(F.col("text")), (1, 2)).alias("terms"))
    out = f"{root}/gold/tfidf.parquet"
    X.tfidf(train, **bounds).write.mode("overwrite").parquet(out)
    return out


@stage("evaluate")
def evaluate(spark: SparkSession, root: str, *, names: tuple[str, ...] = ("naive_bayes", "logistic_regression"), seed: int = 42) -> dict[str, object]:
    """Metrics of each model on the test rows with intervals, and McNemar tests of all pairs with Holm's correction."""
    split = spark.read.parquet(f"{root}/gold/corpus_dividido.parquet")
    train, test = split.where("split = 'treino'"), split.where("split = 'teste'")
    scored = None
    for name in names:
        p = models.create_classifier(name, C.CLASSES).fit(train).transform(test).select("id", F.col("sentiment_label").alias("y_true"), F.col("y_pred").alias(f"pred_{name}"))
        scored = p if scored is None else scored.join(p.drop("y_true"), "id")
    scored = scored.persist()
    import numpy as np

    tables, intervals, tests = {}, {}, []
    at = {c: i for i, c in enumerate(C.CLASSES)}
    for name in names:
        cells = M.confusion(scored, [], pred=f"pred_{name}").persist()
        tables[name] = M.classification_metrics(cells, [])
        matrix = np.zeros((3, 3), dtype=int)
        for r in cells.collect():  # nine cells
            matrix[at[r.y_true], at[r.y_pred]] = r.n
        intervals[name] = stats.bootstrap_cells(matrix, stats.macro_f1, seed=seed)
    for a, b in combinations(names, 2):
        r = M.mcnemar_cells(scored, F.col("y_true"), F.col(f"pred_{a}"), F.col(f"pred_{b}")).first()
        tests.append((a, b, stats.mcnemar_exact(r.a_only, r.b_only)))
    adjusted = stats.adjust_p_values([t[2] for t in tests])
    return {"metrics": tables, "f1_macro_intervals": intervals, "mcnemar": [(*t, q) for t, q in zip(tests, adjusted, strict=True)]}


def reproducibility_manifest(spark: SparkSession, path: str, *, seed: int = 42) -> dict[str, object]:
    import platform

    import pyspark

    digests = [r[0] for r in files.dataset_catalog(spark, [path]).orderBy("path").select("sha256").collect()]
    return {"seed": seed, "python": platform.python_version(), "pyspark": pyspark.__version__, "files": len(digests), "sha256": digests}
