"""Classifiers as MLlib pipelines over hashed or counted terms, a batch labelling surface, and ablation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame, functions as F

from annolytics.operators import metrics

BUILDERS: dict[str, Callable] = {
    "naive_bayes": lambda: NaiveBayes(smoothing=1.0),
    "logistic_regression": lambda: LogisticRegression(maxIter=100, regParam=0.001),
    "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=50)),
    "random_forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=10, minInstancesPerNode=2, seed=42),
}


def create_classifier(name: str, classes: tuple[str, ...], *, vocabulary: int = 20_000, least: int = 3, weighted: bool = True) -> Pipeline:
    """text, sentiment_label -> y_pred: term counts (with idf unless weighted is off) and a named classifier."""
    if name not in BUILDERS:
        raise ValueError(f"unknown classifier {name!r}")
    index = StringIndexer(inputCol="sentiment_label", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    stages = [index, RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+"), CountVectorizer(inputCol="_tokens", outputCol="_counts", vocabSize=vocabulary, minDF=least)]
    stages += [IDF(inputCol="_counts", outputCol="features")] if weighted else []
    model = BUILDERS[name]()
    model.setFeaturesCol("features" if weighted else "_counts")
    return Pipeline(stages=[*stages, model, IndexToString(inputCol="prediction", outputCol="y_pred", labels=sorted(classes))])


def evaluate(train: DataFrame, test: DataFrame, name: str, classes: tuple[str, ...], **options) -> DataFrame:
    """model and its classification metrics on test."""
    scored = create_classifier(name, classes, **options).fit(train).transform(test)
    cells = metrics.confusion(scored, [], true="sentiment_label")
    return metrics.classification_metrics(cells, []).select(F.lit(name).alias("model"), "*")


def ablation(train: DataFrame, test: DataFrame, name: str, classes: tuple[str, ...], components: dict[str, dict]) -> DataFrame:
    """component, baseline, f1_macro, impact: what leaving a component out costs."""
    baseline = evaluate(train, test, name, classes).first()["f1_macro"]
    rows = [(k, baseline, f := evaluate(train, test, name, classes, **options).first()["f1_macro"], baseline - f) for k, options in components.items()]
    return train.sparkSession.createDataFrame(rows, "component string, baseline double, f1_macro double, impact double")


def classify_batches(df: DataFrame, classify: Callable[[list[str]], list[tuple[str, float]]], *, tagger: str, weight: float = 1.0) -> DataFrame:
    """id, tagger, sentiment_label, confidence_score, weight, error: a user's batch function over texts, each distinct one once.

    A batch that fails gives its error instead of labels, and the others stand.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                found = classify(f["text"].tolist())
                f["sentiment_label"], f["confidence_score"], f["error"] = [x[0] for x in found], [float(x[1]) for x in found], None
            except Exception as e:  # noqa: BLE001  isolated by batch
                f["sentiment_label"], f["confidence_score"], f["error"] = None, None, str(e)[:500]
            yield f

    distinct = df.select("text").distinct().mapInPandas(run, "text string, sentiment_label string, confidence_score double, error string")
    return df.select("id", "text").join(distinct, "text").select("id", F.lit(tagger).alias("tagger"), "sentiment_label", "confidence_score", F.lit(weight).alias("weight"), "error")
