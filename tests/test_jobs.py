from datetime import datetime

import pytest
from pyspark.sql import functions as F

from annolytics.plans import jobs


def test_preprocessing_stage(spark, tmp_path):
    rows = [
        ("1", "u", "RT @a: o produto é muito bom", False, True, "pt"), ("2", "u", "o produto é muito bom", False, False, "pt"), ("3", "u", "o  produto é muito bom", False, False, "pt"),
        ("4", "u", "bom", False, False, "pt"), ("5", "u", "promo promo promo de hoje", False, False, "pt"), ("6", "u", "o dia não foi de sol", False, False, "en"),
    ]
    df = spark.createDataFrame([(r[0], r[1], r[2], datetime(2024, 1, 1), r[5], r[3], r[4], 0, 0, 0, 0, None, None) for r in rows], "tweet_id string, user_id string, text string, created_at timestamp, language string, is_reply boolean, is_retweet boolean, like_count long, reply_count long, retweet_count long, quote_count long, source_query string, source_group string")
    df.write.parquet(str(tmp_path / "bronze"))
    out = jobs.run_stage("preprocessing", spark, str(tmp_path))
    assert [r.id for r in spark.read.parquet(out).collect()] == ["2"]
    for source, label in (("a", "positivo"), ("b", "neutro")):
        jobs.run_stage("labeling", spark, str(tmp_path), source=source, classify=lambda t, label=label: [(label, 0.9)] * len(t))
        jobs.run_stage("labeling", spark, str(tmp_path), source=source, classify=lambda t: 1 / 0)  # nothing is left to label
    found = jobs.run_stage("label_consensus", spark, str(tmp_path), sources=["a", "b"])
    assert found["disputed"].count() == 1
    with pytest.raises(jobs.StageError):
        jobs.run_stage("nothing", spark, str(tmp_path))


def test_features_and_evaluation(spark, tmp_path):
    words = {"positivo": "ótimo adorei", "negativo": "péssimo horrível", "neutro": "normal comum"}
    rows = [(str(i), f"{words[c]} item{i % 7} produto", c) for i, c in enumerate(list(words) * 40)]
    spark.createDataFrame(rows, "id string, text string, sentiment_label string").write.parquet(str(tmp_path / "silver/corpus_rotulado.parquet"))
    weights = spark.read.parquet(jobs.run_stage("features", spark, str(tmp_path)))
    assert weights.where(F.col("term") == "ótimo_adorei").count() == 28
    found = jobs.run_stage("evaluate", spark, str(tmp_path))
    assert found["metrics"]["naive_bayes"].first().f1_macro == 1.0
    assert found["mcnemar"][0][2] == 1.0
