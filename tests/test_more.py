"""Prompts, joins, selections and statistics beyond the registered queries, on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics import contracts
from annolytics.functions import prompts as P
from annolytics.operators import joins as J, sampling as S, selection as X, stats
from annolytics.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_checkpoint_gives_the_record_appended_last(spark, tmp_path):
    path = str(tmp_path / "checkpoint")
    for i in range(6):
        files.append_checkpoint(spark.createDataFrame([("a", f"label{i}", i / 10), (f"b{i}", "x", 0.5)], "id string, sentiment_label string, confidence_score double"), path)
        got = {r.id: r.sentiment_label for r in files.read_checkpoint(spark, path).collect()}
        assert got["a"] == f"label{i}" and len(got) == i + 2


def test_null_strata_and_keys_stay(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(30)], "id long, c string")
    split = S.stratified_split(df, label_column="c")
    assert split.count() == 30 and split.where("c is null and split = 'teste'").count() == 2
    assert S.stratified_subset(df, stratify_column="c", sample_size=9).count() == 9
    rows = spark.createDataFrame([(1, None, "treino"), (2, None, "teste"), (3, "k", "treino"), (4, "k", "teste"), (5, "m", "treino")], "id long, k string, split string")
    assert sorted(r.id for r in S.remove_cross_split_duplicates(rows, key="k").collect()) == [2, 4, 5]


def test_report_tables_are_not_cut(spark):
    assert files.to_markdown(spark.range(3)).count("\n") == 4
    with pytest.raises(files.DataError):
        files.to_markdown(spark.range(11), limit=10)


def test_answers(spark):
    assert one(spark, P.yes_or_no(F.lit("<think>no</think> yes, it does"))) == 1
    assert one(spark, P.yes_or_no_json(F.lit('x {"answer": " No ", "why": "a\\_b"} y'))) == 0
    assert one(spark, P.yes_or_no_json(F.lit("nothing"))) is None
    assert one(spark, P.concept(F.lit('```json\n{"conceito": null}\n```'))) == '{"conceito": null}'
    assert one(spark, P.concept(F.lit('{"other": 1}'))) is None
    assert one(spark, P.sentiment_answer(F.lit('{"sentiment_label": "Positivo", "confidence_score": 1.5}'))).asDict() == {"label": "positivo", "confidence": 1.0}
    assert one(spark, P.sentiment_answer(F.lit("none"))).asDict() == {"label": None, "confidence": 0.0}
    tokens = F.create_map(F.lit("pos"), F.log(F.lit(0.6)), F.lit(" Neg"), F.log(F.lit(0.3)), F.lit("neu"), F.log(F.lit(0.1)), F.lit("ne"), F.lit(0.0))
    got = one(spark, P.first_token_label(F.lit(""), tokens))
    assert got.label == "positivo" and abs(got.confidence - 0.6) < 1e-12
    none = F.create_map().cast("map<string,double>")
    assert one(spark, P.first_token_label(F.lit("Negativo."), none)).asDict() == {"label": "negativo", "confidence": 1.0}
    assert one(spark, P.first_token_label(F.lit("ne"), none)) is None
    assert one(spark, P.rules(F.lit("1. ironia elogiosa → negativo.\n- texto vago\n* a -> b\n`a -> b`\na -> b -> c"), 5)) == ["ironia elogiosa -> negativo", "a -> b"]
    assert one(spark, P.clean_hypothesis(F.lit(' - "usa ironia" '))) == "usa ironia"
    assert one(spark, P.shortened(F.lit("x" * 100), 20)).startswith("x" * 11 + "-")
    assert P.with_rules("Classifique:\n{{TEXTO}}", ["ironia -> negativo"]).count("ironia") == 1
    with pytest.raises(ValueError):
        P.with_rules("no place", ["a -> b"])


def test_contracts(spark):
    good = spark.createDataFrame([("1", "t", 0.5, "positivo", None)], "id string, text_normalized string, agreement_score double, lab_a string, gold_label string")
    assert contracts.validate_diagnostic_corpus(good).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.validate_diagnostic_corpus(good.withColumn("lab_a", F.lit("other")))
    with pytest.raises(contracts.ContractError):
        contracts.validate_diagnostic_corpus(good.drop("lab_a"))
    with pytest.raises(contracts.ContractError):
        contracts.BINARY_TARGET.validate(spark.createDataFrame([("1", 2)], "id string, target long"))
    assert contracts.label_of_id(2) == "positivo"


def test_author_keys_follow_the_lines(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"u{i % 3}") for i in range(50)], "line long, author string").repartition(5)
    got = {r.id: r.author_key for r in J.author_keys(df, key=b"k", author_column="author", order="line").collect()}
    assert len(got) == 50 and got["t0000001"] is None and got["t0000002"] == got["t0000008"] and len(set(got.values())) == 4


def test_sample_ids_must_be_there(spark):
    with pytest.raises(ValueError):
        J.restricted_to_sample(spark.range(3), spark.range(5))
    assert J.restricted_to_sample(spark.range(9), spark.range(5)).count() == 5


def test_completions_are_held(spark, tmp_path):
    cache = files.CompletionCache(spark, str(tmp_path / "cache"))
    cache.add(spark.createDataFrame([("k1", "v1"), ("k2", None)], "key string, value string"))
    cache.add(spark.createDataFrame([("k1", "later"), ("k3", "v3")], "key string, value string"))
    got = cache.hits(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"))
    assert {r.key: r.value for r in got.collect()} == {"k1": "v1", "k2": None, "k3": "v3"}


def test_rank_tests():
    assert stats.wilcoxon([0.80, 0.82, 0.79], [0.75, 0.78, 0.74])[0] == 0
    w, p = stats.wilcoxon([1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30], [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29])
    assert w == 5 and abs(p - 0.0390625) < 1e-9  # published example
    assert stats.wilcoxon([1, 2], [1, 2]) == (0.0, 1.0)
    ranks, cd = stats.nemenyi(np.array([[0.80, 0.75, 0.70], [0.82, 0.78, 0.71], [0.79, 0.74, 0.69]]))
    assert ranks.tolist() == [1, 2, 3] and abs(cd - 3.3145 / math.sqrt(2) * math.sqrt(12 / 18)) < 1e-3
    assert abs(stats.student_p(2.0, 10) - 0.07338803) < 1e-6 and abs(stats.student_p(0.5, 3) - 0.65145) < 1e-4
    t, p, mean = stats.corrected_t([0.80, 0.82, 0.81, 0.79, 0.83], [0.70, 0.72, 0.71, 0.69, 0.731], n_train=800, n_test=200)
    assert mean > 0 and t > 0 and p < 0.05
    assert stats.corrected_t([1.0, 2.0], [1.0, 2.0], n_train=8, n_test=2) == (0.0, 1.0, 0.0)
    assert stats.mann_whitney([1, 2, 3, 4, 5], [6, 7, 8, 9, 10])[0] == 0


def test_agreement_and_matching():
    assert abs(stats.alpha_nominal([["P", "P"], ["P", "N"], ["N", "N"]]) - 0.4444) < 1e-3
    assert stats.alpha_nominal([["P", "P"], ["N", "N"], [None, "P"]]) == 1.0
    rng = np.random.default_rng(1)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 3)):
        x = rng.random((n, m))
        got = sum(x[i, j] for i, j in stats.match_pairs(x))
        k = min(n, m)
        rows = [p for p in permutations(range(n), k)]
        assert abs(got - max(sum(x[a, b] for a, b in zip(p, q)) for p in rows for q in permutations(range(m), k))) < 1e-9


def test_bootstrap_of_cells():
    rng = np.random.default_rng(2)
    y, a = rng.integers(0, 3, 900), rng.integers(0, 3, 900)
    b = np.where(rng.random(900) < 0.5, y, a)
    cells = np.zeros((3, 3, 3), dtype=int)
    np.add.at(cells, (y, a, b), 1)
    difference, low, high = stats.paired_bootstrap(cells, stats.macro_f1)
    assert low < difference < high < 0
    m = cells.sum(1)
    out = stats.slice_against_rest(cells.sum(2), m)
    assert out["significantly_worse"] and not out["small_sample"] and abs(out["share"] - 0.5) < 1e-9


def test_quality_and_hypotheses(spark):
    df = spark.createDataFrame([("a", 0.9, 0.7, 0.1), ("b", 0.5, 0.9, -0.9), ("c", None, None, 0.4), ("a", 0.9, 0.9, 0.3)], "hypothesis string, coverage double, specificity double, separation double")
    assert sorted(r.hypothesis for r in X.of_quality(df).collect()) == ["a", "a", "c"]
    assert [r.hypothesis for r in X.top_hypotheses(df, 2).collect()] == ["b", "c"]
