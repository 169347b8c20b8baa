import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics import contracts
from annolytics.operators import consensus as C, features as X, metrics as M, sampling as S, stats
from annolytics.sources import files


def test_consensus_golden(spark):
    p, n, u = "positivo", "negativo", "neutro"
    rows = [(0, p, p, p, p), (1, p, p, p, n), (2, p, p, u, u), (3, p, n, n, n), (4, n, p, u, p), (5, u, u, p, n), (6, p, p, p, "indefinido"), (7, p, p, p, None)]
    df = spark.createDataFrame(rows, "id int, label_a string, label_b string, label_c string, label_d string")
    got = {r.id: (r.consensus_level, r.consensus_label, r.polarity_conflict) for r in C.consensus_frame(df, ["a", "b", "c", "d"]).collect()}
    assert got == {
        0: ("unanimidade", p, False), 1: ("maioria", p, True), 2: ("empate", "sem_consenso", False), 3: ("maioria", n, True), 4: ("pluralidade", p, True), 5: ("pluralidade", u, True),
    }
    levels = {r.consensus_level: r.n for r in C.consensus_levels(C.consensus_frame(df, ["a", "b", "c", "d"]).where("id = 0")).collect()}
    assert levels == {"unanimidade": 1, "maioria": 0, "pluralidade": 0, "empate": 0}


def test_kappa_golden(spark):
    p, n, u = "positivo", "negativo", "neutro"
    df = spark.createDataFrame([(p, p), (n, n), (u, p)], "label_a string, label_b string").groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    assert C.kappa_of_cells(df, ["k"]).first().kappa == pytest.approx(0.5)


def test_comparison_golden(spark):
    p, n, u = "positivo", "negativo", "neutro"
    rows = list(zip(map(str, range(6)), [p, n, u, p, n, p], [p, n, u, u, p, n], [0.95, 0.9, 0.6, 0.85, 0.92, 0.97], [0.9, 0.88, 0.55, 0.7, 0.86, 0.3], [3] * 6, strict=True))
    df = spark.createDataFrame(rows, "id string, label_x string, label_y string, confidence_x double, confidence_y double, word_count int")
    frame = C.comparison_frame(df, "x", "y")
    assert [r.agree for r in frame.orderBy("id").collect()] == [True] * 3 + [False] * 3
    assert [r.min_confidence for r in C.top_divergences(frame).collect()] == [0.86, 0.3, 0.7]
    conflict = C.confidence_conflicts(frame).collect()
    assert [(r.id, round(r.gap, 2), r.more_confident) for r in conflict] == [("5", 0.67, "a")]
    assert sum(r.share for r in C.transitions(frame).collect()) == pytest.approx(1)


def test_metrics_zero_division_and_mcc(spark):
    cells = M.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y_true string, y_pred string"), [])
    by = {r.label: r for r in M.per_class(cells, []).collect()}
    assert (by["c"].precision, by["c"].recall, by["c"].f1) == (0, 0, 0)
    one = M.classification_metrics(M.confusion(spark.createDataFrame([("a", "a")], "y_true string, y_pred string"), []), []).first()
    assert one.mcc == 0 and one.accuracy == 1


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 10, 300) / 10, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    got = M.roc_auc(df, F.col("s"), F.col("y") == 1).first()
    pos, neg = s[y == 1], s[y == 0]
    assert got.roc_auc == pytest.approx(((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()))


def test_splits(spark):
    df = spark.createDataFrame([(i, "x" if i % 4 else "y", None if i % 50 == 0 else i % 60) for i in range(600)], "id long, label string, author long")
    split = S.stratified_split(df, label_column="label")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {("x", "teste"): 90, ("x", "validacao"): 45, ("x", "treino"): 315, ("y", "teste"): 30, ("y", "validacao"): 15, ("y", "treino"): 105}
    grouped = S.grouped_split(df, group_column="author").where("author is not null").groupBy("author").agg(F.count_distinct("split").alias("n"))
    assert grouped.where("n > 1").isEmpty()
    with pytest.raises(ValueError):
        S.stratified_split(df, label_column="label", test_size=0.9, validation_size=0.2)


def test_cross_split_dedup_golden(spark):
    df = spark.createDataFrame([("ótimo", "treino", 1), ("ótimo", "teste", 2), ("ótimo", "validacao", 3), ("ruim", "treino", 4), ("ruim", "treino", 5)], "k string, split string, id int")
    assert sorted(r.id for r in S.remove_cross_split_duplicates(df, key="k").collect()) == [2, 4, 5]


def test_tfidf_and_ngrams(spark):
    docs = spark.createDataFrame([(1, ["b"]), (2, ["a"]), (3, ["a", "b"])], "id int, terms array<string>")
    words = {r.term: r["index"] for r in X.vocabulary(X.term_counts(docs), 3, min_document_frequency=1, max_document_frequency_ratio=1.0).collect()}
    assert words == {"a": 0, "b": 1}
    assert docs.select(X.ngrams(F.col("terms"), (1, 2)).alias("g")).where("size(g) = 3").first().g == ["a", "b", "a_b"]


def test_driver_statistics():
    assert stats.wilson(50, 100) == pytest.approx((0.4038, 0.5962), abs=1e-4)
    assert stats.mcnemar_exact(0, 0) == 1.0 and stats.mcnemar_exact(1, 9) == pytest.approx(0.021484375)
    assert stats.adjust_p_values([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert stats.adjust_p_values([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])
    assert stats.adjust_p_values([]) == []
    with pytest.raises(ValueError):
        stats.adjust_p_values([0.5], "x")
    m = np.array([[50, 5, 5], [4, 60, 6], [3, 2, 65]])
    low, high = stats.bootstrap_cells(m, stats.macro_f1)
    assert low < stats.macro_f1(m) < high
    assert stats.quadratic_kappa(np.diag([3, 4, 5])) == 1.0
    assert stats.friedman(np.array([[1, 2, 3]] * 4, dtype=float)) == pytest.approx(8.0)
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 500)
    y = np.array([rng.choice(3, p=r) for r in p])
    assert 0.6 < stats.fit_temperature(p, y) < 1.6


def test_contracts(spark):
    good = spark.createDataFrame([("1", "t", "neutro")], "id string, text string, sentiment_label string")
    contracts.LABELED_CORPUS.validate(good)
    with pytest.raises(contracts.ContractError, match="id repeat"):
        contracts.LABELED_CORPUS.validate(good.union(good))
    with pytest.raises(contracts.ContractError, match="label"):
        contracts.LABELED_CORPUS.validate(good.withColumn("sentiment_label", F.lit("bom")))
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.LABELED_CORPUS.validate(good.drop("text"))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a@b.com, ok"), ("2", "x\ny")], "id string, text string")
    files.write_csv(df, str(tmp_path / "c.csv"), mask_text=True)
    assert sorted(map(tuple, files.read_dataset(spark, str(tmp_path / "c.csv")).collect())) == [("1", "<email>, ok"), ("2", "x\ny")]
    with pytest.raises(files.DataError):
        files.read_dataset(spark, "x.txt")
    with pytest.raises(files.DataError):
        files.write_dataset(df.limit(0), str(tmp_path / "e.parquet"))
    (tmp_path / "k.jsonl").write_text('{"id":"1","sentiment_label":"neutro","confidence_score":0.5}\nbroken\n{"id":"1","sentiment_label":"positivo","confidence_score":0.9}\n')
    assert [tuple(r) for r in files.read_checkpoint(spark, str(tmp_path / "k.jsonl")).collect()] == [("1", "positivo", 0.9)]
    gold = spark.createDataFrame([("1", "bom @ana", " POS "), ("2", "", "neg"), ("3", "x", "indefinido")], "id string, text_normalized string, sentiment_label string")
    assert [tuple(r) for r in files.load_gold_set(gold).collect()] == [("1", "bom [MENCAO]", "positivo")]
    assert "| id |" in files.to_markdown(df)
