import pytest
from pyspark.sql import functions as F

from annolytics.functions import labels as L, text
from annolytics.operators import errors as E, models


def parsed(spark, value):
    return spark.createDataFrame([(value,)], "t string").select(L.parse_label_response(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"label":"positivo","confidence":0.9}', ("positivo", 0.9)),
        ('{"label":"positivo"}', ("positivo", 1.0)),
        ('<think>{"label":"x"}</think>```json\n{"label":" NEUTRO ","confidence":7}```', ("neutro", 1.0)),
        ('{"label":"negativo","probs":{"negativo":0.3},"confidence":0.9}', ("negativo", 0.3)),
        ("no json", None),
        ('{"label":"positivo",}', None),
        ('{"label":"bom"}', None),
        (None, None),
    ],
)
def test_label_response(spark, raw, want):
    got = parsed(spark, raw)
    assert (tuple(got) if got else None) == want


def test_multi_response(spark):
    df = spark.createDataFrame([('[{"id":1,"label":"neutro"},{"id":2,"label":"x"},{"id":3,"label":"positivo"},{"id":3,"label":"neutro"}]',), ("broken",)], "t string")
    got = [r.r for r in df.select(L.parse_multi_response(F.col("t"), 4).alias("r")).collect()]
    assert got[0] == ["neutro", None, None, None]
    assert got[1] is None or got[1] == [None] * 4


@pytest.mark.parametrize(
    ("t", "want"),
    [("o produto é ótimo, adorei", ("positivo", 1.0)), ("péssimo atendimento, é um lixo", ("negativo", 1.0)), ("nada a dizer", ("neutro", 0.0)), ("bom e ruim", ("neutro", 0.5)), ("😀", ("positivo", 1.0))],
)
def test_lexical_label(spark, t, want):
    got = spark.createDataFrame([(t,)], "t string").select(L.lexical_label(F.col("t")).alias("r")).first().r
    assert (got.label, float(got.confidence)) == want


def test_emojis(spark):
    got = spark.createDataFrame([("a😀😢🤔🚀🚀",)], "t string").select(text.normalize_emojis(F.col("t")).alias("n"), text.emoji_sentiment_counts(F.col("t")).alias("c")).first()
    assert got.n == "a[EMOJI_POSITIVO][EMOJI_NEGATIVO][EMOJI_NEUTRO][EMOJI]"
    assert tuple(got.c) == (1, 1, 1)


def test_risk_coverage(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "c double, y int")
    got = {r.coverage: (r.n_kept, r.threshold, r.accuracy) for r in E.risk_coverage(df, "c", F.col("y"), (0.25, 0.5, 1.0)).collect()}
    assert got == {0.25: (1, 0.9, 1.0), 0.5: (2, 0.8, 0.5), 1.0: (4, 0.6, 0.5)}


def test_batches_are_isolated(spark):
    def classify(texts):
        if "bad" in texts:
            raise RuntimeError("boom")
        return [("neutro", 0.5)] * len(texts)

    rows = spark.createDataFrame([(1, "a"), (2, "a")], "id int, text string")
    assert {r.sentiment_label for r in models.classify_batches(rows, classify, tagger="t").collect()} == {"neutro"}
    bad = models.classify_batches(spark.createDataFrame([(1, "bad")], "id int, text string"), classify, tagger="t").first()
    assert bad.error == "boom" and bad.sentiment_label is None


def test_error_source_table(spark):
    df = spark.createDataFrame([("a", "a", "a"), ("a", "b", "a"), ("b", "a", "a"), ("b", "b", "a"), ("b", "c", "a")], "l string, p string, r string")
    got = [r.s for r in df.select(E.error_source(F.col("l"), F.col("p"), F.col("r")).alias("s")).collect()]
    assert got == ["acerto", "erro_do_modelo", "erro_do_rotulo_de_treino", "modelo_reproduz_rotulo_errado", "ambos_errados_e_discordam"]
