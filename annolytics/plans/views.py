"""Annotation views derived from the driver's tables by integer arithmetic, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annolytics.operators.consensus import CLASSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (n % 3 + 1).cast("int"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label_hf/oa/c/d, confidence_hf/oa, word_count, split_key: documents as annotated by four raters."""
    d, n = F.col("doc_id"), F.col("n_chars")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id", "left")
    hf = F.when(F.col("toxic") == 1, "negativo").when(F.col("quality") == 1, "positivo").when(F.col("quality") == 0, "neutro").otherwise("indefinido")
    return j.select(
        d.alias("id"), hf.alias("label_hf"), pick(d * 7 + n).alias("label_oa"), pick(d * 13 + 5).alias("label_c"), pick(n * 3 + d).alias("label_d"),
        (((d * 37 + 11) % 1000).cast("double") / 1000).alias("confidence_hf"), (((d * 91 + 17) % 1000).cast("double") / 1000).alias("confidence_oa"),
        n.alias("word_count"), "lang", "source",
    )


RATERS_SQL = """raters AS (
  SELECT d.doc_id AS id,
    CASE WHEN l.toxic = 1 THEN 'negativo' WHEN l.quality = 1 THEN 'positivo' WHEN l.quality = 0 THEN 'neutro' ELSE 'indefinido' END AS label_hf,
    ['negativo','neutro','positivo'][CAST((d.doc_id * 7 + n_chars) % 3 + 1 AS INTEGER)] AS label_oa,
    ['negativo','neutro','positivo'][CAST((d.doc_id * 13 + 5) % 3 + 1 AS INTEGER)] AS label_c,
    ['negativo','neutro','positivo'][CAST((n_chars * 3 + d.doc_id) % 3 + 1 AS INTEGER)] AS label_d,
    CAST((d.doc_id * 37 + 11) % 1000 AS DOUBLE) / 1000 AS confidence_hf, CAST((d.doc_id * 91 + 17) % 1000 AS DOUBLE) / 1000 AS confidence_oa,
    n_chars AS word_count, lang, source
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
VALID_SQL = RATERS_SQL + """, valid AS (SELECT * FROM raters WHERE label_hf <> 'indefinido'),
voted AS (SELECT *, v0 AS votes_negativo, v1 AS votes_neutro, v2 AS votes_positivo, greatest(v0, v1, v2) AS top_votes FROM (
  SELECT *, CAST((label_hf = 'negativo')::INT + (label_oa = 'negativo')::INT + (label_c = 'negativo')::INT + (label_d = 'negativo')::INT AS BIGINT) AS v0,
    CAST((label_hf = 'neutro')::INT + (label_oa = 'neutro')::INT + (label_c = 'neutro')::INT + (label_d = 'neutro')::INT AS BIGINT) AS v1,
    CAST((label_hf = 'positivo')::INT + (label_oa = 'positivo')::INT + (label_c = 'positivo')::INT + (label_d = 'positivo')::INT AS BIGINT) AS v2 FROM valid)),
levelled AS (SELECT *, CASE WHEN top_votes = 4 THEN 'unanimidade' WHEN (v0 = top_votes)::INT + (v1 = top_votes)::INT + (v2 = top_votes)::INT > 1 THEN 'empate'
    WHEN top_votes * 2 > 4 THEN 'maioria' ELSE 'pluralidade' END AS consensus_level, v0 > 0 AND v2 > 0 AS polarity_conflict FROM voted),
consensus AS (SELECT *, CASE WHEN consensus_level = 'empate' THEN 'sem_consenso' WHEN v0 = top_votes THEN 'negativo' WHEN v1 = top_votes THEN 'neutro' ELSE 'positivo' END AS consensus_label FROM levelled)"""
COMPARISON_SQL = RATERS_SQL + """, ids AS (SELECT *, CASE label_hf WHEN 'negativo' THEN 0 WHEN 'neutro' THEN 1 ELSE 2 END AS ka, CASE label_oa WHEN 'negativo' THEN 0 WHEN 'neutro' THEN 1 ELSE 2 END AS kb
  FROM raters WHERE label_hf <> 'indefinido'),
frame AS (SELECT id, label_hf AS label_a, label_oa AS label_b, confidence_hf AS confidence_a, confidence_oa AS confidence_b, word_count,
  label_hf = label_oa AS agree, abs(ka - kb) AS label_distance, least(confidence_hf, confidence_oa) AS min_confidence FROM ids)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tagger, sentiment_label, confidence_score, weight from events."""
    e = table(spark, sf_dir, "events")
    tagger = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").alias("id"), tagger.alias("tagger"), F.col("event_type").alias("sentiment_label"), (F.col("value") / 500).alias("confidence_score"), F.lit(1.0).alias("weight"))


VOTES_SQL = "votes AS (SELECT user_id AS id, json_extract_string(props, '$.k') AS tagger, event_type AS sentiment_label, value / 500 AS confidence_score, 1.0::DOUBLE AS weight FROM events)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y_true, pred_a, pred_b, p0..p2, confidence, group from lineitem: three classes A, N, R."""
    t = table(spark, sf_dir, "lineitem")
    name = lambda n: F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (n % 3 + 1).cast("int"))
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    a, b, c = F.col("l_discount") + 0.01, F.col("l_tax") + 0.01, (i.cast("double") / 50) + 0.01
    s = a + b + c
    out = t.select((k * 10 + i).alias("id"), F.col("l_returnflag").alias("y_true"), name(k * 3 + i).alias("pred_a"), name(k * 5 + i * 2).alias("pred_b"), (a / s).alias("p0"), (b / s).alias("p1"), (c / s).alias("p2"), F.col("l_suppkey").alias("group"), F.col("l_linestatus").alias("slice"))
    return out.withColumn("confidence", F.greatest("p0", "p1", "p2"))


PREDS_SQL = """raw AS (SELECT *, l_discount + 0.01 AS a, l_tax + 0.01 AS b, CAST(l_linenumber AS DOUBLE) / 50 + 0.01 AS c FROM lineitem),
preds AS (SELECT *, greatest(p0, p1, p2) AS confidence FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS y_true, ['A','N','R'][CAST((l_orderkey * 3 + l_linenumber) % 3 + 1 AS INTEGER)] AS pred_a,
  ['A','N','R'][CAST((l_orderkey * 5 + l_linenumber * 2) % 3 + 1 AS INTEGER)] AS pred_b, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2, l_suppkey AS "group", l_linestatus AS slice FROM raw))"""
