"""Registered queries, continued: prompts and answers, joins, selections, references and partitions, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolytics.functions import prompts as P
from annolytics.operators import joins as J, metrics as M, sampling as S, selection as X
from annolytics.plans import queries as Q, views as V
from annolytics.plans.registry import query

rounded = Q.rounded


# prompts and answers

@query("label_only_prompt", "SELECT doc_id, md5('Tweet: \"' || text || '\"' || chr(10) || chr(10) || 'IGNORE o formato JSON descrito acima. Responda SOMENTE com uma palavra, sem pontuação nem explicação: negativo, neutro, positivo.') AS digest FROM documents")
def label_only_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(P.label_only_prompt('Tweet: "{{TEXTO}}"', F.col("text"))).alias("digest"))


@query("sentiment_prompt", """SELECT doc_id, md5('Classifique o sentimento do texto em português brasileiro abaixo em uma das classes "negativo", "neutro", "positivo". Responda apenas com um objeto JSON contendo as chaves "sentiment_label", "confidence_score" (entre 0.0 e 1.0) e "justification".' || chr(10) || chr(10) || 'Texto: "' || text || '"' || chr(10) || 'Resposta:') AS digest FROM documents""")
def sentiment_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(P.sentiment_prompt(F.col("text"))).alias("digest"))


@query("multi_prompt", rf"""WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY 1)
SELECT conv_id, md5('Rotule.' || chr(10) || chr(10) || 'Classifique CADA tweet numerado abaixo de forma independente. Responda APENAS com uma lista JSON válida, um objeto por tweet, no formato [{{"id": 1, "label": "negativo"}}, ...], com os rótulos permitidos: negativo, neutro, positivo. Sem markdown, sem explicação.' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(ts) + 1), lambda i: i || '. ' || {Q.ws('ts[i]')}), chr(10))) AS digest FROM t""")
def multi_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return t.select("conv_id", F.md5(P.multi_prompt('Rotule.\nTweet: "{{TEXTO}}"', F.transform("ts", lambda x: x["text"]))).alias("digest"))


_ANSWER = "CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN ' YES ' ELSE 'maybe' END"


@query("yes_or_no_json", f"SELECT o_orderkey, CASE lower(trim({_ANSWER})) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS answer, CASE WHEN starts_with({_ANSWER}, 'yes') THEN 1 WHEN starts_with({_ANSWER}, 'no') THEN 0 END AS plain FROM orders")
def yes_or_no_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit(" YES "), F.lit("maybe")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    raw = F.concat(F.lit('<think>x</think> {"answer": "'), a, F.lit('", "why": "a\\_b"}'))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", P.yes_or_no_json(raw).alias("answer"), P.yes_or_no(a).alias("plain"))


@query("sentiment_answers", f"WITH {V.RATERS_SQL} SELECT id, CASE WHEN id % 5 = 4 THEN NULL ELSE label_oa END AS label, round(CASE WHEN id % 5 = 4 THEN 0.0 ELSE round(confidence_oa, 3) END, 9) AS confidence FROM raters")
def sentiment_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 5 == 4, "outro").otherwise(F.upper("label_oa"))
    tail = F.when(F.col("id") % 3 == 0, '"justification": "a "b" c"}').otherwise('"justification": "a"}')
    raw = F.concat(F.format_string('ok {"sentiment_label": "%s", "confidence_score": %.3f, ', label, F.col("confidence_oa")), tail)
    return rounded(V.raters(spark, sf_dir).select("id", P.sentiment_answer(raw).alias("x")).select("id", "x.label", "x.confidence"))


@query("first_token_labels", f"""WITH {V.RATERS_SQL}, p AS (SELECT id, exp(-confidence_hf)::DOUBLE AS pos, exp(-confidence_oa)::DOUBLE AS neg FROM raters)
SELECT id, CASE WHEN neg >= pos THEN 'negativo' ELSE 'positivo' END AS label, round(greatest(pos, neg) / (pos + neg), 9) AS confidence FROM p""")
def first_token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.create_map(F.lit(" Pos"), -F.col("confidence_hf"), F.lit("neg"), -F.col("confidence_oa"), F.lit("ne"), F.lit(-0.1).cast("double"))
    return rounded(V.raters(spark, sf_dir).select("id", P.first_token_label(F.lit("x"), tokens).alias("x")).select("id", "x.label", "x.confidence"))


@query("shortened_names", "SELECT p_partkey, CASE WHEN length(p_name) <= 16 THEN p_name ELSE regexp_replace(substr(p_name, 1, 7), '[-_]+$', '') || '-' || substr(sha256(p_name), 1, 8) END AS short, regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def shortened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select("p_partkey", P.shortened(F.col("p_name"), 16).alias("short"), P.slug(F.col("p_type")).alias("slug"))


@query("display_texts", "SELECT doc_id, replace(substr(text, 1, 128), chr(10), ' ') AS shown FROM documents")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", P.display(F.col("text")).alias("shown"))


@query("clean_hypotheses", r"""SELECT item_id, trim(regexp_replace(regexp_replace(' - "' || text || '" ', '^[\s"''-]+', ''), '[\s"'']+$', '')) AS hypothesis FROM benchmark""")
def clean_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select("item_id", P.clean_hypothesis(F.concat(F.lit(' - "'), F.col("text"), F.lit('" '))).alias("hypothesis"))


# privacy and authors

@query("author_keys", f"WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_custkey FROM orders) SELECT 't' || CASE WHEN length(n::VARCHAR) >= 7 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 7, '0') END AS id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE {Q.hmac_sql('o_custkey', b'key', 20)} END AS author_key FROM r")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("author"))
    return J.author_keys(o, key=b"key", author_column="author", order="o_orderkey")


# joins

def _labels(spark: SparkSession, sf_dir: str, column: str, *, every: int = 1) -> DataFrame:
    r = V.raters(spark, sf_dir)
    return r.where(F.col("id") % every == 0).select("id", F.col(column).alias("sentiment_label"))


@query("merge_consensus", f"WITH {V.RATERS_SQL} SELECT id, word_count, CASE WHEN id % 2 = 0 THEN label_oa END AS sentiment_label, CASE WHEN id % 2 = 0 THEN label_oa END AS sentiment_label_huggingface FROM raters")
def merge_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.merge_consensus(V.raters(spark, sf_dir).select("id", "word_count"), _labels(spark, sf_dir, "label_oa", every=2))


@query("human_labels", f"WITH {V.RATERS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN label_c ELSE label_oa END AS sentiment_label, CASE WHEN id % 3 = 0 THEN label_c END AS manual_label, id % 3 = 0 AS is_human_validated FROM raters")
def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_human_labels(_labels(spark, sf_dir, "label_oa"), _labels(spark, sf_dir, "label_c", every=3)).select("id", "sentiment_label", "manual_label", "is_human_validated")


@query("labeling_error_rate", f"WITH {V.RATERS_SQL} SELECT count(*) AS n, round(avg((label_oa <> label_c)::INT), 9) AS error_rate FROM raters WHERE id % 3 = 0")
def labeling_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.labeling_error_rate(_labels(spark, sf_dir, "label_oa"), _labels(spark, sf_dir, "label_c", every=3)))


_KAPPA_SQL = """{by_} c AS (SELECT {by} a, b, count(*)::DOUBLE AS n FROM x GROUP BY ALL), t AS (SELECT {by} sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS s FROM c GROUP BY ALL),
ma AS (SELECT {by} a AS l, sum(n) AS na FROM c GROUP BY ALL), mb AS (SELECT {by} b AS l, sum(n) AS nb FROM c GROUP BY ALL), ch AS (SELECT {bya} sum(na * nb) AS ch FROM ma JOIN mb USING ({by} l) GROUP BY ALL)"""


@query("agreement_with_gold", f"WITH {V.RATERS_SQL}, x AS (SELECT label_oa AS a, label_c AS b FROM raters WHERE id % 3 = 0), {_KAPPA_SQL.format(by='', bya='', by_='')} SELECT CAST(t.n AS BIGINT) AS n, round(s / t.n, 9) AS agreement_rate, round((s / t.n - ch / (t.n * t.n)) / (1 - ch / (t.n * t.n)), 9) AS kappa, (s / t.n - ch / (t.n * t.n)) / (1 - ch / (t.n * t.n)) >= 0.6 AS acceptable FROM t, ch")
def agreement_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.agreement_with_gold(_labels(spark, sf_dir, "label_oa"), _labels(spark, sf_dir, "label_c", every=3)))


@query("predictions_wide", f"WITH {V.PREDS_SQL}, m AS (SELECT id, max(CASE WHEN id % 4 <> 0 THEN pred_a END) AS pred_a, max(pred_b) AS pred_b FROM preds GROUP BY id) SELECT DISTINCT p.id, p.y_true, m.pred_a, m.pred_b FROM preds p JOIN m USING (id)")
def predictions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.predictions(spark, sf_dir)
    long = J.long_predictions(p.withColumn("pred_a", F.when(F.col("id") % 4 != 0, F.col("pred_a"))), ["a", "b"])
    return J.wide(J.predictions_table(p.select("id", "y_true"), long), ["a", "b"])


_GOLDS_SQL = "golds AS (SELECT 'gold_a' AS reference, id, label_hf AS label FROM raters WHERE label_hf <> 'indefinido' UNION ALL SELECT 'gold_b', id, label_c FROM raters UNION ALL SELECT 'consenso_gold', id, label_c FROM raters WHERE label_hf = label_c)"


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annolytics.operators import consensus as C, errors as E

    r = V.raters(spark, sf_dir)
    return E.gold_references({"gold_a": r.select("id", F.col("label_hf").alias("sentiment_label")), "gold_b": r.select("id", F.col("label_c").alias("sentiment_label"))}, C.CLASSES)


@query("models_against_references", f"""WITH {V.RATERS_SQL}, {_GOLDS_SQL}, x AS (SELECT reference, model, g.label AS b, CASE model WHEN 'oa' THEN label_oa ELSE label_d END AS a FROM golds g JOIN raters r USING (id), (VALUES ('oa'), ('d')) m(model)), {_KAPPA_SQL.format(by='reference, model,', bya='reference, model,', by_='')}
SELECT reference, model, CAST(t.n AS BIGINT) AS n, round(s / t.n, 9) AS accuracy, round((s / t.n - ch / (t.n * t.n)) / (1 - ch / (t.n * t.n)), 9) AS kappa FROM t JOIN ch USING (reference, model)""")
def models_against_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = J.long_predictions(V.raters(spark, sf_dir), ["oa", "d"], prefix="label_")
    return rounded(J.models_against_references(long, _references(spark, sf_dir)).select("reference", "model", "n", "accuracy", "kappa"))


@query("label_noise", f"""WITH {V.RATERS_SQL}, {_GOLDS_SQL}, x AS (SELECT reference, g.label AS b, label_oa AS a FROM golds g JOIN raters r USING (id)), {_KAPPA_SQL.format(by='reference,', bya='reference,', by_='')}
SELECT reference, CAST(t.n AS BIGINT) AS n, round(s / t.n, 9) AS accuracy, round((s / t.n - ch / (t.n * t.n)) / (1 - ch / (t.n * t.n)), 9) AS kappa FROM t JOIN ch USING (reference)""")
def label_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.label_noise(_labels(spark, sf_dir, "label_oa"), _references(spark, sf_dir)).select("reference", "n", "accuracy", "kappa"))


@query("labeled_corpus", f"WITH {V.RATERS_SQL} SELECT id, word_count, label_hf AS sentiment_label, label_hf AS sentiment_label_huggingface FROM raters WHERE label_hf <> 'indefinido'")
def labeled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.labeled_corpus(V.raters(spark, sf_dir).select("id", "word_count"), _labels(spark, sf_dir, "label_hf"))


@query("rater_table", f"WITH {V.RATERS_SQL} SELECT id, label_hf, label_oa, label_c FROM raters WHERE label_hf <> 'indefinido' AND id % 2 = 0")
def rater_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rater_table({"hf": _labels(spark, sf_dir, "label_hf"), "oa": _labels(spark, sf_dir, "label_oa", every=2), "c": _labels(spark, sf_dir, "label_c")})


@query("diagnostic_corpus", f"WITH {V.COMPARISON_SQL} SELECT CAST(id AS VARCHAR) AS id, round(least(confidence_a, confidence_b), 9) AS agreement_score, label_a AS lab_hf, label_b AS lab_oa, label_a AS gold_label FROM frame")
def diagnostic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.diagnostic_corpus(Q._frame(spark, sf_dir).withColumn("text_normalized", F.lit("")), {"hf": "label_a", "oa": "label_b"}, gold_column="label_a")
    return rounded(out.drop("text_normalized"))


@query("hypothesis_evidence", f"WITH {Q._LONG_SQL}, r AS (SELECT feature AS hypothesis, CAST(row_number() OVER (PARTITION BY feature ORDER BY x DESC, vec_id) AS INTEGER) AS rank, vec_id AS id FROM x WHERE x > 0) SELECT hypothesis, rank, id, label FROM r JOIN embeddings e ON e.vec_id = r.id WHERE rank <= 5")
def hypothesis_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    long = e.select("id", F.posexplode(F.col("embedding").cast("array<double>")).alias("hypothesis", "activation"))
    return J.hypothesis_evidence(long, e.select("id", "label"), k=5).select("hypothesis", "rank", "id", "label")


@query("pivoted_features", r"""WITH c AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark) SELECT id, count(*) FILTER (t = 'the')::DOUBLE AS the, count(*) FILTER (t = 'a')::DOUBLE AS a FROM c GROUP BY 1""")
def pivoted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annolytics.operators import features as T

    counts = T.term_counts(Q._terms(spark, sf_dir)).withColumn("tfidf_weight", F.col("tf").cast("double"))
    return J.pivoted_features(counts, ["the", "a"])


@query("models_by_concept", f"WITH {V.PREDS_SQL}, x AS (SELECT '{J.EVERY}' AS concept, * FROM preds UNION ALL SELECT slice, * FROM preds), l AS (SELECT concept, 'a' AS model, y_true, pred_a AS p FROM x UNION ALL SELECT concept, 'b', y_true, pred_b FROM x) SELECT concept, model, count(*) AS n, round(avg((y_true = p)::INT), 9) AS accuracy FROM l GROUP BY 1, 2")
def models_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.models_by_concept(V.predictions(spark, sf_dir).withColumnRenamed("slice", "concept"), ["a", "b"]).select("concept", "model", "n", "accuracy"))


@query("run_metrics", f"WITH {V.PREDS_SQL}, x AS (SELECT 'a' AS model, avg((y_true = pred_a)::INT) AS m FROM preds UNION ALL SELECT 'b', avg((y_true = pred_b)::INT) FROM preds) SELECT 'r1' AS run_id, model AS model_name, 'accuracy' AS metric_name, round(m, 9) AS metric_value, 'sha' AS git_sha, 'hash' AS dataset_hash FROM x")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = J.long_predictions(V.predictions(spark, sf_dir), ["a", "b"], keep=("y_true",))
    scores = M.classification_metrics(M.confusion(long, ["model"]), ["model"]).select("model", "accuracy")
    return rounded(J.run_metrics(scores, run_id="r1", git_sha="sha", dataset_hash="hash"))


@query("kappa_matrix", f"""WITH {V.VALID_SQL}, p AS (SELECT 'hf' AS u, 'oa' AS v, label_hf AS a, label_oa AS b FROM valid UNION ALL SELECT 'hf', 'c', label_hf, label_c FROM valid UNION ALL SELECT 'oa', 'c', label_oa, label_c FROM valid), x AS (SELECT * FROM p),
{_KAPPA_SQL.format(by='u, v,', bya='u, v,', by_='')}, k AS (SELECT u, v, (s / t.n - ch / (t.n * t.n)) / (1 - ch / (t.n * t.n)) AS k FROM t JOIN ch USING (u, v)), f AS (SELECT u, v, k FROM k UNION ALL SELECT v, u, k FROM k)
SELECT u AS rater, round(CASE WHEN u = 'hf' THEN 1 ELSE max(k) FILTER (v = 'hf') END, 9) AS hf, round(CASE WHEN u = 'oa' THEN 1 ELSE max(k) FILTER (v = 'oa') END, 9) AS oa, round(CASE WHEN u = 'c' THEN 1 ELSE max(k) FILTER (v = 'c') END, 9) AS c FROM f GROUP BY u""")
def kappa_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annolytics.operators import consensus as C

    three = ["hf", "oa", "c"]
    return rounded(J.kappa_matrix(C.kappa_of_cells(C.rater_cells(Q._consensus(spark, sf_dir), three), ["rater_a", "rater_b"]), three))


# selections

@query("underperforming_slices", f"WITH {V.PREDS_SQL} SELECT slice, round(avg((y_true = pred_b)::INT), 9) AS accuracy FROM preds GROUP BY 1 HAVING avg((y_true = pred_b)::INT) < 0.5")
def underperforming_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.classification_metrics(M.confusion(V.predictions(spark, sf_dir), ["slice"], pred="pred_b"), ["slice"])
    return rounded(X.underperforming(m, metric="accuracy", threshold=0.5).select("slice", "accuracy"))


@query("human_review", f"WITH {V.PREDS_SQL} SELECT id, round(confidence, 9) AS confidence FROM preds WHERE confidence < 0.4")
def human_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.human_review(V.predictions(spark, sf_dir), confidence="confidence", threshold=0.4))


@query("prepared_corpus", "SELECT min(doc_id) AS doc_id, min_by(n_chars, doc_id) % 2 < 1 AS low_confidence FROM documents WHERE trim(text) <> '' GROUP BY text")
def prepared_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") % 2).alias("c"))
    return X.prepared_corpus(d, text_column="text", confidence_column="c", threshold=1, id_column="doc_id").select("doc_id", "low_confidence")


@query("best_by_category", "WITH m AS (SELECT o_orderpriority AS category, o_orderstatus AS model, round(avg(o_totalprice), 6) AS f1_macro FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1_macro DESC, model) AS r FROM m) SELECT category, model FROM r WHERE r = 1")
def best_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("model")).agg(F.round(F.avg("o_totalprice"), 6).alias("f1_macro"))
    return X.best_by_category(m).select("category", "model")


_DRAW = "md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey"


@query("discovery_and_eval", f"WITH {Q._RANK_SQL} SELECT o_orderkey, CASE WHEN rn <= round_even(h * 0.3::DOUBLE, 0) THEN 'eval' ELSE 'discovery' END AS part FROM r")
def discovery_and_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return X.discovery_and_eval(o, eval_fraction=0.3, label_column="o_orderpriority", id_column="o_orderkey").select("o_orderkey", "part")


@query("few_shot", f"WITH {Q._RANK_SQL} SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= 2")
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.few_shot(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), label_column="o_orderpriority", id_column="o_orderkey")


@query("folds", f"WITH {Q._RANK_SQL} SELECT o_orderkey, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM r")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.folds(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), 5, label_column="o_orderpriority", id_column="o_orderkey").select("o_orderkey", "fold")


@query("for_human_validation", f"""WITH f AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS agreement_ratio FROM orders WHERE o_orderkey % 3 = 0), l AS (SELECT *, CASE WHEN agreement_ratio < 0.3 THEN 'baixa' WHEN agreement_ratio < 0.5 THEN 'media' ELSE 'moderada' END AS confidence_level FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY confidence_level ORDER BY {_DRAW}) AS rn, count(*) OVER (PARTITION BY confidence_level) AS h, count(*) OVER () AS total FROM l) SELECT o_orderkey, confidence_level FROM r WHERE rn <= least(greatest(1, round_even(h * (200.0::DOUBLE / total), 0)), h)""")
def for_human_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100).cast("double") / 100).alias("agreement_ratio"), (F.col("o_orderkey") % 3 == 0).alias("is_low_confidence"))
    return X.for_human_validation(o, sample_size=200, id_column="o_orderkey").select("o_orderkey", "confidence_level")


@query("equal_allocation", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM (SELECT o_orderpriority AS p, count(*) AS c FROM orders GROUP BY 1)), q AS (SELECT p, least(53 // m + CASE WHEN k <= 53 % m THEN 1 ELSE 0 END, c) AS take FROM s), {Q._RANK_SQL}
SELECT o_orderkey, o_orderpriority, round(h::DOUBLE / take, 9) AS weight FROM r JOIN q ON p = o_orderpriority WHERE rn <= take""")
def equal_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(X.equal_allocation(o, sample_size=53, stratum="o_orderpriority", id_column="o_orderkey"))


@query("by_concept", "WITH a AS (SELECT l_orderkey AS id, l_returnflag AS concept FROM lineitem GROUP BY ALL), c AS (SELECT concept, count(*) AS c FROM a GROUP BY 1), o AS (SELECT id, first(concept ORDER BY c, concept) AS concept FROM a JOIN c USING (concept) GROUP BY id), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS r FROM o) SELECT id, concept FROM r WHERE r <= 7")
def by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("concept")).distinct().withColumn("present", F.lit(True))
    return X.by_concept(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), a, per_concept=7)


@query("top_and_zero", f"WITH {Q._LONG_SQL}, t AS (SELECT feature AS neuron, vec_id, 'top' AS kind, row_number() OVER (PARTITION BY feature ORDER BY x DESC, vec_id) AS r FROM x WHERE x > 0 UNION ALL SELECT feature, vec_id, 'zero', row_number() OVER (PARTITION BY feature ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) FROM x WHERE x <= 0) SELECT neuron, vec_id, kind FROM t WHERE r <= 5")
def top_and_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = V.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("neuron", "activation"))
    return X.top_and_zero(long, n=10, id_column="vec_id")


@query("mean_confidence", f"WITH {V.PREDS_SQL} SELECT round(avg(greatest(p0, p1, p2)), 9) AS mean_confidence, round(corr((y_true = pred_a)::INT, confidence), 9) AS correlation FROM preds")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.predictions(spark, sf_dir)
    right = (F.col("y_true") == F.col("pred_a")).cast("double")
    return rounded(p.agg(X.mean_confidence([F.col(c) for c in ("p0", "p1", "p2")]).alias("mean_confidence"), F.corr(right, "confidence").alias("correlation")))


@query("confidence_threshold", "WITH r AS (SELECT l_quantity AS c, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT min(c) AS threshold FROM r WHERE i >= ceil(round((n - 1) * (1 - 0.8::DOUBLE), 9))")
def confidence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.confidence_threshold(V.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("c")), "c", 0.8)


@query("dataset_summary", f"WITH {V.RATERS_SQL} SELECT label_oa AS label, count(*) AS n, round(avg((confidence_oa < 0.5)::INT), 4) AS low_confidence_rate FROM raters GROUP BY 1")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dataset_summary(V.raters(spark, sf_dir).withColumn("low", F.col("confidence_oa") < 0.5), label_column="label_oa", low="low")


@query("rater_agreement", f"WITH {V.VALID_SQL} SELECT count(*) AS n, round(avg((top_votes < 4)::INT), 9) AS disagreement_rate, round(avg(top_votes / 4.0::DOUBLE), 9) AS mean_agreement FROM consensus")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"label_{r}" for r in Q.RATERS]
    r = V.raters(spark, sf_dir).withColumn("label_hf", F.when(F.col("label_hf") != J.UNDEFINED, F.col("label_hf")))
    return rounded(X.rater_agreement(r, names))


@query("error_patterns", f"WITH {V.PREDS_SQL}, c AS (SELECT slice AS category, pred_a AS model, pred_b AS suggested, count(*) AS n FROM preds WHERE y_true <> pred_a GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY category), 9) AS share FROM c")
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.predictions(spark, sf_dir).where(F.col("y_true") != F.col("pred_a"))
    return rounded(X.error_patterns(p.select(F.col("slice").alias("category"), F.col("pred_a").alias("model"), F.col("pred_b").alias("suggested"))))


@query("error_by_group", f"WITH {V.PREDS_SQL}, x AS (SELECT 'slice' AS grouping, slice AS \"group\", 1 - confidence AS e, confidence < 0.5 AS a FROM preds UNION ALL SELECT 'y_true', y_true, 1 - confidence, confidence < 0.5 FROM preds) SELECT grouping, \"group\", count(*) AS n, round(avg(e), 9) AS mean_error, round(avg(a::INT), 9) AS anomaly_rate FROM x GROUP BY 1, 2")
def error_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.predictions(spark, sf_dir).drop("group").withColumns({"error": 1 - F.col("confidence"), "is_anomaly": F.col("confidence") < 0.5})
    return rounded(X.error_by_group(p, ["slice", "y_true"]))


@query("partitions", "WITH d AS (SELECT doc_id AS id, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn, count(*) OVER (PARTITION BY lang) AS h FROM d WHERE r = 1) SELECT id, CASE WHEN rn <= round_even(h * 0.2::DOUBLE, 0) THEN 'holdout' WHEN rn <= round_even(h * 0.2::DOUBLE, 0) + round_even(h * 0.1::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS partition FROM s")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return X.partitions(d, ["lang"], holdout_size=0.2, validation_size=0.1, text_column="text").select("id", "partition")


@query("first_occurrences", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_occurrences(V.table(spark, sf_dir, "documents").select("doc_id", "text"), key="text", ordinal="doc_id").select("doc_id")
