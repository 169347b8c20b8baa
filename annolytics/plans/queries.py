"""Registered queries: one for each family of operators, with DuckDB twins. Floats are rounded to 9 decimals on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolytics.functions import labels as L, privacy, text
from annolytics.operators import consensus as C, errors as E, features as X, metrics as M, sampling as S
from annolytics.plans import views as V
from annolytics.plans.registry import query

RATERS = ["hf", "oa", "c", "d"]
SPACE_SQL = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
WS = rf"trim(regexp_replace(T, '{SPACE_SQL}+', ' ', 'g'))"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def ws(expression: str) -> str:
    return WS.replace("T", expression, 1)


# text functions

NORM_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s\p{{Z}}]+|www\.[^\s\p{{Z}}]+', '[URL]', 'g'), '@[\p{{L}}\p{{N}}_]+', '[MENCAO]', 'g'), '#([\p{{L}}\p{{N}}_]+)', '\1', 'g'), '{SPACE_SQL}+', ' ', 'g'))"


def light(t):
    """URLs, mentions, hashtags and white space: the part of the normalisation that RE2 can repeat."""
    return text.normalize_whitespace(text.normalize_hashtags(text.normalize_mentions(text.normalize_urls(t))))


@query("normalized_corpus", f"SELECT doc_id, md5({NORM_SQL}) AS digest FROM documents")
def normalized_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(light(F.col("text"))).alias("digest"))


@query("normalize_tweet_text")
def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", text.normalize_tweet_text(F.col("text")).alias("text_normalized"))


@query("inclusion_filters", rf"""SELECT doc_id FROM documents WHERE length({ws('text')}) >= 5 AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) >= 2""")
def inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").where(text.is_minimum_length_content(F.col("text"))).select("doc_id")


@query("repeated_word_ratio", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL)
SELECT d.doc_id, round(coalesce(max(n)::DOUBLE / sum(n), 0.0), 9) AS ratio FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.table(spark, sf_dir, "documents").select("doc_id", text.repeated_word_ratio(F.col("text")).alias("ratio")))


@query("stopword_ratio", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents)
SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({text.PORTUGUESE_STOPWORDS}, x)))::DOUBLE / len(w) ELSE 0.0 END, 9) AS ratio FROM w""")
def stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.table(spark, sf_dir, "documents").select("doc_id", text.portuguese_stopword_ratio(F.col("text")).alias("ratio")))


@query("tokenize", r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '\[[A-ZÀ-Ú_]+\]|[A-Za-zÀ-ÿ]+(?:[''-][A-Za-zÀ-ÿ]+)*|[.,!?;:]') AS t FROM documents)""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokenize_text(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("tokens_negation")
def negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", text.tokenize_and_normalize(F.col("text")).alias("tokens"))


@query("duplicate_key", rf"SELECT doc_id, md5({ws(chr(39).join(['regexp_replace(lower(text), ', '[^\\p{L}\\p{N}\\s]', ', ', ' ', ', ', 'g', ')']))}) AS k FROM documents")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.duplicate_key(F.col("text"))).alias("k"))


@query("dedup_first", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM_SQL}")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(light(F.col("text"))).alias("h"), F.md5(light(F.col("text"))).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("pii_mask")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", privacy.mask_personal_data(F.col("text")).alias("text"))


@query("pii_counts")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.count_personal_data(V.table(spark, sf_dir, "documents"), "text")


@query("pseudonymize_id", "SELECT c_custkey, substr(sha256('salt' || CAST(c_custkey AS VARCHAR)), 1, 16) AS pseudonym FROM customer")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").select("c_custkey", privacy.pseudonymize_id(F.col("c_custkey"), "salt").alias("pseudonym"))


def hmac_sql(x: str, key: bytes, n: int) -> str:
    """The first n digits of HMAC-SHA-256 of an expression as text, put together from two plain hashes."""
    padded = key.ljust(64, b"\0")
    pad = lambda b: "".join(f"\\x{c ^ b:02X}" for c in padded)
    return f"substr(sha256('{pad(0x5C)}'::BLOB || from_hex(sha256('{pad(0x36)}'::BLOB || encode(CAST({x} AS VARCHAR))))), 1, {n})"


@query("pseudonymize_hmac", f"SELECT c_custkey, {hmac_sql('c_name', b'key', 20)} AS author_key FROM customer")
def hmacs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").select("c_custkey", privacy.pseudonymize_value(F.col("c_name"), b"key").alias("author_key"))


# votes and consensus

@query("weighted_vote", f"""WITH {V.VOTES_SQL}, s AS (SELECT id, sentiment_label, sum(confidence_score * weight) AS score FROM votes GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, sentiment_label) AS n, sum(score) OVER (PARTITION BY id) AS total FROM s)
SELECT id, sentiment_label, round(CASE WHEN total > 0 THEN score / total ELSE 0 END, 9) AS agreement_ratio, round(1 - CASE WHEN total > 0 THEN score / total ELSE 0 END, 9) AS discordance_score FROM r WHERE n = 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.weighted_majority_vote(V.votes(spark, sf_dir)))


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus_frame(V.raters(spark, sf_dir), RATERS)


@query("consensus_frame", f"WITH {V.VALID_SQL} SELECT id, votes_negativo, votes_neutro, votes_positivo, top_votes, consensus_level, consensus_label, polarity_conflict FROM consensus")
def consensus_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).select("id", "votes_negativo", "votes_neutro", "votes_positivo", "top_votes", "consensus_level", "consensus_label", "polarity_conflict")


@query("consensus_levels", f"WITH {V.VALID_SQL}, l(consensus_level) AS (VALUES ('unanimidade'), ('maioria'), ('pluralidade'), ('empate')), c AS (SELECT l.consensus_level, count(c.id) AS n FROM l LEFT JOIN consensus c USING (consensus_level) GROUP BY 1) SELECT consensus_level, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share FROM c")
def consensus_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.consensus_levels(_consensus(spark, sf_dir)))


@query("consensus_by_class", f"WITH {V.VALID_SQL} SELECT consensus_label AS label, count(*) FILTER (consensus_level = 'unanimidade') AS unanimidade, count(*) FILTER (consensus_level = 'maioria') AS maioria, count(*) FILTER (consensus_level = 'pluralidade') AS pluralidade, count(*) FILTER (consensus_level = 'empate') AS empate, count(*) AS n, round(count(*) FILTER (consensus_level = 'unanimidade')::DOUBLE / count(*), 9) AS unanimity_rate FROM consensus GROUP BY 1")
def consensus_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.consensus_by_class(_consensus(spark, sf_dir)))


@query("disputed", f"WITH {V.VALID_SQL} SELECT id, consensus_level, polarity_conflict, top_votes FROM consensus WHERE consensus_level <> 'unanimidade' ORDER BY polarity_conflict DESC, top_votes, id LIMIT 50")
def disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.disputed(_consensus(spark, sf_dir)).select("id", "consensus_level", "polarity_conflict", "top_votes")


_PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS rater_a, '{b}' AS rater_b, label_{a} AS la, label_{b} AS lb FROM valid" for i, a in enumerate(RATERS) for b in RATERS[i + 1 :])


@query("pairwise_kappa", f"""WITH {V.VALID_SQL}, p AS ({_PAIR_SQL}), n AS (SELECT rater_a, rater_b, count(*) AS n, sum((la = lb)::INT)::DOUBLE / count(*) AS po FROM p GROUP BY ALL),
a AS (SELECT rater_a, rater_b, la AS l, count(*) AS na FROM p GROUP BY ALL), b AS (SELECT rater_a, rater_b, lb AS l, count(*) AS nb FROM p GROUP BY ALL),
c AS (SELECT a.rater_a, a.rater_b, sum(na * nb)::DOUBLE AS ch FROM a JOIN b USING (rater_a, rater_b, l) GROUP BY ALL)
SELECT n.rater_a, n.rater_b, n.n, round(po, 9) AS agreement_rate, round((po - ch / (n.n::DOUBLE * n.n)) / (1 - ch / (n.n::DOUBLE * n.n)), 9) AS kappa FROM n JOIN c USING (rater_a, rater_b)""")
def pairwise_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.kappa_of_cells(C.rater_cells(_consensus(spark, sf_dir), RATERS), ["rater_a", "rater_b"]))


@query("fleiss_krippendorff", f"""WITH {V.VALID_SQL}, s AS (SELECT count(*) AS n, avg((v0 * (v0 - 1) + v1 * (v1 - 1) + v2 * (v2 - 1)) / 12.0::DOUBLE) AS po, sum(v0)::DOUBLE AS a, sum(v1)::DOUBLE AS b, sum(v2)::DOUBLE AS c, avg((top_votes = 4)::INT) AS u FROM consensus),
e AS (SELECT *, (a * a + b * b + c * c) / ((n * 4.0::DOUBLE) * (n * 4.0::DOUBLE)) AS pe, (a * (a - 1) + b * (b - 1) + c * (c - 1)) / ((n * 4.0::DOUBLE) * (n * 4.0::DOUBLE - 1)) AS ex FROM s)
SELECT n, round((po - pe) / (1 - pe), 9) AS fleiss_kappa, round(1 - (1 - po) / (1 - ex), 9) AS krippendorff_alpha, round(u, 9) AS unanimity_rate FROM e""")
def fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fleiss_and_alpha(_consensus(spark, sf_dir), len(RATERS)))


# two sources compared

def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_frame(V.raters(spark, sf_dir), "hf", "oa")


@query("comparison_frame", f"WITH {V.COMPARISON_SQL} SELECT id, label_a, label_b, agree, label_distance, min_confidence FROM frame")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir).select("id", "label_a", "label_b", "agree", "label_distance", "min_confidence")


@query("class_distribution", f"WITH {V.COMPARISON_SQL}, g AS (SELECT m.model, c.label FROM (VALUES ('a'), ('b')) m(model), (VALUES ('negativo'), ('neutro'), ('positivo')) c(label)), x AS (SELECT 'a' AS model, label_a AS label FROM frame UNION ALL SELECT 'b', label_b FROM frame), n AS (SELECT g.model, g.label, count(x.label) AS n FROM g LEFT JOIN x USING (model, label) GROUP BY ALL) SELECT model, label, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY model), 9) AS proportion FROM n")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.class_distribution(_frame(spark, sf_dir)))


@query("agreement_matrix", f"WITH {V.COMPARISON_SQL} SELECT label_a, count(*) FILTER (label_b = 'negativo') AS negativo, count(*) FILTER (label_b = 'neutro') AS neutro, count(*) FILTER (label_b = 'positivo') AS positivo FROM frame GROUP BY 1")
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.agreement_matrix(_frame(spark, sf_dir))


@query("transitions", f"WITH {V.COMPARISON_SQL} SELECT label_a, label_b, count(*) AS n, round(avg(confidence_a), 9) AS mean_confidence_a, round(avg(confidence_b), 9) AS mean_confidence_b, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM frame WHERE NOT agree GROUP BY 1, 2")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.transitions(_frame(spark, sf_dir)))


@query("transition_examples", f"WITH {V.COMPARISON_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_a, label_b ORDER BY min_confidence DESC, id) AS INTEGER) AS rank FROM frame WHERE NOT agree) SELECT label_a, label_b, rank, id FROM r WHERE rank <= 3")
def transition_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transition_examples(_frame(spark, sf_dir)).select("label_a", "label_b", "rank", "id")


@query("top_divergences", f"WITH {V.COMPARISON_SQL} SELECT id, label_distance, min_confidence FROM frame WHERE NOT agree ORDER BY label_distance DESC, min_confidence DESC, id LIMIT 50")
def top_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_divergences(_frame(spark, sf_dir)).select("id", "label_distance", "min_confidence")


@query("confidence_conflicts", f"WITH {V.COMPARISON_SQL} SELECT id, round(abs(confidence_a - confidence_b), 9) AS gap, CASE WHEN confidence_a > confidence_b THEN 'a' ELSE 'b' END AS more_confident FROM frame WHERE (confidence_a >= 0.8 AND confidence_b <= 0.5) OR (confidence_b >= 0.8 AND confidence_a <= 0.5)")
def confidence_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.confidence_conflicts(_frame(spark, sf_dir)).select("id", "gap", "more_confident"))


@query("ambiguous_cases", f"WITH {V.COMPARISON_SQL}, k AS (SELECT CASE WHEN confidence_a < 0.5 AND confidence_b < 0.5 THEN 'ambos_incertos' WHEN confidence_a < 0.5 THEN 'primario_incerto' WHEN confidence_b < 0.5 THEN 'referencia_incerta' WHEN NOT agree THEN 'divergencia_confiante' END AS case_type FROM frame), g AS (SELECT case_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS proportion FROM k GROUP BY 1) SELECT * FROM g WHERE case_type IS NOT NULL")
def ambiguous_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.ambiguous_cases(_frame(spark, sf_dir)))


def _band_sql(c: str) -> str:
    edges = C.BAND_EDGES
    return "CASE " + " ".join(f"WHEN {c} >= {lo} AND {c} {'<' if hi < 1 else '<='} {hi} THEN '{lo:.2f}–{hi:.2f}'" for lo, hi in zip(edges, edges[1:], strict=False)) + " END"


@query("confidence_bands", f"WITH {V.COMPARISON_SQL}, x AS (SELECT 'a' AS model, {_band_sql('confidence_a')} AS band, agree FROM frame UNION ALL SELECT 'b', {_band_sql('confidence_b')}, agree FROM frame) SELECT model, band, count(*) AS n, round(avg(agree::INT), 9) AS agreement_rate FROM x GROUP BY 1, 2")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.agreement_by_band(_frame(spark, sf_dir)))


@query("band_grid", f"WITH {V.COMPARISON_SQL} SELECT {_band_sql('confidence_a')} AS band_a, {_band_sql('confidence_b')} AS band_b, count(*) AS n, round(avg(agree::INT), 9) AS agreement_rate FROM frame GROUP BY 1, 2")
def band_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.agreement_by_band_pair(_frame(spark, sf_dir)))


@query("confidence_summary", f"WITH {V.COMPARISON_SQL}, x AS (SELECT 'a' AS model, confidence_a AS c, agree FROM frame UNION ALL SELECT 'b', confidence_b, agree FROM frame) SELECT model, round(avg(c), 9) AS mean, round(stddev_samp(c), 9) AS std, round(quantile_cont(c, 0.5), 9) AS median, round(avg(c) FILTER (agree), 9) AS mean_agree, round(avg(c) FILTER (NOT agree), 9) AS mean_diverge FROM x GROUP BY 1")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.confidence_summary(_frame(spark, sf_dir)))


# classification metrics

_CLASS_SQL = """c AS (SELECT {by} y_true, {p} AS y_pred, count(*)::DOUBLE AS n FROM preds GROUP BY ALL),
s AS (SELECT {by} label, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (SELECT {by} y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS s, 0 AS p FROM c UNION ALL SELECT {by} y_pred, 0, 0, n FROM c) GROUP BY ALL),
k AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision_, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall_, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1_ FROM s)"""


@query("confusion", f"WITH {V.PREDS_SQL} SELECT y_true, pred_a AS y_pred, count(*) AS n FROM preds GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(V.predictions(spark, sf_dir), [], pred="pred_a")


@query("per_class_report", f"WITH {V.PREDS_SQL}, {_CLASS_SQL.format(by='', p='pred_a')} SELECT label, round(precision_, 9) AS precision, round(recall_, 9) AS recall, round(f1_, 9) AS f1, CAST(support AS BIGINT) AS support FROM k")
def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.per_class(M.confusion(V.predictions(spark, sf_dir), [], pred="pred_a"), []))


_METRIC_SQL = """, m AS (SELECT {by} sum(tp) AS hit, sum(support) AS n, sum(support * predicted) AS x, sum(support * support) AS tt, sum(predicted * predicted) AS pp, avg(f1_) AS f1_macro, avg(precision_) AS precision_macro, avg(recall_) AS recall_macro, sum(f1_ * support) / sum(support) AS f1_weighted FROM k GROUP BY ALL)
SELECT {by} CAST(n AS BIGINT) AS n, round(hit / n, 9) AS accuracy, round(f1_macro, 9) AS f1_macro, round(precision_macro, 9) AS precision_macro, round(recall_macro, 9) AS recall_macro, round(f1_weighted, 9) AS f1_weighted, round(CASE WHEN (n * n - pp) * (n * n - tt) > 0 THEN (hit * n - x) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0 END, 9) AS mcc FROM m"""


@query("classification_metrics", f"WITH {V.PREDS_SQL}, {_CLASS_SQL.format(by='', p='pred_a')}{_METRIC_SQL.format(by='')}")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.classification_metrics(M.confusion(V.predictions(spark, sf_dir), [], pred="pred_a"), []))


@query("slice_metrics", f"WITH {V.PREDS_SQL}, {_CLASS_SQL.format(by='slice,', p='pred_b')}{_METRIC_SQL.format(by='slice,')}")
def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.classification_metrics(M.confusion(V.predictions(spark, sf_dir), ["slice"], pred="pred_b"), ["slice"]))


@query("roc_pr_auc", f"""WITH {V.PREDS_SQL}, g AS (SELECT round(p0, 12) AS s, sum((y_true = 'A')::INT)::DOUBLE AS p, count(*)::DOUBLE AS c FROM preds GROUP BY 1),
w AS (SELECT *, sum(p) OVER o AS tp, sum(c) OVER o AS k, sum(p) OVER () AS P_, sum(c - p) OVER () AS N_ FROM g WINDOW o AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum((c - p) * (tp - p / 2.0::DOUBLE)) / max(P_ * N_), 9) AS roc_auc, round(sum(p / P_ * tp / k), 9) AS average_precision FROM w""")
def roc_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.roc_auc(V.predictions(spark, sf_dir), F.round("p0", 12), F.col("y_true") == "A"))


@query("brier_nll", f"""WITH {V.PREDS_SQL} SELECT round(avg(((y_true = 'A')::INT - p0) ** 2 + ((y_true = 'N')::INT - p1) ** 2 + ((y_true = 'R')::INT - p2) ** 2), 9) AS brier, round(avg(-ln(greatest(1e-12, CASE y_true WHEN 'A' THEN p0 WHEN 'N' THEN p1 ELSE p2 END))), 9) AS nll FROM preds""")
def brier_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y_true")
    scores = {"A": F.col("p0"), "N": F.col("p1"), "R": F.col("p2")}
    own = F.when(y == "A", F.col("p0")).when(y == "N", F.col("p1")).otherwise(F.col("p2"))
    return rounded(V.predictions(spark, sf_dir).agg(F.avg(M.brier(scores, y)).alias("brier"), F.avg(M.negative_log_likelihood(own)).alias("nll")))


_REL_SQL = f"{V.PREDS_SQL}, t AS (SELECT CAST(greatest(0, least(9, ceil(round(confidence * 10, 9)) - 1)) AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg((y_true = pred_a)::INT) AS accuracy FROM preds GROUP BY 1)"


@query("reliability", f"WITH {_REL_SQL} SELECT bin, n, {r9('mean_confidence', 'accuracy')} FROM t")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reliability(V.predictions(spark, sf_dir), F.col("confidence"), F.col("y_true") == F.col("pred_a")))


@query("expected_calibration_error", f"WITH {_REL_SQL} SELECT round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 9) AS ece FROM t")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.expected_calibration_error(M.reliability(V.predictions(spark, sf_dir), F.col("confidence"), F.col("y_true") == F.col("pred_a"))))


@query("abstention", f"WITH {V.PREDS_SQL} SELECT round(avg((confidence >= 0.5)::INT), 9) AS coverage, count(*) FILTER (confidence >= 0.5) AS answered, round(avg((y_true = pred_a)::INT) FILTER (confidence >= 0.5), 9) AS accuracy_answered, round(avg((y_true = pred_a)::INT) FILTER (NOT confidence >= 0.5), 9) AS accuracy_abstained, round(avg((y_true = pred_a)::INT), 9) AS accuracy_all FROM preds")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.abstention(V.predictions(spark, sf_dir), F.col("confidence"), F.col("y_true") == F.col("pred_a"), 0.5))


@query("mcnemar_cells", f"""WITH {V.PREDS_SQL}, x AS (SELECT count(*) FILTER (y_true = pred_a AND y_true = pred_b) AS "both", count(*) FILTER (y_true = pred_a AND y_true <> pred_b) AS a_only, count(*) FILTER (y_true <> pred_a AND y_true = pred_b) AS b_only, count(*) FILTER (y_true <> pred_a AND y_true <> pred_b) AS neither FROM preds)
SELECT *, round((a_only + 0.5::DOUBLE) / (b_only + 0.5::DOUBLE), 9) AS odds_ratio, round((a_only - b_only)::DOUBLE / ("both" + a_only + b_only + neither), 9) AS accuracy_difference FROM x""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mcnemar_cells(V.predictions(spark, sf_dir), F.col("y_true"), F.col("pred_a"), F.col("pred_b")))


# sampling and leakage

@query("random_subset", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.random_subset(V.table(spark, sf_dir, "orders").select("o_orderkey"), sample_size=500, id_column="o_orderkey")


_RANK_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS h, count(*) OVER () AS total FROM orders)"


@query("stratified_subset", f"WITH {_RANK_SQL} SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= least(greatest(1, round_even(h * (500.0::DOUBLE / total), 0)), h)")
def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_subset(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), stratify_column="o_orderpriority", sample_size=500, id_column="o_orderkey")


@query("stratified_split", f"WITH {_RANK_SQL}, q AS (SELECT *, round_even(h * 0.2::DOUBLE, 0) AS t, round_even(h * 0.1::DOUBLE, 0) AS v FROM r) SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= t THEN 'teste' WHEN rn <= t + v THEN 'validacao' ELSE 'treino' END AS split FROM q")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), label_column="o_orderpriority", id_column="o_orderkey")


def _split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("k"))
    return d.withColumn("split", F.when(F.col("id") % 10 < 2, "teste").when(F.col("id") % 10 < 3, "validacao").otherwise("treino"))


_SPLIT_SQL = "s AS (SELECT doc_id AS id, md5(text) AS k, CASE WHEN doc_id % 10 < 2 THEN 'teste' WHEN doc_id % 10 < 3 THEN 'validacao' ELSE 'treino' END AS split FROM documents)"


@query("leakage_audit", f"WITH {_SPLIT_SQL}, p(source, target) AS (VALUES ('treino', 'teste'), ('treino', 'validacao'), ('validacao', 'teste')), x AS (SELECT p.source, p.target, count(*) AS n_target, count(*) FILTER (EXISTS (SELECT 1 FROM s b WHERE b.split = p.source AND b.k = a.k)) AS n_leaked FROM p JOIN s a ON a.split = p.target GROUP BY 1, 2) SELECT *, round(n_leaked::DOUBLE / n_target, 9) AS share FROM x")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.leakage_audit(_split_docs(spark, sf_dir), key="k"))


@query("cross_split_dedup", f"WITH {_SPLIT_SQL} SELECT id, split FROM s a WHERE split = 'teste' OR (split = 'validacao' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.split = 'teste')) OR (split = 'treino' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.split <> 'treino'))")
def cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.remove_cross_split_duplicates(_split_docs(spark, sf_dir), key="k").select("id", "split")


_SHARE_SQL = """(('0x' || substr(md5('42:' || CAST("group" AS VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"""


@query("grouped_split", f"""WITH {V.PREDS_SQL} SELECT id, "group", y_true, CASE WHEN {_SHARE_SQL} < 0.2 THEN 'teste' WHEN {_SHARE_SQL} < 0.2::DOUBLE + 0.1::DOUBLE THEN 'validacao' ELSE 'treino' END AS split FROM preds""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.predictions(spark, sf_dir).select("id", "group", "y_true")
    return S.grouped_split(t, group_column="group")


# features

_TERMS_SQL = r"docs AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), t AS (SELECT id, unnest(w) AS term FROM docs), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("terms"))


@query("vocabulary", f"WITH {_TERMS_SQL}, d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), k AS (SELECT * FROM d WHERE df >= 3 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM docs) ORDER BY df DESC, term LIMIT 20000) SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS \"index\" FROM k")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _terms(spark, sf_dir)
    return X.vocabulary(X.term_counts(docs), docs.count())


@query("tfidf_long", f"WITH {_TERMS_SQL}, d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM docs), k AS (SELECT * FROM d, n WHERE df >= 3 AND df <= 0.95::DOUBLE * n ORDER BY df DESC, term LIMIT 20000) SELECT id, term, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 9) AS tfidf_weight FROM c JOIN k USING (term)")
def tfidf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.tfidf(_terms(spark, sf_dir)))


def _document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of words of whole documents, by the tokeniser with slang and negation."""
    terms = text.bound(text.tokenize_and_normalize(F.col("text")), lambda t: X.ngrams(t, (1, 2)))
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), terms.alias("terms"))


@query("vocabulary_documents")
def vocabulary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _document_terms(spark, sf_dir)
    return X.vocabulary(X.term_counts(docs), V.table(spark, sf_dir, "documents").count())


@query("tfidf_documents")
def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.tfidf(_document_terms(spark, sf_dir)))


@query("ngrams_top")
def ngrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = _document_terms(spark, sf_dir).select(F.explode("terms").alias("term"))
    return grams.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(100)


@query("embedding_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm FROM embeddings")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.table(spark, sf_dir, "embeddings").select("vec_id", X.vector_norm(F.col("embedding")).alias("norm")))


_LONG_SQL = "x AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("feature_statistics", f"WITH {_LONG_SQL} SELECT feature, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, round(min(x), 9) AS min, round(max(x), 9) AS max, round(avg((x = 0)::INT), 9) AS zero_ratio FROM x GROUP BY 1")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.feature_statistics(V.table(spark, sf_dir, "embeddings"), "embedding"))


@query("target_correlation", f"WITH {_LONG_SQL} SELECT feature, round(corr(x, label::DOUBLE), 9) AS correlation FROM x GROUP BY 1")
def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.target_correlation(V.table(spark, sf_dir, "embeddings"), "embedding", F.col("label")))


@query("feature_correlation", "WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings) SELECT 0 AS a, 1 AS b, round(corr(a, b), 9) AS correlation FROM e UNION ALL SELECT 0, 2, round(corr(a, c), 9) FROM e UNION ALL SELECT 1, 2, round(corr(b, c), 9) FROM e")
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.correlation_pairs(V.table(spark, sf_dir, "embeddings"), "embedding", [0, 1, 2]))


@query("feature_correlation_all", f"WITH {_LONG_SQL} SELECT p.feature AS a, q.feature AS b, round(corr(p.x, q.x), 9) AS correlation FROM x p JOIN x q ON p.vec_id = q.vec_id AND p.feature < q.feature GROUP BY 1, 2")
def feature_correlation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.all_correlation_pairs(V.table(spark, sf_dir, "embeddings"), "embedding"))


@query("neuron_topk", f"WITH {_LONG_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY x DESC, vec_id) AS INTEGER) AS rank FROM x WHERE x > 0) SELECT feature, rank, vec_id FROM r WHERE rank <= 10")
def neuron_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_activations(V.table(spark, sf_dir, "embeddings"), "embedding", k=10, id_column="vec_id").select("feature", "rank", "vec_id")


@query("separation_scores", f"WITH {_LONG_SQL} SELECT feature, round(avg(label::DOUBLE) FILTER (x > 0) - avg(label::DOUBLE) FILTER (x <= 0), 9) AS separation FROM x GROUP BY 1")
def separation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.separation_scores(V.table(spark, sf_dir, "embeddings"), "embedding", F.col("label")))


# labels, errors, gold references and targets

@query("lexical_labels", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({L.POSITIVE_WORDS}, x))) AS p, len(list_filter(w, lambda x: list_contains({L.NEGATIVE_WORDS}, x))) AS n FROM w)
SELECT doc_id, CASE WHEN p > n THEN 'positivo' WHEN n > p THEN 'negativo' ELSE 'neutro' END AS label, round(CASE WHEN p + n = 0 THEN 0.0 WHEN p = n THEN 0.5 ELSE greatest(p, n)::DOUBLE / (p + n) END, 9) AS confidence FROM c""")
def lexical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.lexical_label(F.col("text"))
    return rounded(V.table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.label", F.col("x.confidence").cast("double").alias("confidence")))


@query("label_responses", f"WITH {V.RATERS_SQL} SELECT id, label_oa AS label, round(confidence_oa, 3) AS confidence FROM raters")
def label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.format_string('answer: {"label": "%s", "confidence": %.3f}', F.upper("label_oa"), F.col("confidence_oa"))
    return V.raters(spark, sf_dir).select("id", L.parse_label_response(raw).alias("x")).select("id", "x.label", "x.confidence")


_SOURCE_SQL = "CASE WHEN label_oa = label_c AND label_hf = label_c THEN 'acerto' WHEN label_oa = label_c THEN 'erro_do_rotulo_de_treino' WHEN label_hf = label_c THEN 'erro_do_modelo' WHEN label_oa = label_hf THEN 'modelo_reproduz_rotulo_errado' ELSE 'ambos_errados_e_discordam' END"


@query("error_sources", f"WITH {V.VALID_SQL}, c AS (SELECT {_SOURCE_SQL} AS source, count(*) AS n FROM valid GROUP BY 1) SELECT source, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share FROM c")
def error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.error_sources(_consensus(spark, sf_dir), [], "label_hf", "label_oa", "label_c"))


@query("top_errors", f"WITH {V.PREDS_SQL}, r AS (SELECT slice, id, CAST(row_number() OVER (PARTITION BY slice ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM preds WHERE y_true <> pred_a) SELECT * FROM r WHERE rank <= 50")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.predictions(spark, sf_dir).withColumnRenamed("pred_a", "y_pred")
    return E.top_errors(p, category="slice", confidence="confidence").select("slice", "id", "rank")


@query("length_slices", f"WITH {V.RATERS_SQL}, e AS (SELECT quantile_cont(word_count, 1.0 / 3) AS lo, quantile_cont(word_count, 2.0 / 3) AS hi FROM raters) SELECT CASE WHEN word_count <= lo THEN '1_curto' WHEN word_count <= hi THEN '2_medio' ELSE '3_longo' END AS slice, count(*) AS n FROM raters, e GROUP BY 1")
def length_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.raters(spark, sf_dir)
    return r.groupBy(E.length_slice(F.col("word_count"), E.length_edges(r, F.col("word_count"))).alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query("gold_references", f"WITH {V.RATERS_SQL}, a AS (SELECT CAST(id AS VARCHAR) AS id, label_hf AS label FROM raters WHERE label_hf <> 'indefinido'), b AS (SELECT CAST(id AS VARCHAR) AS id, label_oa AS label FROM raters) SELECT 'gold_a' AS reference, id, label FROM a UNION ALL SELECT 'gold_b', id, label FROM b UNION ALL SELECT 'consenso_gold', a.id, a.label FROM a JOIN b USING (id, label)")
def gold_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.raters(spark, sf_dir)
    return E.gold_references({"gold_a": r.select("id", F.col("label_hf").alias("sentiment_label")), "gold_b": r.select("id", F.col("label_oa").alias("sentiment_label"))}, C.CLASSES)


@query("disagreement_target", f"WITH {V.VALID_SQL} SELECT id, CAST(NOT (label_hf = label_oa AND label_oa = label_c) AS INTEGER) AS target FROM valid")
def disagreement_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.disagreement_target(_consensus(spark, sf_dir), ["label_hf", "label_oa", "label_c"])


@query("flag_anomalies", f"WITH {V.PREDS_SQL}, e AS (SELECT quantile_cont(confidence, 0.95) AS edge FROM preds) SELECT id FROM preds, e WHERE confidence > edge")
def flag_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.flag_anomalies(V.predictions(spark, sf_dir), "confidence", 95).where("is_anomaly").select("id")


@query("risk_coverage", f"""WITH {V.PREDS_SQL}, g AS (SELECT confidence AS c, sum((y_true = pred_a)::INT)::DOUBLE AS hit, count(*) AS n FROM preds GROUP BY 1), w AS (SELECT *, sum(n) OVER o AS upto, sum(hit) OVER o AS hits, sum(n) OVER () AS total FROM g WINDOW o AS (ORDER BY c DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(1, ceil(round(coverage * total, 6))) AS kept FROM w, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(coverage))
SELECT coverage, CAST(kept AS BIGINT) AS n_kept, round(c, 9) AS threshold, round((hits - hit + (kept - upto + n) * hit / n) / kept, 9) AS accuracy FROM k WHERE upto >= kept AND upto - n < kept""")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.risk_coverage(V.predictions(spark, sf_dir), "confidence", F.col("y_true") == F.col("pred_a"), (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)))


@query("annotation_cross", "SELECT b.item_id, c.concept, position(c.concept IN lower(b.text)) > 0 AS present FROM benchmark b, (VALUES ('the'), ('ing'), ('xyz')) c(concept)")
def annotation_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.explode(F.array(F.lit("the"), F.lit("ing"), F.lit("xyz")))
    b = V.table(spark, sf_dir, "benchmark").select("item_id", "text", concept.alias("concept"))
    return b.select("item_id", "concept", F.contains(F.lower("text"), F.col("concept")).alias("present"))


@query("weighted_label_scores", f"WITH {V.VOTES_SQL} SELECT id, sentiment_label, round(sum(confidence_score * weight), 9) AS score FROM votes GROUP BY ALL")
def weighted_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.weighted_label_scores(V.votes(spark, sf_dir)))


@query("latency_statistics", "SELECT round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM events")
def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda x: F.percentile("value", F.lit(x))
    return rounded(V.table(spark, sf_dir, "events").agg(F.avg("value").alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99")))


@query("naive_bayes")
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annolytics.operators import models

    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id")
    d = d.select(F.col("doc_id").alias("id"), "text", F.when(F.col("toxic") == 1, "negativo").when(F.col("quality") == 1, "positivo").otherwise("neutro").alias("sentiment_label"))
    split = S.stratified_split(d, label_column="sentiment_label")
    return rounded(models.evaluate(split.where("split = 'treino'"), split.where("split = 'teste'"), "naive_bayes", C.CLASSES))
