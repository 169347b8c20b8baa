"""Schema contracts: columns, types and one-pass row constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

CLASSES = ("negativo", "neutro", "positivo")


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    columns: dict[str, str]
    strict: bool = True
    unique: tuple[str, ...] = ()
    nullable: tuple[str, ...] = ()
    checks: dict[str, Column | str] = field(default_factory=dict)  # name -> condition that every row meets

    def validate(self, df: DataFrame) -> DataFrame:
        """df, or a ContractError that names all that is wrong; rows are read once."""
        types = dict(df.dtypes)
        wrong = [f"missing column {c}" for c in self.columns if c not in types]
        wrong += [f"{c} is {types[c]}, not {t}" for c, t in self.columns.items() if c in types and types[c] != t]
        wrong += [f"unexpected column {c}" for c in types if c not in self.columns] if self.strict else []
        if wrong:
            raise ContractError("; ".join(wrong))
        tests = {f"null {c}": F.count_if(F.col(c).isNull()) for c in self.columns if c not in self.nullable}
        tests |= {k: F.count_if(~F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(True))) for k, v in self.checks.items()}
        found = df.agg(*[v.alias(k) for k, v in tests.items()]).first().asDict()
        wrong = [f"{k}: {v} rows" for k, v in found.items() if v]
        for c in self.unique:
            if n := df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count():
                wrong.append(f"{n} values of {c} repeat")
        if wrong:
            raise ContractError("; ".join(wrong))
        return df


_IN_CLASSES = "sentiment_label in ('negativo', 'neutro', 'positivo')"
_COUNTS = ("like_count", "reply_count", "retweet_count", "quote_count")
RAW_TWEET = Contract(
    {"tweet_id": "string", "user_id": "string", "text": "string", "created_at": "timestamp", "language": "string", "is_reply": "boolean", "is_retweet": "boolean", **{c: "bigint" for c in _COUNTS}, "source_query": "string", "source_group": "string"},
    unique=("tweet_id",), nullable=("source_query", "source_group"), checks={c: f"{c} >= 0" for c in _COUNTS},
)
LABELED_CORPUS = Contract({"id": "string", "text": "string", "sentiment_label": "string"}, strict=False, unique=("id",), checks={"label": _IN_CLASSES})
LABELING_RESULT = Contract(
    {"id": "string", "tagger": "string", "sentiment_label": "string", "confidence_score": "double", "weight": "double"}, checks={"confidence": "confidence_score between 0 and 1", "weight": "weight > 0"}
)
TRAINING_EXAMPLE = Contract(
    {"id": "string", "text": "string", "sentiment_label": "string", "split": "string"}, unique=("id",), checks={"label": _IN_CLASSES, "split": "split in ('treino', 'validacao', 'teste')"}
)
PREDICTION = Contract({"id": "string", "text": "string", "sentiment_label": "string", "confidence_score": "double"}, strict=False, checks={"label": _IN_CLASSES, "confidence": "confidence_score between 0 and 1"})
LABELED_SOURCE = Contract(
    {"id": "string", "text": "string", "text_normalized": "string", "sentiment_label": "string", "confidence_score": "double"},
    unique=("id",), checks={"label": "sentiment_label in ('negativo', 'neutro', 'positivo', 'indefinido')"},
)
# Names of the metrics of a run.
METRICS = ("f1_macro", "mcc", "f1_weighted", "accuracy", "precision_macro", "recall_macro", "roc_auc_ovr", "pr_auc_ovr", "inference_time_ms", "computational_cost")
RUN_METRIC = Contract(
    {"run_id": "string", "model_name": "string", "metric_name": "string", "metric_value": "double", "git_sha": "string", "dataset_hash": "string"},
    checks={"metric": f"metric_name in {METRICS}"},
)
BINARY_TARGET = Contract({"id": "string", "target": "bigint"}, unique=("id",), checks={"target": "target in (0, 1)"})
CONTINUOUS_TARGET = Contract({"id": "string", "target": "double"}, unique=("id",), checks={"target": "target between 0 and 1"})


def model_columns(df: DataFrame) -> list[str]:
    """The columns of model labels, by their prefix."""
    return [c for c in df.columns if c.startswith("lab_")]


def validate_diagnostic_corpus(df: DataFrame) -> DataFrame:
    """id (unique), text_normalized, agreement_score in 0..1, gold_label (may be null) and one or more lab_ columns of known labels."""
    models = model_columns(df)
    if not models:
        raise ContractError("no lab_ column")
    known = {f"labels of {c}": f"`{c}` is null or `{c}` in {CLASSES}" for c in (*models, "gold_label")}
    columns = {"id": "string", "text_normalized": "string", "agreement_score": "double", "gold_label": "string", **dict.fromkeys(models, "string")}
    return Contract(columns, strict=False, unique=("id",), nullable=("gold_label", *models), checks={"agreement": "agreement_score between 0 and 1", **known}).validate(df)


def validate_label(label: str) -> str:
    if label not in CLASSES:
        raise ContractError(f"unknown label {label!r}")
    return label


def label_of_id(i: int) -> str:
    if not 0 <= i < len(CLASSES):
        raise ContractError(f"unknown label id {i}")
    return CLASSES[i]


def not_empty(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"{name} is empty")
    return df
