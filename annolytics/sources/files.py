"""Readers and writers: Parquet, CSV, raw batches, labelling checkpoints, gold sets and catalogs."""

from __future__ import annotations

import json
import time
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from annolytics import contracts
from annolytics.functions import privacy, text

# Spellings of the three classes in gold sets.
GOLD_ALIASES = {
    "pos": "positivo", "positive": "positivo", "positivo": "positivo", "neg": "negativo", "negative": "negativo", "negativo": "negativo",
    "neu": "neutro", "neutral": "neutro", "neutro": "neutro",
}


class DataError(ValueError):
    pass


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, *, mask_text: bool = False) -> None:
    (privacy.mask_text_columns(df) if mask_text else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    readers = {".parquet": read_parquet, ".csv": read_csv}
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in readers:
        raise DataError(f"no reader for {suffix!r}")
    return readers[suffix](spark, path)


def write_dataset(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise DataError("an empty dataset is not written")
    write_parquet(df, path)


def load_raw_batch(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a folder under the raw contract; tweet_id becomes id."""
    df = spark.read.parquet(path)
    try:
        contracts.RAW_TWEET.validate(df)
    except contracts.ContractError as e:
        raise DataError(str(e)) from e
    return df.withColumnRenamed("tweet_id", "id")


def normalize_gold_label(label):
    known = F.create_map(*[F.lit(x) for pair in GOLD_ALIASES.items() for x in pair])
    return F.element_at(known, F.lower(F.trim(label)))


def load_gold_set(df: DataFrame, *, text_column: str = "text_normalized", label_column: str = "sentiment_label", id_column: str = "id", ordinal: str | None = None) -> DataFrame:
    """id, text_normalized, sentiment_label: undefined and empty rows out, aliases mapped, the first row of an id kept."""
    missing = [c for c in (text_column, label_column, id_column) if c not in df.columns]
    if missing:
        raise DataError(f"missing columns {missing}")
    df = df.where(F.lower(F.trim(label_column)) != "indefinido")
    df = df.withColumns({"_label": normalize_gold_label(F.col(label_column)), "_text": text.sanitize_tweet_text(F.col(text_column))})
    if bad := [r[0] for r in df.where(F.col("_label").isNull()).select(label_column).distinct().limit(5).collect()]:
        raise DataError(f"unknown labels {bad}")
    first = F.row_number().over(W.partitionBy(id_column).orderBy(ordinal or "_text"))
    df = df.where(F.col("_text") != "").withColumn("_r", first).where("_r = 1")
    return df.select(F.col(id_column).cast("string").alias("id"), F.col("_text").alias("text_normalized"), F.col("_label").alias("sentiment_label"))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """id, sentiment_label, confidence_score of a JSON-lines checkpoint: bad lines skipped, the record of an id appended last wins.

    Records carry the sequence number of their append; those of one append, or without a number, are ordered by file and line.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.withColumn("r", F.from_json("value", "id string, sentiment_label string, confidence_score double, appended long")).where("r.id is not null and r.sentiment_label is not null")
    place = F.struct(F.coalesce("r.appended", F.lit(-1).cast("long")), "f", "at")
    return parsed.groupBy("r.id").agg(F.max_by("r", place).alias("r")).select("r.id", "r.sentiment_label", "r.confidence_score")


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Append records under the next sequence number (nanoseconds of the driver's clock, later than any that is there)."""
    spark = df.sparkSession
    try:
        held = spark.read.schema("appended long").json(path).agg(F.max("appended")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = 0
    df.select("id", "sentiment_label", "confidence_score", F.lit(max(held + 1, time.time_ns())).alias("appended")).write.mode("append").json(path)


def checkpoint_name(source: str, *, model_name: str, prompt_template: str, temperature: float) -> str:
    import hashlib

    digest = hashlib.sha256(f"{model_name}|{temperature}|{prompt_template}".encode()).hexdigest()[:12]
    return f"{source.replace(':', '_')}_{digest}.jsonl"


def dataset_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256, size_bytes of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def report_rows(df: DataFrame, limit: int) -> list:
    """The rows of a report table; more than `limit` are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise DataError(f"a report table of more than {limit} rows")
    return rows


def to_markdown(df: DataFrame, *, limit: int = 1000) -> str:
    """A report table; of more than `limit` rows it is refused."""
    rows = report_rows(df, limit)
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def to_latex(df: DataFrame, *, caption: str, label: str, limit: int = 1000) -> str:
    rows = report_rows(df, limit)
    escape = lambda v: ("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(map(escape, r)) + r" \\" for r in rows]
    head = [r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", " & ".join(map(escape, df.columns)) + r" \\", r"\midrule"]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def write_json(data, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)


def read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_labeled_corpus(df: DataFrame, path: str) -> None:
    write_dataset(contracts.LABELED_CORPUS.validate(df), path)


def write_training_examples(df: DataFrame, path: str) -> None:
    write_dataset(contracts.TRAINING_EXAMPLE.validate(df), path)


def load_labeled_corpus(spark: SparkSession, path: str) -> DataFrame:
    return contracts.LABELED_CORPUS.validate(read_dataset(spark, path))


def load_training_examples(spark: SparkSession, path: str) -> DataFrame:
    return contracts.TRAINING_EXAMPLE.validate(read_dataset(spark, path))


def save_model(model, path: str) -> None:
    """An MLlib model or pipeline model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def write_dataset_catalog(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def load_human_labels(df: DataFrame, classes: tuple[str, ...] = contracts.CLASSES, *, label_column: str = "sentiment_label") -> DataFrame:
    """Rows with a label, trimmed and lower-cased; other labels than the classes, or none at all, are errors."""
    out = df.withColumn(label_column, F.lower(F.trim(label_column))).where(F.col(label_column) != "")
    found = out.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(~F.col(label_column).isin(*classes), F.col(label_column))).alias("bad")).first()
    if found["bad"]:
        raise DataError(f"unknown labels {sorted(found['bad'])[:5]}")
    if not found["n"]:
        raise DataError("no human labels")
    return out


def write_labeling_sample(sample: DataFrame, key: DataFrame, *, sample_path: str, key_path: str) -> None:
    """Texts for raters, masked and without ids, and the key that leads back to them."""
    write_csv(sample.drop("id"), sample_path, mask_text=True)
    write_parquet(key, key_path)


AUTHOR_TABLE = "autores_pseudonimizados.parquet"


def write_author_keys(df: DataFrame, folder: str) -> str:
    path = f"{folder}/{AUTHOR_TABLE}"
    write_parquet(df.select("id", "author_key"), path)
    return path


def load_author_keys(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/{AUTHOR_TABLE}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise DataError(f"no author keys in {folder}: make them with joins.author_keys") from e


def load_labeled_source(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return contracts.LABELED_SOURCE.validate(spark.read.parquet(path))
    except contracts.ContractError:
        raise
    except Exception as e:
        raise DataError(f"no labelled base {name!r} at {path}") from e


class CompletionCache:
    """Completions by content address (model, prompt, options): a Parquet table, looked up by join; misses are appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema("key string, value string").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "key string, value string")

    def hits(self, df: DataFrame) -> DataFrame:
        """df (key, ...) with the value that is held, else null."""
        return df.join(self.read().dropDuplicates(["key"]), "key", "left")

    def add(self, df: DataFrame) -> None:
        """Append (key, value) rows whose key isn't held."""
        fresh = df.select("key", "value").where("value is not null").dropDuplicates(["key"]).join(self.read().select("key"), "key", "left_anti")
        fresh.write.mode("append").parquet(self.path)
