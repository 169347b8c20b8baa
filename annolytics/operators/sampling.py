"""Seeded, order-independent samples and splits: rows are ranked by md5 of seed and id, so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DEFAULT_SEED = 42


def draw(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def random_subset(df: DataFrame, *, sample_size: int, id_column: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    return df.orderBy(draw(id_column, seed), id_column).limit(sample_size)


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the other columns of right, which has one row for each group of left, groups with null keys included."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = [left[c].eqNullSafe(named[f"_of_{c}"]) for c in by]
    return left.join(named, on).drop(*[f"_of_{c}" for c in by])


def ranked(df: DataFrame, by: list[str], id_column: str, seed: int) -> DataFrame:
    """df with _rank (from 1) and _size in each group; groups are counted by an aggregate, not by a window over their rows."""
    order = W.partitionBy(*by).orderBy(draw(id_column, seed), id_column)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    return null_safe_join(df.withColumn("_rank", F.row_number().over(order)), sizes, by)


def stratified_subset(df: DataFrame, *, stratify_column: str, sample_size: int, id_column: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    """min(max(1, round(h * fraction)), h) rows of each stratum of h rows, rounding half to even."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = ranked(df, [stratify_column], id_column, seed).crossJoin(F.broadcast(total))  # one row
    quota = F.least(F.greatest(F.lit(1), F.bround(F.col("_size") * (F.lit(float(sample_size)) / F.col("_total")))), F.col("_size"))
    return out.where(F.col("_rank") <= quota).drop("_rank", "_size", "_total")


def stratified_split(df: DataFrame, *, label_column: str, id_column: str = "id", test_size: float = 0.2, validation_size: float = 0.1, seed: int = DEFAULT_SEED, split_column: str = "split") -> DataFrame:
    """Per class round(n * test_size) rows to teste, round(n * validation_size) to validacao, the rest to treino."""
    if test_size + validation_size >= 1:
        raise ValueError("test and validation leave nothing to train on")
    test = F.least(F.bround(F.col("_size") * test_size), F.col("_size"))
    validation = F.least(F.bround(F.col("_size") * validation_size), F.col("_size") - test)
    name = F.when(F.col("_rank") <= test, "teste").when(F.col("_rank") <= test + validation, "validacao").otherwise("treino")
    return ranked(df, [label_column], id_column, seed).withColumn(split_column, name).drop("_rank", "_size")


def grouped_split(df: DataFrame, *, group_column: str, id_column: str = "id", test_size: float = 0.2, validation_size: float = 0.1, seed: int = DEFAULT_SEED, split_column: str = "split") -> DataFrame:
    """Whole groups to one split, by the group's hash; a null group is a group of its own row."""
    group = F.coalesce(F.col(group_column).cast("string"), F.concat(F.lit("row:"), F.col(id_column).cast("string")))
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn(split_column, F.when(share < test_size, "teste").when(share < test_size + validation_size, "validacao").otherwise("treino"))


def leakage_audit(df: DataFrame, *, key: str, split_column: str = "split") -> DataFrame:
    """source, target, n_target, n_leaked, share: rows of a target split whose key occurs in a source split; one pass over keys."""
    seen = df.groupBy(key).agg(*[F.count_if(F.col(split_column) == s).alias(s) for s in ("treino", "validacao", "teste")])
    parts = []
    for source, target in (("treino", "teste"), ("treino", "validacao"), ("validacao", "teste")):
        parts.append(F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.col(target).alias("n"), F.when(F.col(source) > 0, F.col(target)).otherwise(0).alias("leaked")))
    x = seen.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    out = x.groupBy("source", "target").agg(F.sum("n").alias("n_target"), F.sum("leaked").alias("n_leaked"))
    return out.withColumn("share", F.when(F.col("n_target") > 0, F.col("n_leaked") / F.col("n_target")).otherwise(0.0))


def remove_cross_split_duplicates(df: DataFrame, *, key: str, split_column: str = "split") -> DataFrame:
    """Without validation rows whose key is in teste, and treino rows whose key is in teste or validacao."""
    seen = df.groupBy(key).agg((F.count_if(F.col(split_column) == "teste") > 0).alias("_t"), (F.count_if(F.col(split_column) == "validacao") > 0).alias("_v"))
    s = F.col(split_column)
    return null_safe_join(df, seen, [key]).where((s == "teste") | ((s == "validacao") & ~F.col("_t")) | ((s == "treino") & ~F.col("_t") & ~F.col("_v"))).drop("_t", "_v")


def first_occurrences(df: DataFrame, *, key: str, ordinal: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(ordinal))).where("_r = 1").drop("_r")
