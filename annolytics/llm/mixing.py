"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of all words. A target above max_epochs times the source's size is clamped there and the
excess goes to the others in proportion to their weights, until none is above. The fixed point has a closed form: with sources in
ascending order of cap/weight, the water level is (total - caps before) / (weights from here on) at the first source whose own
cap/weight is not below it; levels after it are never higher, so it is the highest such level. So the whole mix is one aggregate, windows over one row a source, and one join.

A document is taken floor(target/size) whole times; for the rest, documents come in the order of a seeded hash until the words run
out, the last one in part. The order needs no sort of a source: words are summed by hash bucket, and only documents in the one
bucket where the words run out are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annolytics.llm.tables import WORD, written

#: Leading hex digits of the hash that make a bucket: 65,536 buckets a source.
BUCKET_DIGITS = 4


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row a source with its target in words.

    sizes: (source, source_size), one row a source, null source allowed. Weights repeat over the sources in code-point order, null
    last. Returns source, source_size, target. The windows run over one row a source.
    """
    ordered = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = W.partitionBy()
    levels = (
        capped.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / F.col("open"))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce("water", F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, whole (times taken entire), extra (words taken once more) and taken.

    Null text: size 0. Null source: a source of its own, last. Repeated rows are documents of their own; rows of equal doc_id are
    ordered by size, so that reruns agree. An empty table gives an empty result; an input of no words has targets 0. Columns of the
    input that clash with those added here are replaced.
    """
    added = ("size", "source_size", "target", "whole", "extra", "taken", "_key", "_bucket")
    base = docs.drop(*added)
    # "~" can't start a real group: null and any source, "" included, stay apart in a join on plain equality.
    base = base.withColumns({
        "size": word_count(F.col("text")),
        "_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")),
    }).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = written(base.groupBy("source", "_bucket").agg(F.sum("size").alias("n")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights=weights, max_epochs=max_epochs)
    asked = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", asked - F.col("whole") * F.col("source_size"))
    # the bucket in which the rest runs out: the first whose words up to and with it reach the rest
    upto = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    cuts = (
        sums.withColumn("upto", F.sum("n").over(upto))
        .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
        .groupBy("source")
        .agg(F.min_by(F.struct(F.col("_bucket").alias("cut"), (F.col("upto") - F.col("n")).alias("before")), "_bucket").alias("c"))
    )
    plan = (
        plan.alias("p")
        .join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select(
            F.coalesce(F.concat(F.lit("="), F.col("p.source")), F.lit("~")).alias("_source"),
            "source_size", "target", "whole", "rest", F.coalesce("c.c.cut", F.lit("")).alias("_cut"), F.coalesce("c.c.before", F.lit(0)).alias("_before"),
        )
    )
    plan = written(plan, "mix-plan")  # a row a source: the planner sees its size, and broadcasts it only where small
    joined = base.join(plan, "_source")
    inside = F.col("_bucket") == F.col("_cut")
    sure = joined.where(~inside).withColumn("extra", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0).cast("long"))
    earlier = W.partitionBy("_source").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("_before") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    split = joined.where(inside).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    both = sure.unionByName(split).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    return both.drop("_key", "_bucket", "_source", "_cut", "_before", "rest")


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix as rows: each document its whole times, and once more where words of it are taken beyond; columns are those kept.

    Where that last time is partial (one document a source), its text is its first `extra` words joined by one space and n_chars
    is set anew.
    """
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    times = F.sequence(F.lit(1), (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int"))
    rows = mixed.where((F.col("whole") > 0) | (F.col("extra") > 0)).withColumn("_time", F.explode(times))
    cut = part & (F.col("_time") > F.col("whole"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("extra").cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes),
capped AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
plan AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 0.0) * weight) AS target
  FROM levels),
asked AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM plan),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM asked),
summed AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS rest,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM summed
"""
