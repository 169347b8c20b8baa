from pyspark.sql import functions as F

from annolytics.operators import joins as J


def test_numbers_are_whole_where_partitions_are_put_together(spark):
    """Counts and rows, computed apart, agree on ranges though they differ in columns and so in bytes."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.range(40_000).repartition(7).select(((F.col("id") * 7919) % 40_000 * 3).alias("line"), F.sha2(F.col("id").cast("string"), 512).alias("author"))
        got = J.numbered(df, "line").select("line", "row_number").collect()
        keys = J.author_keys(df, key=b"k", author_column="author", order="line").agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.row_number for r in got) == list(range(1, 40_001)) and all(r.line == 3 * (r.row_number - 1) for r in got)
    assert tuple(keys) == (40_000, 40_000, "t0000001", "t0040000")


def test_numbers_of_texts_nulls_and_nothing(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "é", "", "a", "\U0001f600", "z"]], "line string")
    got = {r.line: r.row_number for r in J.numbered(df, "line").collect()}
    assert got == {"": 1, "a": 2, "b": 3, "z": 4, "é": 5, "\U0001f600": 6, None: 7}
    assert J.numbered(df.where("false"), "line").collect() == [] and J.numbered(df.where("line is null"), "line").first().row_number == 1
