"""Tables written to the shared folder, to cut lineage and to read a result more than once."""

from __future__ import annotations

import contextlib
import gc
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolytics.session import shared_folder

#: White space of the word definition shared by all operators here.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths of the tables written since each open scratch() began.
_open: list[list[str]] = []


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """df, written once as Parquet to the cluster's shared folder and read back.

    Unlike a reliable checkpoint of a DataFrame it is computed once, compressed and columnar; like it, it survives lost executors.
    keep: the table outlives an open scratch().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/annolytics/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    trimmed(spark)
    return spark.read.schema(schema).parquet(path)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to the session's Python workers BATCH_BYTES at a time, or fewer where it asks for fewer.

    By number (10,000 rows) a batch of whole texts has tens of MB, which the JVM, the worker and its objects hold several times over.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):  # a Spark without such a bound
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark._jsparkSession.sessionState().conf().getConfString(key))
        if not 0 < held <= BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over: they stay on disk until the driver happens to collect its garbage."""
    for _ in range(2):  # the first only lets go of what holds them
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
    trimmed(spark)


def trimmed(spark: SparkSession) -> str:
    """Have the driver's JVM hand back memory outside its heap that it has freed; what it says of it, or nothing where it has no such command.

    The C library keeps freed memory for each of many threads: Spark starts one for each exchange, and code is compiled for each plan.
    """
    with contextlib.suppress(Exception):
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        named = jvm.java.lang.Class.forName

        def made(kind, *values):
            out = array(kind, len(values))
            for i, v in enumerate(values):
                out[i] = v
            return out

        # by reflection: the server's own class is hidden from callers
        kinds = made(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given, types = made(jvm.java.lang.Object, array(jvm.java.lang.String, 0)), made(jvm.java.lang.String, "[Ljava.lang.String;")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(invoke.invoke(server, made(jvm.java.lang.Object, commands, "systemTrimNativeHeap", given, types)))
    return ""


def shrunk(spark: SparkSession) -> None:
    """Have the driver and each executor collect their garbage and hand back the heap that they free.

    A heap stays as large as any step so far has made it, and the workers of the next step come on top of it.
    """
    spark._jvm.System.gc()
    trimmed(spark)
    n = spark.sparkContext.defaultParallelism  # a task a core, so that no executor goes without
    with contextlib.suppress(Exception):  # a session that allows no such call keeps its heaps
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those to keep: what leaves the block must not read any other."""
    _open.append([])
    small_batches(spark)
    try:
        yield
    finally:
        for path in _open.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
