import time

from annolytics.llm import linededup
from annolytics.llm.tables import swept


def test_only_sets_to_verify_move(shared):
    """Sets are picked out by a bitmap of each side's nodes before the joins that verify pairs."""
    word = lambda *x: b"".join(w.to_bytes(8, "little") for w in x)
    sets = shared.createDataFrame([(1, bytearray(word(5, 6, 7, 8, 9))), (2, bytearray(word(5, 6, 7, 8))), (3, bytearray(word(1)))], "node long, elements binary")
    out = linededup.similar(shared.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), sets, 80)
    assert [(r.src, r.dst) for r in out.collect()] == [(1, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [seen(") >= 2


def test_shuffle_files_of_finished_steps_go(shared):
    disk = shared._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().size()
    swept(shared)
    time.sleep(1)
    before = files()
    shared.range(10_000).repartition(7, "id").write.format("noop").mode("overwrite").save()
    assert files() > before
    swept(shared)
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before
