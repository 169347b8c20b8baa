import numpy as np

from annolytics.llm import setsketch


def moved(spark, run):
    """Bytes of shuffle files that run() writes."""
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    before = stages()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


def test_texts_of_settled_documents_do_not_move(shared, make):
    """Kept and dropped documents are told apart where they lie: random texts of 4 MB, of which next to nothing is shuffled."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 60, 2500))
    rows = [(i, text()) for i in range(100)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(10)] + [(None, text()), (300, text()), (300, text()), (400, None)]
    held = shared.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shared.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, got = setsketch.kept_documents(make(rows)), []
        n = moved(shared, lambda: got.extend(kept.collect()))
    finally:
        shared.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    ids = [r.doc_id for r in got]
    assert sorted(-1 if i is None else i for i in ids) == sorted([*range(100), -1, 300, 400])
    of = dict(rows[:100])
    assert all(r.text == of[r.doc_id] for r in got if r.doc_id in of)
    assert n < 400_000
