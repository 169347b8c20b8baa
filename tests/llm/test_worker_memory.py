import pandas as pd

from annolytics.llm import bpe, tables, textnum, toxicity


def test_batches_of_whole_texts_are_bounded(shared, make):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    shared.conf.unset(key)
    docs = make([(i, "w" * 1_000_000) for i in range(24)]).coalesce(1)

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [int(f["text"].str.len().sum())]})

    with tables.scratch(shared):
        assert max(r.n for r in docs.mapInPandas(sizes, "n long").collect()) <= tables.BATCH_BYTES + 1_000_000
    shared.conf.set(key, "1024")  # a session's own smaller bound stays
    tables.small_batches(shared)
    assert shared.conf.get(key) == "1024"
    shared.conf.unset(key)
    toxicity.scored(docs, toxicity.fit([], [], pd.Series([], dtype=int).to_numpy()))
    assert int(shared.conf.get(key)) == tables.BATCH_BYTES


def test_an_operators_tasks_drop_what_others_keep_in_a_worker():
    bpe._ENCODERS["x"] = None
    textnum.powers(10)
    list(textnum.tidy(iter)([1]))
    assert not bpe._ENCODERS and not textnum._powers
