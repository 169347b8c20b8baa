import numpy as np

import corpus_pipeline
from annolytics.llm import bpe, queries, textnum


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_stages_begin_with_heaps_handed_back(shared, make):
    before = collections(shared)
    corpus_pipeline.mix_sources(shared, make([(1, "a b c")]), "")
    assert collections(shared) > before


def test_chunks_are_merged_a_bounded_number_at_a_time(monkeypatch):
    one = bpe.ChunkEncoder(queries.tokenizer_path())
    text = " ".join(f"w{i}x" for i in range(40_000))
    wanted = np.array(one.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    sizes, merged = [], one.merged
    monkeypatch.setattr(one, "merged", lambda words: sizes.append(len(words)) or merged(words))
    assert b"".join(one.encode([text])) == wanted
    assert sum(sizes) == 40_000 and max(sizes) <= 1 << 14


def test_packing_keeps_its_encoder_and_bounds_its_batches(shared, make):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    shared.conf.unset(key)
    docs = make([(i, "word " * 10) for i in range(8)])
    assert corpus_pipeline.packing.pieces(docs, tokenizer=queries.tokenizer_path()).count() == 8
    assert int(shared.conf.get(key)) == 4 << 20
    other: dict = {}
    bpe._ENCODERS["x"] = other["x"] = None
    textnum.CACHES.append(other)
    try:
        list(textnum.tidy(iter, bpe._ENCODERS)([1]))
        assert "x" in bpe._ENCODERS and not other
    finally:
        textnum.CACHES.remove(other)
        bpe._ENCODERS.clear()
