import tracemalloc

import numpy as np

from annolytics.llm import tables, toxicity


def test_the_drivers_fit_counts_terms_in_small_blocks():
    rng = np.random.default_rng(3)
    words = [f"w{i:05d}x" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 60).tolist() + ["rotten"] * (i % 4 == 0)) for i in range(4000)]
    labels = (np.arange(len(texts)) % 4 == 0).astype(int)
    tracemalloc.start()
    found = toxicity.vocabulary(texts, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.slots) >= 4  # rotten and its parts
    assert most < 100e6


def test_the_drivers_jvm_hands_back_what_it_has_freed(shared, make):
    docs = tables.written(make([(1, "a b")]), "some")
    assert [r.text for r in docs.collect()] == ["a b"]
    assert "Trim native heap" in tables.trimmed(shared)
