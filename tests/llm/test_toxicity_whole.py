import itertools

import numpy as np
import pytest

from annolytics.llm import toxicity


def test_examples_are_not_cut_to_pass():
    assert toxicity.MAX_EXAMPLES >= 10_000


def test_rarity_is_counted_over_all_documents(make, shared):
    rows = [(i, f"vile plain{i % 7} words" if i % 2 else f"kind plain{i % 7} words") for i in range(200)]
    others = [(1000 + i, "vile vile thing" if i % 3 else None) for i in range(300)]
    labels = shared.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    words = toxicity.train(make(rows + others), labels).vocabulary
    (hashed,) = [v for *_, v in toxicity.term_hashes(["vile"])]
    at = int(np.searchsorted(words.slots, int(hashed[0]) & (toxicity.SPACE - 1)))
    assert words.idf[at] == pytest.approx(np.log(501 / (1 + 100 + 200)) + 1)


def test_calibration_takes_all_groups(monkeypatch):
    terms = [c * 3 for c in "abcdefghijklm"]
    texts = [" ".join(s) for k in range(1, 14) for s in itertools.combinations(terms, k)]
    labels = np.array([1] * len(texts) + [0] * len(texts))
    seen, of = [], toxicity.isotonic
    monkeypatch.setattr(toxicity, "isotonic", lambda x, y: seen.append(len(x)) or of(x, y))
    toxicity.fit(list(range(2 * len(texts))), texts + ["other"] * len(texts), labels)
    assert seen == [len(texts)] and len(texts) > 6000
