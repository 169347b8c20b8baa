import numpy as np

from annolytics.llm import linededup, textnum


def one_by_one(texts):
    """(text, number, words) of each line that has words."""
    return [(t, k, set(line.lower().split())) for t, text in enumerate(texts) for k, line in enumerate((text or "").split("\n")) if line.split()]


def test_lines_are_found_by_their_breaks():
    texts = ["", None, "\n", "a\n\nb a A\n", " \n x", "x\n", "é b\n\té c", "\n\n\n", "a b c", *[f"p{i} q\n" * (i % 5) + " r" * (i % 3) for i in range(200)]]
    (first, text, number, owner, element, n), = linededup.line_sets(texts)
    want = one_by_one(texts)
    assert first == 0 and list(zip(text.tolist(), number.tolist(), n.tolist())) == [(t, k, len(w)) for t, k, w in want]
    hashes = {w: textnum.words(w.encode())[0][0] for _, _, words in want for w in words}
    ends = np.cumsum(n)
    assert all(set(element[e - m : e].tolist()) == {int(hashes[w]) for w in words} for (_, _, words), e, m in zip(want, ends.tolist(), n.tolist()))


def test_looking_up_lines_takes_no_search_of_each_word(monkeypatch):
    asked = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: asked.append(np.size(v)) or search(a, v, *x, **y))
    list(linededup.line_sets([" ".join(f"w{i}" for i in range(2000))] * 5))
    assert max(asked) < 100


def test_order_by_rarity_is_that_of_a_full_sort():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 4, linededup.BUCKETS)
    owner, element = textnum.distinct(np.sort(rng.integers(0, 50, 3000)), rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    keys = linededup.Keys(counts, 80)
    rarity = keys.rarity[(element & np.uint64(linededup.BUCKETS - 1)).astype(np.int64)]
    assert (keys.by_rarity(owner, element) == element[np.lexsort((element, rarity, owner))]).all()
