import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics.llm import linededup


def entries_of(sets, key=5):
    """Entries of one list: sets of element hashes in the order of their lines."""
    rows = []
    for line, elements in enumerate(sets):
        e = np.sort(np.array(elements, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        n = np.array([len(e)])
        near, far = linededup.parities(e, n)
        meta = (near[0] << np.uint64(20)) | (np.uint64(len(e)) << np.uint64(8)) | np.uint64(255)
        rows.append([key, line, line, 0, int(meta.view(np.int64)), int(far[0].view(np.int64))])
    return np.array(rows, dtype=np.int64)


def test_open_lists_keep_only_what_is_asked_for():
    """Of a list of 30 sets in which 5 are alike, only those 5 come out, and they come back as they were."""
    sets = [range(1000 * i, 1000 * i + 20) for i in range(25)] + [[*range(19), 50_000 + i] for i in range(5)]
    x = entries_of(sets)
    pairs, more, among = linededup.candidates(x, 80, 2)
    assert {(int(a), int(b)) for a, b, _ in pairs} == {(a, b) for a, b, _ in pairs.tolist() if b < a} and len(among) in (5, 6)
    assert set(range(25, 30)) <= set(among.tolist()) and more[:, 2].all()
    assert (linededup.unpacked(linededup.packed(x[among]), len(among)) == x[among]).all()
    again = linededup.candidates(x[among], 80, None)[0]
    assert sorted(map(tuple, again[:, :2].tolist())) == sorted(map(tuple, linededup.candidates(x, 80, None)[0][:, :2].tolist()))


@pytest.mark.parametrize("best", [1, 2])
def test_lines_that_ask_for_more(make, best):
    """Closest candidates by parities that are not similar, and a similar one beyond them: the same lines go whatever `best` is."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.permutation(words)[: rng.integers(9, 14)].tolist()) for _ in range(60)]
    rows = [(i, "\n".join([lines[i], " ".join([*lines[(i * 7) % 60].split()[:-1], f"x{i}"])])) for i in range(60)]
    got = {r.doc_id: r.lines for r in linededup.gone_lines(make(rows), best=best).collect()}
    seen, expected = [], {}
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            s = set(line.lower().split())
            if any(100 * len(s & t) >= 80 * len(s | t) for t in seen):
                expected.setdefault(i, []).append(k)
            seen.append(s)
    assert got == expected


def test_text_is_split_once(make):
    """A text of many lines that lose some is cut in time linear in its lines (it was split again for each line that stays)."""
    import time

    text = "\n".join(f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(12_000))
    docs = make([(1, "one line that comes again here"), (2, f"{text}\none line that comes again here")])
    out = linededup.deduplicated(docs)
    start = time.time()
    got = {r.doc_id: (r.text, r.n_gone) for r in out.select("doc_id", "text", F.col("n_gone")).collect()}
    assert got[2] == (text, 1) and time.time() - start < 8
