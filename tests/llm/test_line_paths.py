"""Line dedup with small bounds, so that long lists, fed buckets and the second pass all have work."""

import numpy as np
import pytest

from annolytics.llm import linededup
from tests.llm.test_edges import brute_lines


@pytest.mark.parametrize("bounds", [{"best": 1}, {"full": 3}, {"together": 40}])
def test_bounds_lose_no_line(make, bounds):
    rng = np.random.default_rng(12)
    base = [f"m{j}" for j in range(24)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.integers(0, 6)):
            t[rng.integers(0, len(t))] = f"e{rng.integers(0, 30)}"
        rows.append((i, " ".join(t)))
    want = brute_lines(rows)
    got = {r.doc_id: r.lines for r in linededup.gone_lines(make(rows), **bounds).collect()}
    assert set(got) == {i for i, _ in rows if not want[i]} and all(v == [0] for v in got.values())
