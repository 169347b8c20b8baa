import numpy as np

from annolytics.llm.components import components


def test_components_of_paths_stars_and_noise(shared):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (300, 2))] + [(9, 9), (-5, 7), (7, -5)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(shared.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in up}


def test_components_of_nothing(shared):
    assert components(shared.createDataFrame([], "src long, dst long")).collect() == []
