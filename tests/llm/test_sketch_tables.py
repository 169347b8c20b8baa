import numpy as np
from pyspark.sql import functions as F

from annolytics.llm import setsketch


def test_only_what_can_meet_moves(make, monkeypatch):
    """Registers are kept of classes that share a band only, and keys of the prefix join are those that several components have."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(40):  # some 0.75 to 0.85 alike, with words of their own that are rarer than what they share
        t = list(base)
        for k in range(3):
            t[int(rng.integers(0, 90))] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(f"lone{i}w{k}" for k in range(60))) for i in range(30)]
    tables, write = {}, setsketch.written

    def written(df, name, **how):
        out = write(df, name, **how)
        tables.setdefault(name, (out.columns, out.toPandas() if name in ("cards", "shared-prefixes", "prefixes") else None))
        return out

    monkeypatch.setattr(setsketch, "written", written)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(make(rows), k=4).collect()}
    sets = {i: {tuple(w[a : a + 4]) for a in range(len(w) - 3)} for i, t in rows if (w := t.split())}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in sets}
    assert tables["classes"][0] == ["node", "first_id"] and len(tables["cards"][1]) <= 40
    before, after = tables["prefixes"][1], tables["shared-prefixes"][1]
    of = before.groupby("key")["root"].nunique()
    assert set(after["key"]) == set(of[of > 1].index) and len(after) < len(before)
