import numpy as np

from annolytics.llm import setsketch


def test_pairs_that_others_have_joined_are_not_verified(make, monkeypatch):
    """Of n near copies that are all still apart, some n pairs are verified, not all n * (n - 1) / 2."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(24):
        t = list(base)
        t[int(rng.integers(0, 200))] = f"own{i}"
        rows.append((i, " ".join(t)))
    rows += [(50, "what stands alone has no other to be linked with")]
    seen, confirmed = [], setsketch.confirmed

    def counted(pairs, sets, **how):
        seen.append(pairs.count())
        return confirmed(pairs, sets, **how)

    monkeypatch.setattr(setsketch, "CENTRES", ())  # no rounds before
    monkeypatch.setattr(setsketch, "confirmed", counted)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(make(rows), k=4).collect()}
    assert got == {**{i: 0 for i in range(24)}, 50: 50}
    assert sum(seen) < 24 * 23 / 4


def test_no_pair_meets_in_two_rounds(make, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(30):  # many a little below the threshold, so that rounds leave work to each other
        t = list(base)
        for _ in range(3):
            t[int(rng.integers(0, 120))] = f"own{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(t)))
    stars, write = [], setsketch.written

    def written(df, name, **how):
        out = write(df, name, **how)
        if name == "star":
            stars.append({(r.src, r.dst) for r in out.collect()})
        return out

    monkeypatch.setattr(setsketch, "written", written)
    setsketch.near_duplicates(make(rows), k=4)
    assert stars[0] and sum(map(len, stars)) == len(set().union(*stars))
