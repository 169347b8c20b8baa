"""Every operator on nulls, empty and very long texts, ties and repeated rows, empty tables, and clashing extra columns."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from annolytics.llm import boosting, html, license, linededup, mixing, packing, queries, setsketch, simhash, textnum, topk, toxicity, urlfilter

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "   \n \t"), (4, LONG), (5, "same text here for all of us"), (6, "same text here for all of us"), (6, "same text here for all of us"), (7, "é\u00a0ß 日本語 \U0001f600"), (None, "no id at all in this row"), (8, "A")]


def test_mixing_edges(make):
    rows = [(*r, s) for r, s in zip(ODD, ["a", None, "b", "c", None, "a", "a", "", "a", "zz"], strict=True)]
    out = mixing.mix(make(rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    for source, mine in sizes.items():
        assert sum(r.size for r in mine) == mine[0].source_size
        assert all(r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5, source
        assert mine[0].target <= 3 * mine[0].source_size + 1e-9
    assert total == sum(len(textnum.words((r[1] or "").encode())[0]) for r in rows)
    again = mixing.mix(make(rows)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixing_empty_and_wordless(make):
    assert mixing.mix(make([])).collect() == []
    out = mixing.mix(make([(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in out] == [(0, 0, 0.0)] * 2


def water_filled(sizes, weights, cap):
    target, open_ = {}, set(sizes)
    left = float(sum(sizes.values()))
    while True:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > cap * sizes[s] + 1e-9} if total else set()
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over


def test_mixing_targets_by_hand(shared):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, "e": 7, None: 900}
    order = [*sorted(s for s in sizes if s is not None), None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    got = {r.source: r.target for r in mixing.targets(shared.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water_filled(sizes, weights, 3))


def test_mixed_rows_repeat_whole_and_in_part(make):
    rows = [(i, " ".join(["w"] * (i + 3)), "a" if i < 30 else "b") for i in range(60)]
    mixed = mixing.mix(make(rows))
    taken = sum(r.taken for r in mixed.collect())
    out = mixing.repeated(mixed, ("doc_id", "text", "n_chars")).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    assert all(r.n_chars == len(r.text) for r in out)


def test_url_edges(shared):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?a=1&b=2#f", "http://example.com/de", "http://a.example.com/de/?q", "http://x.org/fr/1", "http://x.org:80/fr/1", "ftp://net/", "http://net", "x://y://z/p", "http://h?q=://", "http://" + "a" * 50_000 + ".net/" + "b" * 50_000, "http://é.net/\n"]
    df = shared.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, verdict string")
    out = urlfilter.judged(df).orderBy("page_id").collect()
    model = urlfilter.default_model()
    for r in out:
        host, path, _ = urlfilter.split_url(r.url)
        assert (r.host, r.path) == (host, path)
        assert r.margin == pytest.approx(model.blocked(r.url), abs=1e-5)
        assert r.verdict in ("allow", "block")
    by = {r.url: r for r in out}
    assert (by[urls[4]].rule, by[urls[4]].verdict) == ("example.net/en/", "allow")
    assert by["http://example.com/de"].rule is None and by["http://a.example.com/de/?q"].rule == "example.com/de/"
    assert by["http://x.org/fr/1"].rule == "org/fr/" and by["http://x.org:80/fr/1"].rule is None
    assert by["ftp://net/"].rule == "net/" and by["http://net"].rule is None
    assert urlfilter.judged(df.limit(0)).collect() == []


def test_url_trees_tell_bait_apart():
    model = urlfilter.default_model()
    held = urlfilter.seed_urls(1000, seed=999)
    right = sum((model.blocked(u) > 0) == bool(y) for u, y in held)
    assert right / len(held) > 0.93


def test_simhash_edges(make):
    out = simhash.compared(make(ODD)).collect()
    assert len(out) == len(ODD)
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, t or "")
    ids = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for r in out:
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        k = len(text) // 3
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {r.fingerprint for r in out if r.doc_id in (5, 6)}
    assert len(same) == 1
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 32}
    assert simhash.compared(make([])).collect() == []
    lone = simhash.compared(make([(9, "just one text")])).collect()
    assert lone[0].near_next == 1.0


def test_simhash_radius_search(shared):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 16, 32) for _ in range(30)]
    prints = []
    for i, b in enumerate(base):
        for j in range(4):
            c = b.copy()
            for p in rng.integers(0, 32, j):
                c[p] ^= 1 << int(rng.integers(0, 4))
            prints.append((i * 10 + j, "".join(f"{x:x}" for x in c)))
    prints.append((999, None))
    df = shared.createDataFrame(prints, "doc_id long, fingerprint string")
    got = {(r.left, r.right) for r in simhash.within_radius(df, radius=3).collect()}
    known = sorted({p for _, p in prints if p})
    want = {(a, b) for a in known for b in known if a < b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    assert got == want and want


def test_packing_edges(make):
    path = queries.tokenizer_path()
    rows = [*ODD, (20, "don't <|endoftext|> it's 'S ﬁ"), (21, "x" * 9000)]
    out = packing.packed(make(rows), tokenizer=path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {}
    for i, text in rows:
        ids[i] = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
    assert sum(r.length for r in out) == sum(len(ids[i]) for i, _ in rows)
    for r in out:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    placed = {}
    for r in out:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(make([]), tokenizer=path).collect() == []


def test_packing_balances_cost():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.integers(1, 2500, 800))
    sequence, offset, cost = packing.assign(lengths, capacity=2048, linear=1.0, quadratic=1 / 2048)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and lengths.sum() / (2048 * len(used)) > 0.95
    assert len(cost) == len(used)


def brute_lines(rows, percent=80):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[i] = None
            continue
        keep = []
        for line in text.split("\n"):
            s = set(line.encode().lower().split())
            if not s or not any(100 * len(s & p) >= percent * len(s | p) for p in seen):
                keep.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(keep)
    return out


def test_line_dedup_against_brute_force(make):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "a"]
    templates = [[words[j] for j in rng.integers(0, len(words), rng.integers(1, 40))] for _ in range(30)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.integers(0, 7)):
            t = list(templates[rng.integers(0, len(templates))])
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = words[rng.integers(0, len(words))]
            lines.append(" ".join(t).title() if rng.random() < 0.2 else "  ".join(t))
        rows.append((i, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, " \n\n \n"), (1003, LONG), (1004, LONG + "\n" + LONG), (None, "w1 w2 w3 w4 w5\nunique line here")]
    out = linededup.deduplicated(make(rows)).collect()
    want = brute_lines(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r.text == want[r.doc_id], r.doc_id
        assert r.n_lines - r.n_gone == (len(want[r.doc_id].split("\n")) if want[r.doc_id] else r.n_lines - r.n_gone)


def test_line_dedup_with_long_lists(make, monkeypatch):
    """More lines that share a prefix word than neighbours are compared at once: the later join finds the rest."""
    monkeypatch.setattr(linededup, "NEAR", 2)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        middle = [f"m{j}" for j in rng.choice(60, 12, replace=False)]
        rows.append((i, " ".join(["rare", *middle])))
        if i % 5 == 0 and i:
            other = rows[rng.integers(0, len(rows) - 1)][1].split()
            other[-1] = "changed"
            rows.append((i + 1000, " ".join(other)))
    out = {r.doc_id: r.text for r in linededup.deduplicated(make(rows)).collect()}
    assert out == brute_lines(rows)


def test_line_dedup_empty_and_repeated(make):
    assert linededup.deduplicated(make([])).collect() == []
    out = linededup.deduplicated(make([(1, "one two three"), (1, "one two three"), (2, "One two  three")])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "one two three"), (1, "one two three"), (2, "")]


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_near_duplicates_against_brute_force(make):
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [f"g{g}w{j}" for j in range(rng.integers(3, 80))] + (common if g % 3 == 0 else [])
        for _ in range(rng.integers(1, 9)):
            t = list(base)
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(0, len(t))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows) * 3, " ".join(t)))
    rows += [(5001, None), (5002, ""), (5003, "one"), (5004, "One"), (5005, "a b c"), (5006, LONG), (5007, LONG + " tail"), (5008, "a b c"), (None, "a b c")]
    for k in (4, 5):
        out = setsketch.near_duplicates(make(rows), k=k).collect()
        want = brute_components(rows, k)
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id is not None:
                assert r.component_id == want[r.doc_id]
                assert r.n_shingles == len(shingle_set(dict(rows)[r.doc_id], k))
                assert r.kept == (r.component_id == r.doc_id)
            else:
                assert r.component_id is None and r.kept


def test_near_duplicates_repeated_rows_and_empty(make):
    assert setsketch.near_duplicates(make([])).collect() == []
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other words stand in this one"), (4, "A b c d e f")]
    out = setsketch.near_duplicates(make(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), (3, 3), (3, 3), (4, 3)]
    kept = setsketch.kept_documents(make(rows)).collect()
    assert len(kept) == 1 and kept[0].doc_id == 3


def test_setsketch_merges_and_estimates():
    rng = np.random.default_rng(2)
    for n, same in ((40, 20), (500, 400), (3000, 2700)):
        both = rng.integers(1, 1 << 62, same).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(1, 1 << 62, n - same).astype(np.uint64)]) for _ in range(2))
        sketch = lambda v: setsketch.sketch(np.zeros(len(v), dtype=np.int64), v, 1)
        union = sketch(np.unique(np.concatenate([a, b])))
        assert (np.maximum(sketch(a), sketch(b)) == union).all()
        true = same / (2 * n - same)
        assert abs(setsketch.estimate(sketch(a), sketch(b), np.array([float(n)]), np.array([float(n)]))[0] - true) < 0.15


def test_toxicity_edges(make, shared):
    rng = np.random.default_rng(4)
    words = [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        t = [words[j] for j in rng.integers(0, 200, 30)]
        if i % 4 == 0:
            t[5], t[9] = "vilenesse", "vilenard"
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(make(rows), shared.createDataFrame([*labels, (None, 1), (7000, 1), (3, None)], "doc_id long, toxic int"))
    out = toxicity.scored(make([*ODD, (900, "a vilenesse among plain3 words"), *rows]), model).collect()
    assert len(out) == len(ODD) + 1 + len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    got = {r.doc_id: r.predicted for r in out}
    assert got[900] == 1 and all(got[i] == y for i, y in labels if i > 10)
    none = toxicity.train(make([]), shared.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(make(ODD), none).collect())
    assert toxicity.scored(make([]), model).collect() == []


def test_toxicity_nearest_is_exact():
    rng = np.random.default_rng(9)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w**2).sum())))
    index = toxicity.Index(vectors, rng.integers(0, 2, 700), 50)
    dense = np.zeros((700, 50))
    for row, i in enumerate(index.order):
        dense[row, vectors[i][0]] = vectors[i][1]
    for t, w in vectors[:100]:
        at, cosine = index.nearest(t, w)
        q = np.zeros(50)
        q[t] = w
        score = np.round(dense @ q, 12)
        want = np.lexsort((np.arange(700), -score))[: len(at)]
        assert np.allclose(cosine, score[want]) and len(at) == 15


def test_top_k_edges(shared):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 420)]
    rows += [(500, None), (600, [1.0, None] * 4), (700, [math.inf] + [0.0] * 7), (701, [math.nan] * 8), (800, [0.0] * 8), (900, rows[3][1]), (901, rows[3][1]), (901, rows[3][1]), (1000, []), (1001, []), (1100, [5.0, 1.0]), (1101, [1.0, 1.0]), (None, [0.1] * 8), (1200, [1e200] * 8), (1201, [3e17] * 8)]
    rows += [(2000 + i, (rng.normal(size=8) * 10 ** rng.integers(0, 3)).tolist()) for i in range(300)]
    df = shared.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    out = topk.top_k(df, k=10, every=100, chunk=64, block=3).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    good = []
    for i, e in rows:
        if i is not None and e is not None and all(c is not None and math.isfinite(c) for c in e):
            scaled = [math.floor(1024 * c) if math.isfinite(1024 * c) else 0 for c in e]
            good.append((i, scaled))
    for q, v in good:
        if q % 100:
            continue
        want = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v)))[:10]
        assert [got.get(q, {}).get(r + 1) for r in range(len(want))] == [(i, -s) for s, i in want], q
    assert topk.top_k(df.limit(0)).collect() == []


def test_html_edges(shared):
    pages = [None, "", "   ", "plain words only", "<p>", "<!-- never closed", "<script>x", "<article><p>One &amp; two&nbsp;x &lt;b&gt;<p>Two\n\n  lines<br>more</article><footer>&copy; no</footer>", "<div>" * 3000 + "deep" + "</div>" * 3000, "<article>" + "<p>word and more words here.</p>" * 20_000 + "</article>", "</p></div>stray", "<a href='x>y'>q</a>"]
    df = shared.createDataFrame([(i, h, "x") for i, h in enumerate([*pages, pages[7]])], "page_id long, html string, text string")
    out = html.main_text(df).orderBy("page_id").collect()
    assert [out[i].text for i in (0, 1, 2, 4, 5, 6)] == [""] * 6
    assert all(r.n_chars == len(r.text) for r in out)
    assert out[7].text == out[12].text == "One & two x <b>\nTwo lines more"
    assert out[9].text.count("\n") == 19_999
    assert html.main_text(df.limit(0)).collect() == []


def test_html_on_seeded_pages():
    model = html.default_model()
    right = sum(set(t.split("\n")) == main for (p, main), t in ((x, html.extract([x[0]], model)[0]) for x in html.seed_pages(60, seed=123)))
    assert right >= 55


def test_license_edges(make):
    texts = [*ODD, (30, "Some prose about nothing.\nReleased under the MIT License.\nmore"), (31, "Licensed under the Apache License, Version 2.0."), (32, "All rights reserved.\nAll rights reserved.")]
    out = license.documents(make(texts)).collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    assert (by[30].license, by[30].n_found, by[30].licenses[0].line) == ("mit", 1, 1)
    assert by[31].license == "apache" and by[32].n_found == 2 and by[5].license == "none" and by[1].families == []
    assert license.documents(make([])).collect() == []


def test_boosting_fits_and_bounds():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    model = boosting.fit(x, y)
    assert ((model.margin(x) > 0) == y).mean() > 0.97
    assert boosting.fit(x[:0], y[:0]).trees == []
    with pytest.raises(ValueError):
        boosting.fit(np.zeros((boosting.MAX_ROWS + 1, 1)), np.zeros(boosting.MAX_ROWS + 1))


def test_xxhash_slots_agree_with_spark(shared):
    from pyspark.sql import functions as F

    v = [0, 1, -1, 2**62, -(2**63), 123456789]
    df = shared.createDataFrame([(x,) for x in v], "n long").select("n", F.pmod(F.xxhash64("n"), F.lit(linededup.BLOOM_BITS)).alias("s"))
    got = {r.n: r.s for r in df.collect()}
    assert [got[x] for x in v] == linededup.xxhash_slots(np.array(v)).tolist()


def test_lists_fed_in_parts_lose_no_pair(monkeypatch):
    monkeypatch.setattr(linededup, "NEAR", 3)
    monkeypatch.setattr(linededup, "possible", lambda x, y, percent: np.ones(len(x), dtype=bool))
    rng = np.random.default_rng(11)
    x = np.stack([rng.choice([1, 2, 3, 4, 4, 4, 4], 400), np.arange(400) % 150, rng.integers(0, 1000, 400), rng.integers(0, 9, 400), np.full(400, 10 << 8)], axis=1)
    for cuts in ([400], [1, 2, 3, 50, 51, 200, 400], list(range(5, 405, 5))):
        lists, found, long = linededup.Lists(80), set(), []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            pairs, rows = lists.feed(x[a:b])
            found |= set(map(tuple, pairs.tolist()))
            long += rows.tolist()
        for key in (1, 2, 3, 4):
            nodes = {r[1] for r in x.tolist() if r[0] == key}
            rest = {r[1] for r in long if r[0] == key}
            for m in nodes:
                for n in nodes:
                    assert m >= n or (m, n) in found or (m in rest and n in rest)
