"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by similarity.

Terms are words, their beginnings and the grams inside them; those that mark toxic examples make up the vocabulary, so the index stays
small and a text meets only terms that bear on the question; how rare they are is counted over all documents. Examples with equal vectors are one, with the mean of their labels. Examples are a bounded, hashed sample of labelled rows; the
index of them is broadcast. For each text the blocks of examples are visited in descending order of what their best member could
score, until no block can beat the K-th found: the K nearest are exact. A distance-weighted vote of theirs is calibrated by isotonic
regression on votes that leave each example (and all copies of it) out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from annolytics.llm import textnum
from annolytics.llm.tables import small_batches

#: Documented bound of labelled rows in the index.
MAX_EXAMPLES = 10_000
VOCABULARY, STEMS, GRAMS, BLOCK, K = 4096, (4, 5, 6, 7), (5,), 64, 15
#: Terms are known by their hash in a space of this size, so that counting and looking them up takes tables of fixed size.
SPACE = 1 << 22
#: Characters of texts whose terms a worker holds arrays for at once.
CHARACTERS = 1 << 18
#: Vectors whose scores a worker remembers.
REMEMBERED = 8192
#: Least chi-squared statistic of a term of the vocabulary: about one in a million terms passes by chance.
LEAST_CHI = 24.0


def term_hashes(texts: list[str | None], size: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, owner, hash of each term occurrence) by blocks: words, their first bytes (STEMS) and the grams inside them (GRAMS)."""
    for i, j, data, lengths in textnum.blocks(texts, size):
        h, start, end = textnum.words(data)
        ends = np.cumsum(lengths + 1)
        owner = np.searchsorted(ends, start, side="right")
        owners, hashes = [owner], [h]
        if len(h):
            buf = np.frombuffer(data, dtype=np.uint8)
            up, down = textnum.powers(len(buf) + 1)
            total = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(textnum._LOWER[buf] * up[: len(buf)], out=total[1:])
            size = end - start
            for g in STEMS:
                first, own = start[size > g], owner[size > g]
                hashes.append(textnum.mix((total[first + g] - total[first]) * down[first] + np.uint64((g << 32) + 1)))
                owners.append(own)
            for g in GRAMS:
                many = np.maximum(size - g + 1, 0)
                first = np.repeat(start, many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
                hashes.append(textnum.mix((total[first + g] - total[first]) * down[first] + np.uint64(g << 32)))
                owners.append(np.repeat(owner, many))
        yield i, j - i, np.concatenate(owners), np.concatenate(hashes)


@dataclass
class Vocabulary:
    slots: np.ndarray  # of the hash space, sorted
    idf: np.ndarray

    def vectors(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text: log-scaled counts times idf, of unit length; no terms for a text without any."""
        place = np.full(SPACE, -1, dtype=np.int32)
        place[self.slots] = np.arange(len(self.slots))
        for _, n, owner, value in term_hashes(texts, CHARACTERS):
            term = place[(value & np.uint64(SPACE - 1)).astype(np.int64)]
            hit = np.flatnonzero(term >= 0)
            pair, count = np.unique(owner[hit] * VOCABULARY + term[hit], return_counts=True)
            row, term = pair // VOCABULARY, pair % VOCABULARY
            weight = (1 + np.log(count)) * self.idf[term] if len(pair) else np.zeros(0)
            norm = np.sqrt(np.bincount(row, weight**2, n))
            weight = weight / norm[row] if len(pair) else weight
            cuts = np.searchsorted(row, np.arange(n + 1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield term[a:b], weight[a:b]


def vocabulary(texts: list[str | None], labels: np.ndarray, *, size: int = VOCABULARY, least: int = 5) -> Vocabulary:
    """The terms of toxic texts with the highest chi-squared statistic between presence and label, among those of `least` examples or more."""
    count, in_toxic = np.zeros(SPACE, dtype=np.int32), np.zeros(SPACE, dtype=np.int32)
    for i, _, owner, value in term_hashes(texts, CHARACTERS):  # on the driver, whose memory is small
        pair = np.unique(owner * SPACE + (value & np.uint64(SPACE - 1)).astype(np.int64))
        slot = pair % SPACE
        for total, mine in ((count, slot), (in_toxic, slot[labels[i + pair // SPACE] == 1])):
            met, n = np.unique(mine, return_counts=True)
            total[met] += n.astype(np.int32)
    n, n1 = len(labels), int((labels == 1).sum())
    slots = np.flatnonzero((count >= least) & (count < n))
    c, t = count[slots].astype(float), in_toxic[slots].astype(float)
    expected = c * n1 / max(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        # of the whole two-by-two table
        chi = np.nan_to_num((t - expected) ** 2 * (1 / expected + 1 / (c - expected)) * n / (n - c))
    best = np.lexsort((slots, -chi))[:size]
    best = np.sort(best[(chi[best] >= LEAST_CHI) & (t[best] > expected[best])])
    return Vocabulary(slots[best], np.log((1 + n) / (1 + c[best])) + 1)


class Index:
    """Block-max inverted index: postings by term in the order of examples, and each term's largest weight in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int):
        order = sorted(range(len(vectors)), key=lambda i: vectors[i][0].tolist())  # alike examples share blocks
        self.order, self.labels = np.array(order, dtype=np.int64), labels[order].astype(float) if order else np.zeros(0)
        blocks = max(1, -(-len(order) // BLOCK))
        rows = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]) if order else np.zeros(0, dtype=np.int64)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, dtype=np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by = np.lexsort((rows, term))
        self.rows, self.weights = rows[by], weight[by]
        self.starts = np.searchsorted(term[by], np.arange(terms + 1))
        self.blocks = blocks
        # sparse block maxima: each term's largest weight in the blocks it occurs in
        block, of = self.rows // BLOCK, term[by]
        lead = np.ones(len(block), dtype=bool)
        lead[1:] = (block[1:] != block[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(lead)
        self.block, self.best = block[at], np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        self.block_starts = np.searchsorted(at, self.starts)

    @staticmethod
    def gathered(starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of the terms, and the query's weight for each."""
        size = starts[terms + 1] - starts[terms]
        ends = np.cumsum(size)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[terms] - ends + size, size), np.repeat(weights, size)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples that share a term, by descending cosine, ties by position: exact."""
        at, w = self.gathered(self.block_starts, terms, weights)
        bound = np.bincount(self.block[at], w * self.best[at], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, w = self.gathered(self.starts, terms, weights)
        rows = self.rows[at]
        value, home = w * self.weights[at], rows // BLOCK
        places, found = np.zeros(0, dtype=np.int64), np.zeros(0)
        i, step = 0, 4
        while i < len(order) and not (len(found) >= k and bound[order[i]] < found[k - 1] - 1e-9):
            visit = np.zeros(self.blocks, dtype=bool)
            chosen = order[i : i + step]
            # later blocks that can't beat the k-th score are left out at once
            visit[chosen if len(found) < k else chosen[bound[chosen] >= found[k - 1] - 1e-9]] = True
            mine = visit[home]
            score = np.bincount(rows[mine], value[mine], len(self.labels))
            hit = np.flatnonzero(score)
            places, found = np.concatenate([places, hit]), np.concatenate([found, np.round(score[hit], 12)])
            top = np.lexsort((places, -found))[:k]
            places, found = places[top], found[top]
            i, step = i + step, self.blocks
        return places, found

    def vote(self, terms: np.ndarray, weights: np.ndarray, *, without: np.ndarray | None = None) -> float:
        """The share of toxic among the nearest, weighted by cosine over angular distance; -1 if no example shares a term."""
        at, cosine = self.nearest(terms, weights, K if without is None else K + len(without))
        if without is not None:
            keep = ~np.isin(at, without)
            at, cosine = at[keep][:K], cosine[keep][:K]
        if not len(at):
            return -1.0
        w = cosine / (0.05 + np.arccos(np.clip(cosine, -1, 1)))
        return float((w * self.labels[at]).sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots and values of a non-decreasing step function."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    pools: list[list[float]] = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        pools.append([a, a, b, 1.0])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    mids = np.array([(p[0] + p[1]) / 2 for p in pools])
    return mids, np.array([(p[2] + 0.5 * 0.1) / (p[3] + 0.5) for p in pools])


@dataclass
class Model:
    vocabulary: Vocabulary
    index: Index
    knots: np.ndarray
    values: np.ndarray
    alone: float  # the score of a text that shares no term with any example
    ids: np.ndarray  # doc_id of each position in the index
    memo: dict[bytes, tuple[float, list[int]]] = field(default_factory=dict)  # scores and evidence of vectors met before

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        """Scores, and the doc_ids of the nearest examples as evidence."""
        out, evidence, memo = [], [], self.memo
        for terms, weights in self.vocabulary.vectors(texts):
            key = terms.tobytes() + np.round(weights, 9).tobytes()
            if key not in memo:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                at, _ = self.index.nearest(terms, weights, 3) if len(terms) else (np.zeros(0, dtype=np.int64), None)
                memo[key] = self.score(terms, weights), self.ids[at].tolist()
            s, e = memo[key]
            out.append(s)
            evidence.append(e)
        return np.array(out), evidence

    def score(self, terms: np.ndarray, weights: np.ndarray) -> float:
        vote = self.index.vote(terms, weights) if len(terms) else -1.0
        if vote < 0:
            return self.alone
        return float(np.interp(vote, self.knots, self.values)) if len(self.knots) else self.alone


def document_counts(docs: DataFrame, slots: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents, and how many of them have a term of each slot, over the whole texts of all of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(SPACE, -1, dtype=np.int32)
        place[shared.value] = np.arange(len(shared.value))
        total, n = np.zeros(len(shared.value), dtype=np.int64), 0
        for frame in frames:
            n += len(frame)
            for *_, owner, value in term_hashes(frame["text"].tolist(), CHARACTERS):
                term = place[(value & np.uint64(SPACE - 1)).astype(np.int64)]
                hit = np.flatnonzero(term >= 0)
                total += np.bincount(np.unique(owner[hit] * len(total) + term[hit]) % max(1, len(total)), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(seen, -1), "c": np.append(total[seen], n)})  # -1: the documents

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(textnum.tidy(count), "term long, c long")
    n, out = 0, np.zeros(len(slots), dtype=np.int64)
    for term, c in found.groupBy("term").agg(F.sum("c")).collect():  # a row a term of the vocabulary at most
        if term < 0:
            n = c
        else:
            out[term] = c
    return n, out


def fit(ids: list[int], texts: list[str | None], labels: np.ndarray, *, counts: Callable[[np.ndarray], tuple[int, np.ndarray]] | None = None) -> Model:
    """A model from examples; with none, or of one label only, a constant.

    counts: gives the documents of the corpus, and how many of them have each of some terms; the examples are the corpus without it.
    """
    words = vocabulary(texts, labels)
    if counts is not None and len(words.slots):
        n, of = counts(words.slots)
        words.idf = np.log((1 + n) / (1 + of)) + 1
    vectors = list(words.vectors(texts))
    alike: dict[bytes, list[int]] = {}
    for i, (terms, weights) in enumerate(vectors):
        if len(terms):
            alike.setdefault(terms.tobytes() + np.round(weights, 9).tobytes(), []).append(i)
    groups = list(alike.values())
    means = np.array([labels[g].mean() for g in groups])
    index = Index([vectors[g[0]] for g in groups], means, len(words.slots))
    place = np.empty(len(groups), dtype=np.int64)
    place[index.order] = np.arange(len(groups))
    votes, y = [], []
    for g, members in enumerate(groups):
        # of a few alike all are left out; many alike are evidence for one another
        votes.append(index.vote(*vectors[members[0]], without=np.array([place[g]] if len(members) <= 3 else [], dtype=np.int64)))
        y.append(means[g])
    votes = np.array(votes)
    y = np.array(y)
    knots, values = isotonic(votes[votes >= 0], y[votes >= 0]) if len(votes) else (np.zeros(0), np.zeros(0))
    empty = [i for i in range(len(vectors)) if not len(vectors[i][0])]
    base = float(labels.mean()) if len(labels) else 0.0
    alone = (float(labels[empty].sum()) + base) / (len(empty) + 1)
    return Model(words, index, knots, values, alone, np.array([ids[g[0]] for g in groups], dtype=object)[index.order] if groups else np.zeros(0, dtype=object))


def held_out(doc_id):
    """Whether a row belongs to the fifth that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, most: int = MAX_EXAMPLES) -> Model:
    """A model from the labelled rows outside the held-out fifth: at most `most`, the lowest by a seeded hash of their id."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a document and its label have the same hash: the ids are drawn first, and only their texts travel
    drawn = known.withColumn("_draw", F.xxhash64("doc_id", F.lit(5))).orderBy("_draw", "doc_id").limit(most).drop("_draw")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # `most` rows of two numbers
    found = rows.toPandas().sort_values(["doc_id", "text"], na_position="first").drop_duplicates("doc_id").head(most)
    textnum.prepare()  # the driver's memory counts too
    model = fit(found["doc_id"].tolist(), [t if isinstance(t, str) else None for t in found["text"]], found["toxic"].to_numpy(dtype=int), counts=lambda slots: document_counts(docs, slots))
    del found
    textnum.release()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5) and evidence (doc_ids of the nearest examples).

    Only the whole text counts. A text without a term of the vocabulary, null and empty ones included, gets the share of toxic among
    such examples. Equal texts get equal scores. Columns of docs named score, predicted or evidence are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("score double, evidence array<long>")
    def judge(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(shared.value)

        def score(texts: pd.Series) -> pd.DataFrame:
            found, evidence = own.scores([t if isinstance(t, str) else None for t in texts])
            return pd.DataFrame({"score": found, "evidence": evidence})

        yield from textnum.tidy(lambda parts: map(score, parts))(frames)

    out = docs.drop("score", "predicted", "evidence").withColumn("_judged", judge(F.col("text").cast("string")))
    out = out.withColumns({"score": F.col("_judged.score"), "evidence": F.col("_judged.evidence")}).drop("_judged")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
