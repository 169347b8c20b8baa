"""Near-duplicate documents by SetSketch registers: banding finds candidates, a joint likelihood estimates, full sets verify.

A document's set of word shingles is sketched in M registers of exponentially spaced, truncated minima: an element has one point in
each of M intervals of equal probability, dealt to the registers by a permutation of its own, and a register keeps the smallest point
as floor(1 - log_b(x)). Registers of a union are the maxima of the registers, and two sets agree in a register with a probability
close to their Jaccard similarity.

Copies (equal sets) are one class. Classes that agree in a band are candidates. In each of a few rounds a class is compared with a few
others only, centres of its bands that it is not connected to yet, and the links found are contracted: a group of n near copies costs a multiple of n comparisons, not n * n. Then members of a band that are still apart must share one of their rarest
shingles (prefix filter: two similar sets always do, while texts that are alike only in passages that many share don't), and sizes and
parities must allow it (those of registers, and exactly those of ODD parts of the shingles). Of these pairs each class's closest is
verified first, where they are many, and of the others only those whose ends are still apart then. So every candidate pair is verified, ruled out or known
to be connected, and the components are those of all links among candidates. With 42 bands of 6 registers a link of similarity 0.8 is no candidate with a probability of 3e-6,
one of 0.85 with 5e-10.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annolytics.llm import textnum
from annolytics.llm.components import components
from annolytics.llm.linededup import BUCKETS, Bloom, Keys, table_rows, table_sums
from annolytics.llm.tables import scratch, written

M, BANDS, ROWS, BASE, RATE = 256, 42, 6, 1.001, 20.0
LIMIT = 2**16 - 2
#: Numbers that pick the centre of a band in each round: the component smallest after an exclusive or with it.
CENTRES = (0, 0x5BD1E9955BD1E995, 0x2545F4914F6CDD1D)
#: Centres that a class is compared with in a round.
MEET = 4
#: Rounds in which only the closest pair of each class is verified, where there are many more pairs than classes.
TURNS = 6
#: Keys that a class carries to tell at which of them it meets another first.
KNOWN = 12
#: Parities of a set's shingles by hash: sets differ in at least as many shingles as parities.
ODD = 512
#: Texts, and elements of sets, that a worker holds arrays for at once.
TEXTS, ELEMENTS = 4096, 1_000_000
#: Standard deviations by which an estimate may miss the threshold before a pair is dropped unverified.
SLACK = 5.0


def gammas() -> np.ndarray:
    """Ends of the M intervals of equal probability of an exponential with RATE."""
    j = np.arange(M + 1, dtype=float)
    with np.errstate(divide="ignore"):
        return np.log1p(j / (M - j)) / RATE


GAMMA = gammas()


def sketch(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Registers (n, M) uint16 of n sets given as ascending owners and element hashes; a register of an empty set is 0."""
    least = np.full((n, M), np.inf)
    flat = least.reshape(-1)
    stride = ((value >> np.uint64(40)).astype(np.int64) << 1) | 1
    place = (value >> np.uint64(20)).astype(np.int64) & (M - 1)
    for j in range(M):
        draw = textnum.mix(value + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)))
        u = ((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        width = 1.0 if j == M - 1 else -np.expm1(-RATE * (GAMMA[j + 1] - GAMMA[j]))
        x = GAMMA[j] - np.log1p(-u * width) / RATE
        np.minimum.at(flat, owner * M + ((place + j * stride) & (M - 1)), x)
        # a set whose registers all lie below the next interval is done
        going = least.max(axis=1) > GAMMA[j + 1]
        if j < M - 1:
            live = going[owner]
            if not live.any():
                break
            if not live.all():
                owner, value, stride, place = owner[live], value[live], stride[live], place[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(BASE))
    # the smallest registers of long texts lie near log_b(RATE * n): centred so that sets of 1 to 10**20 elements fit
    return np.clip(k + LIMIT // 4, 0, LIMIT + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of registers (rows), given the exact sizes of the sets."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        left, right = low + (high - low) / 3, high - (high - low) / 3
        worse = likelihood(left) < likelihood(right)
        low, high = np.where(worse, left, low), np.where(worse, high, right)
    return (low + high) / 2


def parities(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """(n, ODD / 64) long: the parities of the number of elements of each set in each of ODD parts of the hash space."""
    part = (textnum.mix(value ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(32)) * np.uint64(ODD) >> np.uint64(32)
    odd = np.bincount(owner * ODD + part.astype(np.int64), minlength=n * ODD).reshape(n, ODD) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def signature(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash a set, from the sum of its mixed elements and its size."""
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, owner, textnum.mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    return textnum.mix(total + np.bincount(owner, minlength=n).astype(np.uint64)).view(np.int64)


def sketches(docs: DataFrame, *, k: int) -> DataFrame:
    """doc_id, n, node (a hash of the set), registers (binary), bands, parities (array<long>: M of registers, then ODD of shingles)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for i, owner, value, size in textnum.document_sets(texts, k, most=TEXTS):
                n = len(size)
                reg = sketch(owner, value, n)
                wide = reg[:, : BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64)
                band = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
                for r in range(ROWS):
                    band = textnum.mix(band * np.uint64(0xBF58476D1CE4E5B9) + wide[:, :, r])
                parity = np.packbits((reg & 1).astype(np.uint8), axis=1).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[i : i + n].astype("Int64").to_numpy(),
                    "n": size.astype(np.int64), "node": signature(owner, value, n), "registers": [r.tobytes() for r in reg],
                    "bands": list(band.view(np.int64)), "parities": list(np.concatenate([parity, parities(owner, value, n)], axis=1)),
                })

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return asked.mapInPandas(textnum.tidy(make), "doc_id long, n long, node long, registers binary, bands array<long>, parities array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, *, k: int) -> DataFrame:
    """node, elements (binary of sorted 64-bit hashes), one row for each node of wanted: a map pass that shuffles only what is wanted."""
    known = Bloom(wanted, "node")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, owner, value, size in textnum.document_sets(frame["text"].tolist(), k):
                node = signature(owner, value, len(size))
                hit = np.flatnonzero(known.has(node))
                hit = hit[np.unique(node[hit], return_index=True)[1]]  # copies in a block once
                ends = np.cumsum(size)
                yield pd.DataFrame({"node": node[hit], "elements": [value[ends[h] - size[h] : ends[h]].tobytes() for h in hit.tolist()]})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(textnum.tidy(make), "node long, elements binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Sets that hold a shingle, by hash bucket; a table of fixed size a task, tasks as many as four times the cores at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for f in frames:
            for e in f["elements"]:
                total += np.bincount((np.frombuffer(e, dtype=np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield table_rows(total)

    cores = sets.sparkSession.sparkContext.defaultParallelism
    return table_sums(sets.select("elements").coalesce(max(32, 4 * cores)).mapInPandas(textnum.tidy(count), "first int, counts binary"))


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """key, place, node: the rarest shingles of each set, of which two similar sets share one."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = Keys(shared.value, percent)
        for f in frames:
            if f.empty:
                continue
            sets_, node = f["elements"].tolist(), f["node"].to_numpy()
            every = np.array([len(e) // 8 for e in sets_], dtype=np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(every) - every) // ELEMENTS, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(sets_)], strict=True):
                n = every[i:j]
                owner, element = np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(sets_[i:j]), dtype=np.uint64)
                line, key, place = keys(owner, element, n)
                yield pd.DataFrame({"key": key.view(np.int64), "place": place, "node": node[i:j][line]})

    return sets.mapInPandas(textnum.tidy(make), "key long, place int, node long")


def most_apart(na: Column, nb: Column, percent: int) -> Column:
    """How many shingles may be in one of two sets of these sizes only, if they are similar."""
    return na + nb - 2 * F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)


def differ(a: list[Column], b: list[Column]) -> Column:
    """In how many bits two runs of longs differ."""
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def likely(pairs: DataFrame, classes: DataFrame, *, percent: int) -> DataFrame:
    """Of the pairs (src, dst), those whose sizes, parities of shingles and estimate leave the threshold possible."""
    t = percent / 100
    floor = t - SLACK * (t * (1 - t) / M) ** 0.5

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                reg = [np.frombuffer(b"".join(f[c]), dtype=np.uint16).reshape(-1, M) for c in ("ra", "rb")]
                good = estimate(*reg, f["na"].to_numpy(dtype=float), f["nb"].to_numpy(dtype=float)) >= floor
                f = f[good]
            yield f[["src", "dst"]]

    side = lambda node, s: classes.select(F.col("node").alias(node), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}"), F.col("parities").alias(f"p{s}"))
    joined = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    odd = lambda p: [F.element_at(p, i + 1) for i in range(M // 64, (M + ODD) // 64)]
    near = near & (differ(odd("pa"), odd("pb")) <= most_apart(F.col("na"), F.col("nb"), percent))
    return joined.where(near).select("src", "dst", "na", "nb", "ra", "rb").mapInPandas(textnum.tidy(keep), "src long, dst long")


def confirmed(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """Of the pairs (src, dst), those whose full sets have 100 * intersection >= percent * union."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            common, total = textnum.in_common(f["ea"].tolist(), f["eb"].tolist())
            yield f.loc[100 * common >= percent * (total - common), ["src", "dst"]]

    side = lambda node, e: sets.select(F.col("node").alias(node), F.col("elements").alias(e))
    joined = pairs.join(side("src", "ea"), "src").join(side("dst", "eb"), "dst")
    return joined.select("src", "dst", "ea", "eb").mapInPandas(textnum.tidy(keep), "src long, dst long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept, links (verified links of its class).

    Documents are linked where 100 * intersection >= percent * union of their sets of distinct k-word shingles, lower-cased A-Z; with
    fewer words the whole sequence is one shingle. Documents without words, and those without an id, are linked with nothing: their
    component is their own id (null without one). Rows that repeat an id and a text are one document; rows that repeat an id with
    another text are each linked by their own set. kept: doc_id = component_id, and true without an id. Whole texts count; an empty
    table gives an empty result.
    """
    with scratch(docs.sparkSession):
        return written(grouped(docs, k=k, percent=percent), "near-duplicates", keep=True)


def grouped(docs: DataFrame, *, k: int, percent: int) -> DataFrame:
    """The rows of near_duplicates(), over the tables that it works with."""
    table = written(sketches(docs, k=k), "sketches")
    real = table.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(real.groupBy("node").agg(F.min("doc_id").alias("first_id")), "classes")
    banded = real.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band")
    shared = written(shared, "shared")
    # what shares no band with another class is left out before anything else of it moves
    banded = banded.where(Bloom(shared, "band").column("band")).distinct()
    banded = written(banded.join(shared, "band"), "bands")
    members = written(banded.select("node").distinct(), "members")
    sets = written(full_sets(docs, members, k=k), "sets")
    cards = real.where(Bloom(members, "node").column("node")).select("node", "n", "registers", "parities").join(members, "node", "left_semi")
    cards = written(cards.dropDuplicates(["node"]), "cards")
    links = docs.sparkSession.createDataFrame([], "src long, dst long")
    roots = links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    tried = links  # pairs of earlier rounds
    for turn in CENTRES:
        held = apart(banded, roots, turn)
        # a class meets those centres of other components that most of its bands have
        star = held.where("root <> centre_root").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("c"))
        star = star.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy(F.col("c").desc(), "centre"))).where(F.col("at") <= MEET)
        star = star.select(F.least("node", "centre").alias("src"), F.greatest("node", "centre").alias("dst")).distinct()
        star = written(star.join(tried, ["src", "dst"], "left_anti"), "star")
        if star.isEmpty():
            continue
        tried = tried.union(star)
        found = written(confirmed(written(likely(star, cards, percent=percent), "likely"), sets, percent=percent), "links")
        if not found.isEmpty():
            links = links.union(found)
            roots = components(links)
    # members of a band that are still apart
    held = apart(banded, roots, 0).select("node", "root").distinct()
    bits = [F.element_at("parities", i + 1).alias(f"bit{i}") for i in range((M + ODD) // 64)]
    held = written(held.join(cards.select("node", "n", *bits), "node"), "apart")
    own = sets.join(held.select("node"), "node", "left_semi")
    keyed = written(prefixes(own, bucket_counts(own), percent).join(held.select("node", "root"), "node"), "prefixes")
    # keys of one component only bring no pair together, and would crowd out those that are known below
    useful = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    keyed = written(keyed.drop("root").join(useful, "key", "left_semi"), "shared-prefixes")
    # a pair comes out at the first key by rarity that both are known to have, the one that the positional filter is about, not at each
    first = F.slice(F.sort_array(F.collect_set(F.struct("place", "key"))), 1, KNOWN)
    few = keyed.groupBy("node").agg(F.transform(first, lambda x: x["key"]).alias("first"))
    keyed = written(keyed.join(held, "node").join(few, "node"), "keyed")
    t = percent / 100
    odd = (1 - t) / 2  # the share of parities in which registers of similarity t differ, at most
    most_bits = int(M * odd + SLACK * (M * odd * (1 - odd)) ** 0.5) + 1
    a, b = keyed.alias("a"), keyed.alias("b")
    bit = lambda s, i, j: [F.col(f"{s}.bit{k}") for k in range(i // 64, j // 64)]
    overlap = F.ceil(percent * (F.col("a.n") + F.col("b.n")) / F.lit(100.0 + percent) - 1e-9)
    open_pair = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
        & (differ(bit("a", 0, M), bit("b", 0, M)) <= most_bits) & (differ(bit("a", M, M + ODD), bit("b", M, M + ODD)) <= most_apart(F.col("a.n"), F.col("b.n"), percent))
        & ((F.col("a.place") == 255) | (F.col("b.place") == 255) | (F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= overlap))
        & (F.coalesce(F.get(F.array_intersect("a.first", "b.first"), F.lit(0)), F.col("a.key")) == F.col("a.key"))
    )
    rest = a.join(b, open_pair).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"), differ(bit("a", M, M + ODD), bit("b", M, M + ODD)).alias("apart"))
    rest = written(rest.groupBy("src", "dst").agg(F.min("apart").alias("apart")), "rest")
    few, turn = 2 * held.count(), 0
    while n := rest.count():
        every = n <= few or turn == TURNS
        pairs = written(likely(rest.select("src", "dst"), cards, percent=percent) if every else closest(rest), "pairs")
        more = written(confirmed(pairs, sets, percent=percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
        if every:
            break
        # of the others only those that are still apart; where the closest are not similar, all are looked at next
        rest = written(between(rest.join(pairs, ["src", "dst"], "left_anti"), roots), "rest")
        turn = TURNS if more.isEmpty() else turn + 1
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    of_class = classes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of_class.join(smallest, "root").join(ends, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = table.select("doc_id", "n", F.when(linked, F.col("node")).alias("node")).join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id").cast("long")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def closest(pairs: DataFrame) -> DataFrame:
    """src, dst: of pairs (src, dst, apart) each end's with the least apart, ties to the smaller other end."""
    sides = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("src", "dst"), ("dst", "src"))]
    best = pairs.select("apart", F.explode(F.array(*sides)).alias("e")).groupBy("e.node").agg(F.min(F.struct("apart", "e.other")).alias("b"))
    return best.select(F.least("node", "b.other").alias("src"), F.greatest("node", "b.other").alias("dst")).distinct()


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the pairs (src, dst, ...), those whose ends have different roots."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    both = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return both.where(F.coalesce("_src", "src") != F.coalesce("_dst", "dst")).select(*pairs.columns)


def apart(banded: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """node, root, band, and for bands of several components their centre (centre_root, and a class of it, centre), the smallest root
    after an exclusive or with turn."""
    held = banded.select("node", "band").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("root").bitwiseXOR(F.lit(turn)).alias("o"), "node", "root")
    mixed = held.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(order).alias("c")).where("lo <> hi")
    return held.join(mixed.select("band", F.col("c.root").alias("centre_root"), F.col("c.node").alias("centre")), "band")


def kept_documents(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of each group of near duplicates; columns as they are.

    Of ids that are kept and of those that aren't, or that several kept rows have, there is a bitmap each. A row that only one of them
    may hold is settled where it lies; only the others move, to be joined by id.
    """
    found = near_duplicates(docs, k=k, percent=percent).where(F.col("doc_id").isNotNull())
    found = written(found.groupBy(F.col("doc_id").alias("_kept")).agg(F.count_if("kept").alias("_rows")), "kept")
    rows = docs.withColumn("_kept", F.col("doc_id").cast("long"))
    stays, unsure = Bloom(found.where("_rows > 0"), "_kept").column("_kept"), Bloom(found.where("_rows <> 1"), "_kept").column("_kept")
    rows = rows.withColumn("_stays", stays).withColumn("_unsure", unsure)
    whole = rows.where(F.col("_kept").isNull() | (F.col("_stays") & ~F.col("_unsure")))
    # of rows that repeat a kept id one stays
    some = rows.where(F.col("_kept").isNotNull() & F.col("_stays") & F.col("_unsure")).join(found.where("_rows > 0"), "_kept")
    parts = [whole, some.where(F.col("_rows") == 1)]
    if not found.where("_rows > 1").isEmpty():
        parts.append(some.where(F.col("_rows") > 1).dropDuplicates(["_kept"]))
    return reduce(DataFrame.unionByName, [x.select(*docs.columns) for x in parts])
