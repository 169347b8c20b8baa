"""Line deduplication by an exact set-similarity join.

A line's set is its distinct lower-cased words. A line goes if an earlier one (by document id, then place) has a set with a Jaccard
similarity at the threshold or above. Lines of equal sets are one class, represented by the first; the join runs on classes:

1. Word counts, in a table of fixed size (hash buckets), give the order by rarity.
2. Each class keeps the hashes of its prefix: the rarest words, of which two similar sets must share one.
3. Sorted by prefix word and place, each class is compared with all earlier ones of the word's list by length, position and 108
   parities of the sets. Of what these leave possible it keeps the BEST closest, and says where there are more.
4. Each class is verified on whole sets with its closest candidate, then, if that is not similar, with its others, of which 512 parities
   first rule out what they can. As one similar earlier line settles a class, n similar lines cost a multiple of n verifications.
5. Lists of more than FULL classes, or of keys too frequent for one task, are first compared with the first of the list and the NEAR
   before each. The classes of these lists that are still open are joined with all earlier ones of their lists by key, a join that Spark
   may split. Of other lists in which a class has more candidates of doubtful closeness, such classes and their candidates are kept in
   packed rows; those that classes still open ask for are compared again, without bounds.
6. Classes that are open even then and have more candidates elsewhere meet those in a second pass over the texts.

Texts are read by map passes only. The sets of lines to verify and the documents that lose lines are picked out by Bloom bitmaps
before anything is shuffled; a bitmap has about ten bits an entry up to 128 MB, beyond which it lets through more than needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from annolytics.llm import textnum
from annolytics.llm.tables import scratch, swept, written

#: Buckets of the word-count table: 8 MB, whatever the input.
BUCKETS = 1 << 20
#: Buckets of a row of a task's table.
CHUNK = 1 << 12
#: Neighbours in a list of more than FULL that a class is compared with at once.
NEAR = 64
#: Classes of a list that are all compared with one another in one task.
FULL = 4096
#: Lists of up to SMALL are compared together, longer ones each by itself.
SMALL = 48
#: Candidates that a class keeps from a list.
BEST = 2
#: Parities by which the closest candidate must stay below those expected just beyond the limit for a class to leave its list without the others.
SURE = 8
#: Lines that go are sent to all tasks up to this number (some 32 MB), and joined by document beyond it.
SENT = 2_000_000
#: Entries whose lists are compared at once: what comes out of lists of SMALL is some 25 times as much.
AT_ONCE = 1 << 16
#: Entries of a bucket of keys that a task holds at once: a bucket of more is fed in parts (see Lists).
TOGETHER = 3_000_000
#: Sets of up to SHORT words are joined on pairs of prefix words, longer ones on single words.
SHORT = 12
#: Bits of a Bloom bitmap: 8 MB unless it is made for a known number of entries.
BLOOM_BITS = 1 << 26
#: A bitmap has at most so many bits: 128 MB.
MOST_BITS = 1 << 30
#: Of an entry's hash, where the places of its two bits begin: they don't overlap in a bitmap of MOST_BITS.
SLOTS = (0, 34)
#: Parities by which pairs are told apart before whole sets of theirs move.
ODD = 512
#: Stands for a null id in the order of lines: before all others.
NO_ID = -(1 << 63)


def line_sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks of texts: (first text, text of each line, its number from 0, owner line of each element, element, size of each line).

    Lines without words are left out; elements are the distinct word hashes of a line, sorted.
    """
    for i, j, data, lengths in textnum.blocks(texts):
        h, start, _ = textnum.words(data)
        ends = np.cumsum(lengths + 1)
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        # lines, looked up among the words: words are many more
        before = np.searchsorted(breaks, np.append(0, ends))  # line breaks before each text
        many = np.diff(before) + 1
        text = np.repeat(np.arange(j - i), many)
        number = np.arange(len(text)) - np.repeat(before[:-1] + np.arange(j - i), many)
        words = np.diff(np.searchsorted(start, np.insert(breaks, before[1:], ends - 1)), prepend=0)
        full = np.flatnonzero(words)
        owner, element = textnum.distinct(np.repeat(np.arange(len(full)), words[full]), h)
        yield i, text[full], number[full], owner, element, np.bincount(owner, minlength=len(full))


def table_rows(total: np.ndarray) -> pd.DataFrame:
    """A task's table of BUCKETS counts as rows of packed parts; parts without counts are left out."""
    parts = [(a, total[a : a + CHUNK]) for a in range(0, BUCKETS, CHUNK)]
    return pd.DataFrame([(a, x.astype(np.int64).tobytes()) for a, x in parts if x.any()], columns=["first", "counts"])


def table_sums(rows: DataFrame) -> np.ndarray:
    """The sum of the tables of all tasks (first, counts), of fixed size whatever the input."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in frame["counts"])
        return pd.DataFrame({"first": [frame["first"].iloc[0]], "counts": [total.tobytes()]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    for first, c in rows.groupBy("first").applyInPandas(add, "first int, counts binary").collect():  # BUCKETS / CHUNK rows
        out[first : first + CHUNK] = np.frombuffer(c, dtype=np.int64)
    return out


def counted(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """(lines' distinct words counted by hash bucket, the lines: node (hash of the set), doc_id, line), from one pass over all documents.

    A task gives one table of fixed size; tasks are as many as four times the cluster's cores at most, so that tables don't outgrow the texts.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for frame in frames:
            ids = frame["doc_id"].to_numpy()
            for i, text, number, owner, element, n in line_sets(frame["text"].tolist()):
                total += np.bincount((element & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                yield pd.DataFrame({"node": set_hash(element, n), "doc_id": ids[i + text], "line": number, "counts": None})
        part = table_rows(total)
        yield pd.DataFrame({"node": 0, "doc_id": 0, "line": -1 - part["first"], "counts": part["counts"]})

    cores = docs.sparkSession.sparkContext.defaultParallelism
    both = ordered(docs).coalesce(max(32, 4 * cores)).mapInPandas(textnum.tidy(read), "node long, doc_id long, line long, counts binary")
    both = written(both, "lines")
    tables = both.where("line < 0").select((-1 - F.col("line")).cast("int").alias("first"), "counts")
    return table_sums(tables), both.where("line >= 0").select("node", "doc_id", "line")


class Keys:
    """Join keys of lines, given the counts that order words by rarity."""

    def __init__(self, counts: np.ndarray, percent: int):
        self.percent = percent
        # the leading 16 bits of a float: its sign, exponent and seven more bits
        self.rarity = (counts.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint64)

    def by_rarity(self, owner: np.ndarray, element: np.ndarray) -> np.ndarray:
        """The elements of each line by ascending rarity (counts to eight bits), then by themselves; they come sorted in each line."""
        if not len(owner):
            return element
        rarity = self.rarity[(element & np.uint64(BUCKETS - 1)).astype(np.int64)]
        bits, place = max(1, int(owner[-1]).bit_length()), len(element).bit_length()
        if bits + 16 + place > 64:  # a text of billions of words
            return element[np.lexsort((element, rarity, owner))]
        joint = np.sort((owner.astype(np.uint64) << np.uint64(16 + place)) | (rarity << np.uint64(place)) | np.arange(len(element), dtype=np.uint64))
        return element[(joint & np.uint64((1 << place) - 1)).astype(np.int64)]

    def __call__(self, owner: np.ndarray, element: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, place): two similar sets that differ share a key. Of a pair, the smaller set's size decides the kind of key.

        Up to SHORT words: pairs of words from the n - need + 2 rarest; beyond: single words from the n - need + 1 rarest. Sets a
        little above SHORT have both, as they may meet smaller and larger ones. place: of the word by rarity, 255 for no bound.
        """
        element = self.by_rarity(owner, element)
        first = np.cumsum(n) - n
        need = -(-n * self.percent // 100)
        place = np.arange(len(element)) - first[owner]
        most = n * 100 // self.percent
        alone = (most == n) & (need == n)  # only equal sets are similar
        long = (n > SHORT)[owner] & (place < (n - need + 1)[owner])
        lines, keys, places = [owner[long]], [element[long]], [np.minimum(place[long], 255)]
        reach = np.where((n <= SHORT * 100 // self.percent) & ~alone, n - need + 2, 0)
        for b in range(1, int(reach.max(initial=0))):
            of = np.flatnonzero(reach > b)
            for a in range(b):
                x, y = element[first[of] + a], element[first[of] + b]
                lines.append(of)
                keys.append(textnum.mix(x * np.uint64(0xBF58476D1CE4E5B9) + textnum.mix(y)))
                places.append(np.full(len(of), 255))
        return np.concatenate(lines), np.concatenate(keys), np.concatenate(places)


def set_hash(element: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the set of each line, given its elements one line after the other."""
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(textnum.mix(element ^ np.uint64(0x5BD1E9955BD1E995)), np.cumsum(n) - n)
    return textnum.mix(total + n.astype(np.uint64)).view(np.int64)


def parities(element: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """108 parities of the elements of each line, as 44 and 64 bits: sets differ in at least as many elements as parities."""
    if not len(n):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    at = (textnum.mix(element) >> np.uint64(32)) * np.uint64(108) >> np.uint64(32)
    start, low = np.cumsum(n) - n, at < 44
    bit = np.uint64(1) << np.where(low, at, at - np.uint64(44))
    of = lambda mine: np.bitwise_xor.reduceat(np.where(mine, bit, np.uint64(0)), start)
    return of(low), of(~low)


def odd_parts(owner: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """(n, ODD / 64) unsigned: the parities of the elements of each line in each of ODD parts of the hash space."""
    at = (textnum.mix(element ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(32)) * np.uint64(ODD) >> np.uint64(32)
    out = np.zeros(n * (ODD // 64), dtype=np.uint64)
    np.bitwise_xor.at(out, owner * (ODD // 64) + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.reshape(n, ODD // 64)


def possible(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the packed sizes, places and parities (see entries) of two keys leave a similarity at the threshold possible."""
    nx, ny = ((x >> np.uint64(8)) & np.uint64(4095)).astype(np.int64), ((y >> np.uint64(8)) & np.uint64(4095)).astype(np.int64)
    px, py = (x & np.uint64(255)).astype(np.int64), (y & np.uint64(255)).astype(np.int64)
    need = -(-percent * (nx + ny) // (100 + percent))
    good = np.minimum(nx, ny) * 100 >= percent * np.maximum(nx, ny)
    good &= (px == 255) | (py == 255) | (1 + np.minimum(nx - px, ny - py) - 1 >= need)
    good &= np.bitwise_count((x ^ y) >> np.uint64(20)).astype(np.int64) <= nx + ny - 2 * need
    return good | (nx == 4095) | (ny == 4095)


def ordered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, first bytes first, so that bytes that hardly vary compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def entries(docs: DataFrame, counts: np.ndarray, percent: int, buckets: int, *, first: Bloom, only: Bloom | None = None) -> DataFrame:
    """bucket, n, packed: the join keys (those in `only`) of lines in `first`, by bucket of the key and block of texts, in packed columns.

    An entry is key, node, doc_id, line, meta (44 parities, the size of the set (4095: that or more) and the place of the key's word) and
    far (64 more parities). Equal sets of one block give theirs once. Of a key 40 bits are kept: in a bucket that is enough to tell
    keys apart, and where it is not, unlike keys share a list.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = Keys(shared.value, percent)
        for frame in frames:
            ids = frame["doc_id"].to_numpy()
            for i, text, number, owner, element, n in line_sets(frame["text"].tolist()):
                node = set_hash(element, n)
                where = np.lexsort((number, ids[i + text], node))  # the first line of each set in this block
                once = np.zeros(len(node), dtype=bool)
                once[where[np.append(True, node[where[1:]] != node[where[:-1]])] if len(where) else where] = True
                once &= first.has(ids[i + text], number)
                element, owner = element[once[owner]], (np.cumsum(once) - 1)[owner[once[owner]]]
                text, number, node, n = text[once], number[once], node[once], n[once]
                line, key, place = keys(owner, element, n)
                short = (key & np.uint64((1 << 40) - 1)).view(np.int64)
                if only is not None:
                    keep = only.has(short)
                    line, key, place, short = line[keep], key[keep], place[keep], short[keep]
                if not len(key):
                    continue
                bucket = (textnum.mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                line, short, place, bucket = line[order], short[order], place[order], bucket[order]
                near, far = parities(element, n)
                head = (near << np.uint64(20)) | (np.minimum(n, 4095).astype(np.uint64) << np.uint64(8))
                columns = [
                    short, node[line], ids[i + text[line]], number[line],
                    (head[line] | place.astype(np.uint64)).view(np.int64), far[line].view(np.int64),
                ]
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pd.DataFrame({
                    "bucket": bucket[cuts[:-1]], "n": np.diff(cuts),
                    "packed": [b"".join(planes(np.ascontiguousarray(c[x:y])) for c in columns) for x, y in parts],
                })

    return ordered(docs).mapInPandas(textnum.tidy(make), "bucket long, n long, packed binary")


def packed(x: np.ndarray) -> bytes:
    return b"".join(planes(np.ascontiguousarray(x[:, k])) for k in range(6))


def unpacked(packed: bytes, n: int) -> np.ndarray:
    """(n, 6) long: key, node, doc_id, line, meta, far."""
    return np.stack([unplanes(packed[8 * n * k : 8 * n * (k + 1)]) for k in range(6)], axis=1)


def limits(percent: int) -> np.ndarray:
    """By the sum of two sizes, how many elements may be in one of the sets only."""
    total = np.arange(2 * 4095 + 1)
    out = total - 2 * (-(-percent * total // (100 + percent)))
    return out.astype(np.int16)


def closest(i: np.ndarray, j: np.ndarray, d: np.ndarray, best: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d) of the `best` pairs of each i by d, then j (all, if None), and those i that have more."""
    if best is None or not len(i):
        return i, j, d, i[:0]
    joint = np.sort((i.astype(np.uint64) << np.uint64(40)) | (d.astype(np.uint64) << np.uint64(32)) | j.astype(np.uint64))
    i = (joint >> np.uint64(40)).astype(np.int64)
    lead = np.append(True, i[1:] != i[:-1])
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(lead, np.arange(len(i)), 0))
    keep = rank < best
    return i[keep], (joint[keep] & np.uint64((1 << 32) - 1)).astype(np.int64), ((joint[keep] >> np.uint64(32)) & np.uint64(255)).astype(np.int64), i[rank == best]


def candidates(x: np.ndarray, percent: int, best: int | None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within lists: (node, earlier node, distance of their parities) of the closest possible pairs; (node, key, whether the list is open)
    where a node has more; and the places of such nodes and of all their candidates in open lists, those in which one's closest is not SURE.

    x: entries sorted by key, doc_id and line. wanted: which entries look for earlier ones (all, if None).
    """
    limit = limits(percent)
    expected = 54 * (1 - (1 - 2 / 108) ** np.arange(int(limit.max()) + 2))  # parities in which sets differ, by elements in which they do
    key, node, meta, far = x[:, 0], x[:, 1], np.ascontiguousarray(x[:, 4]).view(np.uint64), np.ascontiguousarray(x[:, 5]).view(np.uint64)
    near, size = meta >> np.uint64(20), ((meta >> np.uint64(8)) & np.uint64(4095)).astype(np.int16)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(x)))
    place = np.arange(len(x)) - np.repeat(start, length)
    asks = (np.repeat(length, length) <= SMALL) & (place > 0)
    asks &= True if wanted is None else wanted
    found, more, unsure, among = [], [], [], []

    def fits(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = limit[a + b]
        return ((d <= most) & (np.abs(a - b) <= most)) | (a == 4095) | (b == 4095)

    def keep(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        every = i, j
        i, j, d, rest = closest(i, j, d, best)
        found.append(np.stack([node[i], node[j], d], axis=1))
        if not len(rest):
            return
        more.append(rest)
        rich = np.zeros(len(x), dtype=bool)
        rich[rest] = True
        rich[every[1][rich[every[0]]]] = True
        among.append(np.flatnonzero(rich))
        lead = np.flatnonzero(np.append(True, i[1:] != i[:-1]) & np.isin(i, rest))
        i, j, d = i[lead], j[lead], d[lead]
        unsure.append(i[(d > expected[limit[size[i] + size[j]] + 1] - SURE) | (size[i] == 4095) | (size[j] == 4095)])

    of, parts, lag = np.flatnonzero(asks), [], 1
    while len(of):
        there = of - lag
        d = np.bitwise_count(near[of] ^ near[there]) + np.bitwise_count(far[of] ^ far[there])
        good = np.flatnonzero(fits(d, size[of], size[there]))
        good = good[(node[of[good]] != node[there[good]]) & possible(meta[of[good]], meta[there[good]], percent)]
        parts.append((of[good], there[good], d[good].astype(np.int64)))
        lag += 1
        of = of[place[of] >= lag]
    if parts:
        keep(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    for a, n in zip(start[length > SMALL].tolist(), length[length > SMALL].tolist(), strict=True):
        for r in range(0, n, 128):
            rows, columns = slice(a + r, a + min(n, r + 128)), slice(a, a + min(n, r + 128))
            d = np.bitwise_count(near[rows, None] ^ near[None, columns]) + np.bitwise_count(far[rows, None] ^ far[None, columns])
            good = fits(d, size[rows, None], size[None, columns])
            if wanted is not None:
                good &= wanted[rows, None]
            i, j = np.nonzero(good)
            good = (j < i + r) & (node[a + r + i] != node[a + j])
            i, j = i[good], j[good]
            if len(i):
                keep(i + a + r, j + a, d[i, j].astype(np.int64))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    if not more:
        return pairs, np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
    of_list, rest, among = np.cumsum(place == 0) - 1, np.concatenate(more), np.unique(np.concatenate(among))
    open_lists = np.zeros(len(start), dtype=bool)
    open_lists[of_list[np.concatenate(unsure)]] = True
    return pairs, np.stack([node[rest], key[rest], open_lists[of_list[rest]]], axis=1), among[open_lists[of_list[among]]]


class Lists:
    """The lists of a bucket's keys, fed in parts: of a list, the first entry and the NEAR last are held."""

    def __init__(self, percent: int):
        self.percent = percent
        self.held: np.ndarray | None = None
        self.places = np.zeros(0, dtype=np.int64)

    def feed(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of nodes that may be similar, entries of lists of more than NEAR + 1)."""
        new = new[np.lexsort((new[:, 1], new[:, 3], new[:, 2], new[:, 0]))]
        held = new[:0] if self.held is None else self.held
        x = np.concatenate([held, new])
        order = np.argsort(x[:, 0], kind="stable")  # held entries come before new ones of their key
        fresh = (np.arange(len(x)) >= len(held))[order]
        known = np.append(self.places, np.full(len(new), -1))[order]
        x = x[order]
        key, node, meta = x[:, 0], x[:, 1], x[:, 4].copy().view(np.uint64)
        at = np.arange(len(x))
        start = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(start, at, 0))
        # a new entry's place: after the last held one of its key
        old = np.cumsum(~fresh)
        old_before = old - (old - ~fresh)[first]  # held entries of this key up to here
        last = np.where(old_before > 0, known[np.minimum(first + np.maximum(old_before - 1, 0), len(x) - 1)], -1)
        place = np.where(fresh, last + 1 + at - first - old_before, known)
        of = np.flatnonzero(fresh)
        out = []
        for lag in range(NEAR + 1):  # 0: the first of the list
            here = of[place[of] >= max(1, lag)]
            if not len(here):
                continue
            there = first[here] if lag == 0 else here - lag
            good = there >= first[here]
            here, there = here[good], there[good]
            good = (node[there] != node[here]) & possible(meta[here], meta[there], self.percent)
            a, b = node[here[good]], node[there[good]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        much = of[place[of] > NEAR]
        turn = of[place[of] == NEAR + 1]  # here a list becomes long: those before it come out too
        much = np.unique(np.concatenate([much, *[turn - k for k in range(1, NEAR + 2)]]))
        end = np.minimum.accumulate(np.where(np.append(start[1:], True), at + 1, len(x) + 1)[::-1])[::-1]
        keep = (at == first) | (end - at <= NEAR)
        rows = x[much]
        self.held, self.places = x[keep], place[keep]
        return pairs, rows


#: Rows of near_in_lists(): a pair of classes; a class (src) with more candidates in a key's list than were kept (dist: 1 if an UNSURE row has them);
#: an entry (of class src) of a long list; of a list in which a class has more candidates and is not sure to be similar to the closest, all such
#: classes and their candidates (dist entries in packed, as from entries()).
PAIR, MORE, LONG, UNSURE = 0, 1, 2, 3


def near_in_lists(found: DataFrame, percent: int, *, best: int | None = BEST, full: int = FULL, together: int = TOGETHER, asked: Bloom | None = None) -> DataFrame:
    """kind, src, dst, dist, key, doc_id, line, meta, far, packed: what the lists of keys say, see PAIR, MORE, LONG and UNSURE. dist: of parities.

    A bucket is read whole, unless it has more than `together` entries; lists of more than `full` classes are compared in part and come
    out. best: None for all candidates. asked: only classes in this bitmap look for earlier ones, and long lists do not come out.
    """
    names = ["kind", "src", "dst", "dist", "key", "doc_id", "line", "meta", "far"]

    def frame(kind: int, *, packed: list[bytes] | None = None, **columns: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, **{c: columns.get(c, 0) for c in names[1:]}, "packed": packed}, index=range(len(columns["key" if packed else "src"])))

    def of_entries(x: np.ndarray) -> pd.DataFrame:
        return frame(LONG, src=x[:, 1], key=x[:, 0], doc_id=x[:, 2], line=x[:, 3], meta=x[:, 4], far=x[:, 5])

    def of_lists(lists: Lists, x: np.ndarray) -> Iterator[pd.DataFrame]:
        pairs, long = lists.feed(x)
        yield frame(PAIR, src=pairs[:, 0], dst=pairs[:, 1])
        yield of_entries(long)

    def whole(x: np.ndarray) -> Iterator[pd.DataFrame]:
        key = np.ascontiguousarray(x[:, 0])
        order = np.argsort(key)
        key = key[order]
        lead = np.append(True, key[1:] != key[:-1])
        x = x[order[~(lead & np.append(lead[1:], True))]]  # without keys of one class only, which are most
        if not len(x):
            return
        x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 0]))]
        same = textnum.mix(textnum.mix(x[:, 0].view(np.uint64)) + x[:, 1].view(np.uint64))  # of a class in a list the first entry stays
        x = x[np.sort(np.unique(same, return_index=True)[1])]
        start = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))
        length = np.diff(np.append(start, len(x)))
        long = np.repeat(length > full, length)
        if long.any():
            if asked is None:
                yield from of_lists(Lists(percent), x[long])
            x = x[~long]
        if not len(x):
            return
        start = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))
        cuts = start[np.flatnonzero(np.diff(start // AT_ONCE, prepend=-1))].tolist()  # whole lists of about AT_ONCE entries
        for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
            part = x[a:b]
            pairs, more, unsure = candidates(part, percent, best, None if asked is None else asked.has(part[:, 1]))
            yield frame(PAIR, src=pairs[:, 0], dst=pairs[:, 1], dist=pairs[:, 2])
            yield frame(MORE, src=more[:, 0], key=more[:, 1], dist=more[:, 2])
            if len(unsure):
                rich = part[unsure]
                of = np.flatnonzero(np.append(True, rich[1:, 0] != rich[:-1, 0]))
                ends = np.append(of[1:], len(rich))
                yield frame(UNSURE, key=rich[of, 0], dist=ends - of, packed=[packed(rich[a:b]) for a, b in zip(of.tolist(), ends.tolist(), strict=True)])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, lists, parts, n = None, None, [], 0

        def done() -> Iterator[pd.DataFrame]:
            if parts and lists is not None:
                if asked is None:
                    yield from of_lists(lists, np.concatenate(parts))
            elif parts:
                yield from whole(np.concatenate(parts))

        for f in frames:
            for b, size, packed in zip(f["bucket"].tolist(), f["n"].tolist(), f["packed"], strict=True):
                if b != bucket:
                    yield from done()
                    bucket, lists, parts, n = b, None, [], 0
                elif n + size > together:
                    lists = lists or Lists(percent)
                    yield from done()
                    parts, n = [], 0
                parts.append(unpacked(packed, size))
                n += size
        yield from done()

    dealt = found.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(textnum.tidy(read), "kind byte, src long, dst long, dist int, key long, doc_id long, line long, meta long, far long, packed binary")


def in_open_lists(lists: DataFrame, percent: int, asked: Bloom) -> DataFrame:
    """src, dst, dist: classes in `asked` with all earlier ones of their lists that are possible, from the UNSURE rows of near_in_lists()."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["dist"].to_numpy(dtype=np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // AT_ONCE, prepend=-1)).tolist()  # whole lists of about AT_ONCE entries
            for i, j in zip(cuts, [*cuts[1:], len(n)], strict=True):
                x = np.concatenate([unpacked(b, m) for m, b in zip(n[i:j].tolist(), f["packed"].iloc[i:j], strict=True)])
                x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 0]))]
                pairs = candidates(x, percent, None, asked.has(x[:, 1]))[0]
                yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1], "dist": pairs[:, 2]})

    return lists.select("dist", "packed").mapInPandas(textnum.tidy(read), "src long, dst long, dist int")


class Bloom:
    """A broadcast bitmap of hashes of some columns, with about ten bits for each of n entries, MOST_BITS at most; an entry sets two."""

    def __init__(self, keys: DataFrame, *columns: str, n: int | None = None):
        n = keys.count() if n is None else n
        self.bits = min(MOST_BITS, 1 << max(20, (10 * n).bit_length()))
        self.shared = keys.sparkSession.sparkContext.broadcast(bloom(keys, *columns, bits=self.bits))

    def has(self, *values: np.ndarray) -> np.ndarray:
        """Whether these values may be among the entries: never false where they are."""
        return both_set(self.shared.value, xxhash(*values))

    def column(self, *columns: str) -> Column:
        shared = self.shared

        @F.pandas_udf("boolean")
        def seen(h: pd.Series) -> pd.Series:
            return pd.Series(both_set(shared.value, h.to_numpy(dtype=np.int64).view(np.uint64)))

        return seen(F.xxhash64(*columns))


def both_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of these hashes are set."""
    out = np.ones(len(h), dtype=bool)
    for shift in SLOTS:  # the second is looked up only where the first is set
        at = np.flatnonzero(out)
        slot = slots(h[at], 8 * len(bitmap), shift)
        out[at] = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
    return out


def bloom(keys: DataFrame, *columns: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bitmap of `bits` bits with those of the columns' hashes set, of known size on the driver."""
    h = keys.select(F.xxhash64(*columns).alias("h"))
    slots = [F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(bits - 1)) + 1 for shift in SLOTS]
    parts = h.select(F.explode(F.array(*slots)).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, part in parts.collect():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(part, dtype=np.uint8)
    return out


def whole_sets(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """node, elements (binary), odd (binary, see odd_parts): the sets of the lines of ends (node, doc_id, line), one row a node. Only their
    lines are read as words."""
    known = Bloom(ends, "doc_id", "line")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [(t or "").split("\n") for t in frame["text"].tolist()]
            many = np.array([len(p) for p in parts])
            number = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            hit = np.flatnonzero(known.has(np.repeat(frame["doc_id"].to_numpy(dtype=np.int64), many), number))
            lines = [line for p in parts for line in p]
            for _, _, _, owner, element, n in line_sets([lines[h] for h in hit.tolist()]):
                node = set_hash(element, n)
                ends = np.cumsum(n)
                once = np.unique(node, return_index=True)[1]
                odd = odd_parts(owner, element, len(n))
                yield pd.DataFrame({
                    "node": node[once], "elements": [element[ends[h] - n[h] : ends[h]].tobytes() for h in once.tolist()],
                    "odd": [odd[h].tobytes() for h in once.tolist()],
                })

    return ordered(docs).mapInPandas(textnum.tidy(make), "node long, elements binary, odd binary").join(ends.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (src, dst) of nodes, those whose whole sets are similar."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            common, total = textnum.in_common(f["ea"].tolist(), f["eb"].tolist())
            yield f.loc[100 * common >= percent * (total - common), ["src", "dst"]]

    pairs = written(pairs, "line-to-verify")
    n = pairs.count()

    def side(node: str, e: str) -> DataFrame:  # the sets of these ends, picked out before anything moves
        own = sets.where(Bloom(pairs, node, n=n).column("node"))
        return own.select(F.col("node").alias(node), F.col("elements").alias(e))

    joined = pairs.join(side("src", "ea"), "src").join(side("dst", "eb"), "dst")
    return joined.select("src", "dst", "ea", "eb").mapInPandas(textnum.tidy(keep), "src long, dst long")


def sifted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (src, dst) of nodes, those that the sizes and parities of their whole sets leave possible: sets differ in at least as many
    elements as parities. A pair moves with these few bytes of each set."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            x, y = (np.frombuffer(b"".join(f[c]), dtype=np.uint64).reshape(len(f), -1) for c in ("oa", "ob"))
            total = f["na"].to_numpy(dtype=np.int64) + f["nb"].to_numpy(dtype=np.int64)
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield f.loc[apart <= total - 2 * (-(-percent * total // (100 + percent))), ["src", "dst"]]

    pairs = written(pairs, "line-to-sift")
    n = pairs.count()

    def side(node: str, s: str) -> DataFrame:
        own = sets.where(Bloom(pairs, node, n=n).column("node"))
        return own.select(F.col("node").alias(node), (F.octet_length("elements") / 8).cast("long").alias(f"n{s}"), F.col("odd").alias(f"o{s}"))

    joined = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return joined.select("src", "dst", "na", "nb", "oa", "ob").mapInPandas(textnum.tidy(keep), "src long, dst long")


def xxhash(*values: np.ndarray) -> np.ndarray:
    """xxhash64(values...) as Spark computes it for longs with seed 42, unsigned."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for v in values:
            h = h + p5 + np.uint64(8) ^ turn(np.ascontiguousarray(v, dtype=np.int64).view(np.uint64) * p2, 31) * p1
            h = turn(h, 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h ^= h >> np.uint64(32)
    return h


def slots(h: np.ndarray, bits: int, shift: int) -> np.ndarray:
    return ((h >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def xxhash_slots(*values: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    """Where the first bits of entries are."""
    return slots(xxhash(*values), bits, SLOTS[0])


def placed(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """src, dst, pl, pe and the other columns of pairs, in order of place: src is the class whose first line is the later one."""
    side = lambda node, p: firsts.select(F.col("node").alias(node), F.struct("doc_id", "line").alias(p))
    joined = pairs.join(side("src", "ps"), "src").join(side("dst", "pd"), "dst")
    late = F.col("ps") > F.col("pd")
    turned = {"src": F.when(late, F.col("src")).otherwise(F.col("dst")), "dst": F.when(late, F.col("dst")).otherwise(F.col("src")), "pl": F.greatest("ps", "pd"), "pe": F.least("ps", "pd")}
    return joined.select(*[v.alias(k) for k, v in turned.items()], *[c for c in pairs.columns if c not in ("src", "dst")])


def settled(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """node: classes with a similar earlier one among the pairs (src, dst, dist), each verified with its closest first, then with its others."""
    pairs = written(placed(written(pairs, "line-near"), firsts), "line-candidates")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), "pl.*"), F.struct(F.col("dst").alias("node"), "pe.*"))).alias("e")).select("e.*")
    sets = written(whole_sets(docs, written(ends.distinct(), "line-ends")), "line-sets")
    swept(docs.sparkSession)
    first = written(pairs.groupBy("src").agg(F.min_by("dst", F.struct("dist", "dst")).alias("dst")), "line-closest")
    gone = written(similar(first, sets, percent).select("src"), "lines-gone")
    others = pairs.select("src", "dst").join(gone, "src", "left_anti").join(first, ["src", "dst"], "left_anti")
    others = sifted(others, sets, percent)  # many, and most of them are not similar
    return written(gone.union(similar(others, sets, percent).select("src")).distinct().select(F.col("src").alias("node")), "lines-gone")


def of_long_lists(open_ones: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """src, dst, dist: classes of open_ones with all earlier ones of their lists (rest) that are possible; both node, key, meta, far, p."""
    open_ones = open_ones.alias("a")
    size = lambda s: F.shiftright(F.col(f"{s}.meta"), 8).bitwiseAND(F.lit(4095))
    place = lambda s: F.col(f"{s}.meta").bitwiseAND(F.lit(255))
    need = F.ceil(percent * (size("a") + size("b")) / F.lit(100.0 + percent) - 1e-9)
    differ = F.bit_count(F.shiftrightunsigned(F.col("a.meta").bitwiseXOR(F.col("b.meta")), 20)) + F.bit_count(F.col("a.far").bitwiseXOR(F.col("b.far")))
    fits = (F.least(size("a"), size("b")) * 100 >= F.greatest(size("a"), size("b")) * percent) & (differ <= size("a") + size("b") - 2 * need)
    fits = fits & ((place("a") == 255) | (place("b") == 255) | (F.least(size("a") - place("a"), size("b") - place("b")) >= need))
    fits = fits | (size("a") == 4095) | (size("b") == 4095)
    pairs = open_ones.join(rest.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("b.p") < F.col("a.p")) & (F.col("a.node") != F.col("b.node")) & fits)
    return pairs.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"), F.lit(0).alias("dist")).distinct()


def gone_lines(docs: DataFrame, *, percent: int = 80, best: int = BEST, full: int = FULL, together: int = TOGETHER) -> DataFrame:
    """doc_id, lines (array of line numbers from 0): the lines that go, for documents that lose any. A null id is NO_ID."""
    if not 60 <= percent <= 100:
        raise ValueError("percent must be 60 to 100")
    counts, lines = counted(docs)
    firsts = written(lines.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("p"), F.count(F.lit(1)).alias("c")).select("node", "p.*", "c"), "line-firsts")
    buckets = min(200_000, max(32, lines.count() * 10 // 200_000))  # of about 200,000 entries
    first = Bloom(firsts, "doc_id", "line")
    found = entries(docs, counts, percent, buckets, first=first)
    near = written(near_in_lists(found, percent, best=best, full=full, together=together), "line-pairs")
    swept(docs.sparkSession)  # the entries
    distinct = lambda df: df.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("dist").alias("dist"))
    gone = settled(distinct(near.where(f"kind = {PAIR}")), firsts, docs, percent)
    asked = near.where(f"kind = {MORE}").groupBy(F.col("src").alias("node"), "key").agg(F.min("dist").alias("out"))
    asked = written(asked.join(gone, "node", "left_anti"), "line-asked")
    more = []
    if not asked.where("out = 1").isEmpty():  # their lists, picked out before anything moves
        lists = near.where(f"kind = {UNSURE}").where(Bloom(asked.where("out = 1"), "key").column("key"))
        more.append(in_open_lists(lists, percent, Bloom(asked, "node")))
    rest = near.where(f"kind = {LONG}").groupBy("key", F.col("src").alias("node"), "meta", "far").agg(F.min(F.struct("doc_id", "line")).alias("p"))
    rest = written(rest, "line-rest")
    if not rest.isEmpty():  # all that are not gone are open
        more.append(of_long_lists(written(rest.join(gone, "node", "left_anti"), "line-open"), rest, percent))
    if more:
        gone = written(gone.union(settled(distinct(reduce(DataFrame.union, more)), firsts, docs, percent)).distinct(), "lines-gone")
    asked = written(asked.where("out = 0").join(gone, "node", "left_anti"), "line-asked")
    if not asked.isEmpty():  # all their candidates, of which the closest were not similar, from the lists that have more
        found = entries(docs, counts, percent, buckets, first=first, only=Bloom(asked, "key"))
        again = near_in_lists(found, percent, best=None, full=full, together=together, asked=Bloom(asked, "node"))
        gone = written(gone.union(settled(distinct(again.where(f"kind = {PAIR}")), firsts, docs, percent)).distinct(), "lines-gone")
    # lines of classes that are gone, and those of other classes that are not the first
    hit = firsts.select("node", F.struct("doc_id", "line").alias("p"), "c").join(gone.withColumn("gone", F.lit(True)), "node", "left").where("gone or c > 1")
    out = lines.join(written(hit, "line-hit"), "node").where(F.col("gone") | (F.struct("doc_id", "line") != F.col("p")))
    return out.select("doc_id", "line").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def deduplicated(docs: DataFrame, *, percent: int = 80, sent: int = SENT) -> DataFrame:
    """docs with later near-duplicate lines taken out of text; n_lines and n_gone (lines before, and taken out) added.

    Lines end at line feeds; those without words stay. Rows without an id come first; rows that repeat an id have their lines in the
    same places, so what is equal in both stays in both. A null text stays null with 0 lines; a text may become empty. The order of
    lines is kept; n_chars, if there, is not touched. An empty table gives an empty result. Columns of docs named n_lines or n_gone
    are replaced.
    """
    with scratch(docs.sparkSession):
        gone = written(gone_lines(docs, percent=percent), "gone", keep=True)
    marked = docs.drop("n_lines", "n_gone").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    marked = marked.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(breaks + 1).cast("long"))
    lost_lines = gone.select(F.col("doc_id").alias("_id"), F.col("lines").alias("_lines"))
    if (gone.agg(F.sum(F.size("lines"))).first()[0] or 0) <= sent:
        some, whole = marked.join(F.broadcast(lost_lines), "_id", "left"), None  # of checked size
    else:  # only texts that may lose lines move
        marked = marked.withColumn("_hit", Bloom(lost_lines, "_id").column("_id"))
        whole = marked.where(~F.col("_hit")).withColumn("n_gone", F.lit(0).cast("long")).drop("_id", "_hit")
        some = marked.where("_hit").drop("_hit").join(lost_lines, "_id", "left")
    every = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("n_lines") - 1), F.col("_lines"))
    # the lines are a variable of the outer function: written into the inner one, the text would be split again for each of its lines
    cut = F.element_at(F.transform(F.array(every), lambda lines: F.array_join(F.transform(stay, lambda i: F.element_at(lines, (i + 1).cast("int"))), "\n")), 1)
    lost = F.col("_lines").isNotNull() & F.col("text").isNotNull() & (F.col("n_lines") > 0)
    # of rows that repeat an id, each has only those of the numbers that its text has
    some = some.withColumn("n_gone", F.when(lost, F.col("n_lines") - F.size(stay)).otherwise(0).cast("long")).withColumn("text", F.when(lost, cut).otherwise(F.col("text")))
    some = some.drop("_id", "_lines")
    return some if whole is None else whole.unionByName(some)
