"""Ids of a word-end BPE tokenizer for many words at once.

A text's ids are the ids of its white-space separated chunks, one after another, because the tokenizer drops white space before it
merges. So chunks are looked up in a bounded memo, and only new ones are encoded: those of plain letters, digits and punctuation by
merging all of them in step with numpy, any other (apostrophes, "<", other scripts) by the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from annolytics.llm import textnum

#: Chunks merged in step at once, and characters of texts split at once: a worker's arrays and words are bounded by them.
TOGETHER, CHARACTERS = 1 << 14, 1 << 18
#: Bytes of a chunk beyond which it is left to the tokenizer: in step one pair of a piece is merged at a time.
LONGEST = 256
#: Chunks (any number, a line each) for which splitting by class and lower-casing is the same as what the tokenizer does: no apostrophe
#: (contractions), no "<" (special tokens), and of letters beyond ASCII only those of Latin-1 and Latin Extended-A, which compose with
#: nothing here, but for the dotted capital I, whose lower case is two characters.
PLAIN = re.compile(r"[\n!-&(-;=-~À-ÖØ-öø-įı-ſ]+")
#: Texts that may be lower-cased whole before they are split: the tokenizer does so too, after it has looked for special tokens.
EVEN = re.compile(r"[\t-\r -;=-~À-ÖØ-öø-įı-ſ]*")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkEncoder:
    """bytes of a chunk -> bytes of its ids (little-endian unsigned 32 bits)."""

    def __init__(self, path: str, *, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        #: Ids by chunk, and those of the memo before, from which chunks seen again come back: half of `most` each, or one block's chunks.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        names = byte_symbols()
        self.inner = np.array([vocab[names[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[names[b] + "</w>"] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        keys = (left << np.uint64(20)) | right
        # open addressing: 2**20 slots, a second table of displaced keys in order
        slot = self.slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys = np.full(1 << 20, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full(1 << 20, self.none, dtype=np.int64)
        self.keys[slot[first]], self.ranks[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        order = np.argsort(keys[rest])
        self.rest_keys, self.rest_ranks = keys[rest][order], rest[order]
        self.crowded = np.zeros(1 << 20, dtype=bool)
        self.crowded[slot[rest]] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], self.none)
        for_rest = np.flatnonzero(self.crowded[slot] & (out == self.none))
        if len(for_rest):
            at = np.searchsorted(self.rest_keys, keys[for_rest])
            at = np.minimum(at, len(self.rest_keys) - 1)
            hit = self.rest_keys[at] == keys[for_rest]
            out[for_rest[hit]] = self.rest_ranks[at[hit]]
        return out

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of lower-cased plain chunks."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        digit = (data >= 48) & (data <= 57)
        letter = (data >= 128) | ((data >= 97) & (data <= 122))
        kind = np.where(letter, 0, np.where(digit, 1, 2))
        starts = np.ones(len(data), dtype=bool)
        starts[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | digit[1:]
        ends = np.append(starts[1:], True)
        symbol = np.where(ends, self.final[data], self.inner[data])
        piece = np.cumsum(starts) - 1
        piece_owner = owner[starts]
        done_symbol, done_piece = [], []
        while len(symbol):
            joined = piece[1:] == piece[:-1]
            ranks = np.full(len(symbol), self.none, dtype=np.int64)
            at = np.flatnonzero(joined)
            ranks[at] = self.rank(symbol[at], symbol[at + 1])
            first = np.flatnonzero(np.append(True, ~joined))
            lowest = np.minimum.reduceat(ranks, first)
            size = np.diff(np.append(first, len(symbol)))
            live = np.repeat(lowest < self.none, size)
            done_symbol.append(symbol[~live])
            done_piece.append(piece[~live])
            if not live.any():
                break
            # merge the leftmost pair of the lowest rank in each piece
            is_lowest = live & (ranks == np.repeat(lowest, size))
            at = np.flatnonzero(is_lowest)
            at = at[np.append(True, piece[at[1:]] != piece[at[:-1]])]
            symbol[at] = self.made[ranks[at]]
            live[at + 1] = False
            symbol, piece = symbol[live], piece[live]
        symbol, piece = np.concatenate(done_symbol), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        ids = symbol[order].astype("<u4")
        counts = np.bincount(piece_owner[piece], minlength=len(words))
        cuts = np.append(0, np.cumsum(counts)) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, chunks: set[bytes]) -> None:
        """Have the memo hold all of chunks. Only they are gone through, never the memo, which may be much larger."""
        fresh = chunks.difference(self.memo)
        if len(self.memo) + len(fresh) > self.most // 2:
            self.memo, self.older = {}, self.memo
            fresh = chunks
        order = list(fresh.difference(self.older))
        if len(order) < len(fresh):
            self.memo.update((c, self.older[c]) for c in fresh.difference(order))
        if not order:
            return
        whole = b"\n".join(order).decode()
        other = []
        if max(map(len, order)) > LONGEST or not PLAIN.fullmatch(whole):
            plain = []
            for c, name in zip(order, whole.split("\n"), strict=True):
                (plain if len(c) <= LONGEST and PLAIN.fullmatch(name) else other).append(c)
            order, whole = plain, b"\n".join(plain).decode()
        lowered = whole.lower().encode().split(b"\n")
        for i in range(0, len(order), TOGETHER):
            self.memo.update(zip(order[i : i + TOGETHER], self.merged(lowered[i : i + TOGETHER]), strict=True))
        if other:
            found = self.tokenizer.encode_batch([c.decode() for c in other], add_special_tokens=False)
            self.memo.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(other, found, strict=True))

    def encode(self, texts: list[str], *, block: int = CHARACTERS):
        """Yields the bytes of each text's ids, in order; works on `block` characters at a time."""
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= block):
                n += len(texts[j])
                j += 1
            split = [(t.lower() if EVEN.fullmatch(t) else t).encode("utf-8", "replace").split() for t in texts[i:j]]
            self.learn(set().union(*split))
            memo = self.memo
            for words in split:
                yield b"".join(map(memo.__getitem__, words))
            i = j


_ENCODERS: dict[str, ChunkEncoder] = {}
textnum.CACHES.append(_ENCODERS)


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
