"""Word hashes of many texts at once, by numpy over their bytes.

A word's hash mixes its bytes eight at a time. Parts of words are hashed by polynomials over randomly mapped bytes modulo 2**64, read
off prefix sums (powers). Everything works on blocks of bounded bytes, so memory doesn't grow with the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
try:
    _libc = ctypes.CDLL(None)
except (OSError, TypeError):  # a system without one
    _libc = None
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random odd 64-bit numbers that stand for the bytes; upper-case ASCII letters share those of lower-case ones.
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: What operators keep between the tasks of a worker, for their own tasks only.
CACHES: list[dict] = []
#: The first n bytes of eight, n from 0 to 8.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 1024


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
                p[done : 2 * done] = p[:done] * U(pow(base, done, 1 << 64))
                done *= 2
            out.append(p)
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look independent of nearby inputs."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def blocks(texts: list[str | None], size: int = 1_000_000, most: int = 1 << 40) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last + 1, their bytes joined by a space, lengths in bytes) of runs of texts of about `size` characters, `most` texts at most;
    null is empty."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or (n + len(texts[j] or "") <= size and j - i < most)):
            n += len(texts[j] or "")
            j += 1
        raw = [(t or "").encode("utf-8", "replace") for t in texts[i:j]]
        yield i, j, b" ".join(raw), np.fromiter(map(len, raw), dtype=np.int64, count=j - i)
        i = j


def prepare(own: dict | None = None) -> None:
    """Have the allocator give back arrays of 8 MB and more as soon as they are dropped, and drop what other operators have left (all but own)."""
    for kept in CACHES:
        if kept is not own:
            kept.clear()
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        _libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD: smaller ones stay till release(), or each array would be paged in anew


def release() -> None:
    """Hand memory that is free back to the system: workers live on between tasks, and the allocator keeps what large arrays leave."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(f, own: dict | None = None):
    """f, a function of an iterator of frames, in a worker that keeps no more memory than it uses. own: what f keeps between tasks."""

    def run(frames):
        prepare(own)
        try:
            yield from f(frames)
        finally:
            release()

    return run


def words(data: bytes, *, lower: bool = True, breaks: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, in order; words are runs of bytes other than ASCII white space.

    breaks: a byte that counts as white space too (it isn't, if None). A word is read eight bytes at a time, all words at once.
    """
    if not data:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if lower:
        data = data.lower()
    buf = np.frombuffer(b" " + data + b" " * 9, dtype=np.uint8)  # a margin on both sides, and for the last eight bytes
    inside = (buf - np.uint8(9) > 4) & (buf != 32)
    if breaks is not None:
        inside &= buf != breaks
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]  # of data: one less than of buf, one more than the edge
    size = end - start
    eight = np.ndarray(len(buf) - 8, dtype="<u8", buffer=buf, offset=1, strides=(1,))
    out = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * U(_BASE))
    left, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        out[left] = mix(out[left] * U(_BASE) + (eight[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out, start, end


def shingles(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the k-word shingles of runs of words hashes[first:first + count]; a run of fewer words is one shingle whole.

    Runs must lie in order without gaps. An empty run has none.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    place = np.arange(n) - np.repeat(first, count)
    left = np.repeat(count, count) - place  # words from here to the end of the run, this one included
    for i in range(k):
        # a run of fewer words adds only its own; its shingle starts at its first word
        within = np.flatnonzero(left > i)
        out[within] = mix(out[within] * U(0xBF58476D1CE4E5B9) + hashes[within + i] + U(i + 1))
    good = (left >= k) | ((place == 0) & (np.repeat(count, count) < k))
    return np.repeat(np.arange(len(count)), count)[good], out[good]


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, value) pairs, sorted by both (values by their leading bits first); owner must be ascending."""
    if not len(owner):
        return owner, value
    bits = max(1, int(owner[-1]).bit_length())
    # one sort of numbers made of owner and leading bits
    joint = (owner.astype(np.uint64) << U(64 - bits)) | (value >> U(bits))
    order = np.argsort(joint)
    joint, value = joint[order], value[order]
    same = joint[1:] == joint[:-1]
    if (same & (value[1:] != value[:-1])).any():  # unlike values with the same leading bits: sorted in full
        order = np.lexsort((value, owner[order]))
        joint, value = joint[order], value[order]
        same = joint[1:] == joint[:-1]
    keep = np.append(True, ~same | (value[1:] != value[:-1]))
    return (joint[keep] >> U(64 - bits)).astype(np.int64), value[keep]


def in_common(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(elements in both, elements of both added up) of pairs of sets, packed 64-bit numbers that don't repeat in a set."""
    size = np.array([(len(x) + len(y)) // 8 for x, y in zip(a, b, strict=True)], dtype=np.int64)
    common = np.zeros(len(a), dtype=np.int64)
    i = 0
    while i < len(a):  # about a million elements at once
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[i:]), 1_000_000)))
        owner = np.repeat(np.arange(j - i), size[i:j])
        value = np.frombuffer(b"".join(e for pair in zip(a[i:j], b[i:j], strict=True) for e in pair), dtype=np.uint64)
        of, _ = distinct(owner, value)
        common[i:j] = size[i:j] - np.bincount(of, minlength=j - i)
        i = j
    return common, size


def document_sets(texts: list[str | None], k: int, *, most: int = 1 << 40) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, owner, hash, size of each text's set) by blocks (see blocks): distinct k-word shingles, lower-cased A-Z."""
    for i, j, data, lengths in blocks(texts, most=most):
        h, start, _ = words(data)
        ends = np.cumsum(lengths + 1)
        bounds = np.searchsorted(start, ends)
        count = np.diff(bounds, prepend=0)
        owner, value = distinct(*shingles(h, bounds - count, count, k))
        yield i, owner, value, np.bincount(owner, minlength=j - i)
