"""Hashes of words and word windows for many texts at once, in numpy. Runs in Python workers; holds a few MB at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: The bytes that part words.
_PARTS = np.zeros(256, bool)
_PARTS[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_ROOT = 0x9E3779B97F4A7C15
#: Bytes that are hashed, and texts that are gathered, at a time: few enough for a core's cache. A longer word or text goes alone.
CHUNK = 1 << 17
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the root and of its inverse modulo 2 ** 64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, CHUNK + 4096) - 1, r, np.uint64)]) for r in (_ROOT, pow(_ROOT, -1, 2**64))]
    return _powers


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs without white space. A hash depends on the word alone."""
    buf = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, _PARTS[buf], True].view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        seg = buf[low : ends[j - 1]]
        up, down = _power_tables(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_TABLE[seg] * up[: len(seg)], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        hashes[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return starts, ends, hashes


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of so many consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(size):
        out = out * np.uint64(_ROOT) + h[j : j + n]
    return mix(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes."""
    s = np.sort(h)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def long_windows(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """As `windows`, by differences of running sums; for long windows, and another hash."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(seed)) * up[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def gathered(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[tuple[int, int]], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about CHUNK bytes: their numbers, the range of words of each, the joined bytes, and their words."""
    numbers, parts, total = [], [], 0

    def group():
        data = b"\n".join(parts)
        starts, ends, h = words(data)
        firsts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        at = np.searchsorted(starts, firsts)
        return numbers, list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), data, starts, ends, h

    for k, text in enumerate(texts):
        numbers.append(k)
        parts.append(text)
        total += len(text)
        if total >= CHUNK:
            yield group()
            numbers, parts, total = [], [], 0
    if numbers:
        yield group()
