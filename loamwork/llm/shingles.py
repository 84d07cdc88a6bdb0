"""Hashed word shingles of whole batches of texts (numpy; runs inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    up = down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(n, base, U)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=U))
        return cls.up, cls.down


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(at: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles of texts; words are runs without ASCII white space, A-Z lowered.

    A text of fewer words, but one at least, is one shingle. Hashes have 64 bits; rows ascend.
    """
    n = len(raw)
    low = LOWER[raw]
    word = ~SPACE[low]
    begin = np.zeros(n + 1, bool)
    begin[at[:-1]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begin[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | begin[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.to(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[:n], dtype=U, out=sums[1:])
    words = mix((sums[e] - sums[s]) * down[s])
    row = np.searchsorted(at, s, "right") - 1
    many = np.bincount(row, minlength=len(at) - 1)
    m = len(words) - k + 1
    if m > 0:
        h = np.zeros(m, U)
        for j in range(k):
            h = h * U(0xD6E8FEB86659FD93) + words[j : j + m]
        whole = row[:m] == row[k - 1 :]
        h, r = mix(h[whole] + U(k)), row[:m][whole]
    else:
        h, r = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < k))
    if len(short):
        ends = np.cumsum(many)
        extra = []
        for i in short:
            x = U(0)
            with np.errstate(over="ignore"):
                for w in words[ends[i] - many[i] : ends[i]]:
                    x = x * U(0xD6E8FEB86659FD93) + w
                extra.append(x + U(many[i]))
        h, r = np.concatenate([h, mix(np.array(extra, U))]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    raw, at = text_buffers(column)
    for i, j in slices(at):
        h, r = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
        cuts = np.searchsorted(r, np.arange(j - i + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield np.unique(h[a:b])
