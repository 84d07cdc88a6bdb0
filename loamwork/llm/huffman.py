"""Canonical length-limited Huffman codes and blocks of coded token ids (numpy; runs inside tasks).

A block is a header, an index of its documents, the lengths in bits of its stretches of STRIDE ids, and the codes, most
significant bit first, in big-endian 32-bit words. The sums of the lengths are the bit offsets of the checkpoints: every
STRIDE-th id can be decoded without those before it, and all stretches of a block are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"LWHT"
STRIDE = 256
#: magic, part, block, checksum of all that follows, ids of the part before the block, documents, ids, bits, bytes of the block
HEADER = struct.Struct("<4sIIIQIQQQ")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol in the best prefix code of at most `limit` bits (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    items, leaf = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        items = both[at]
        leaf.append(at < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(leaf):  # of the first `take` items, the leaves are the lightest symbols; the rest are pairs
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = bits
    return out


class Code:
    """The canonical code of the given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.order = np.lexsort((np.arange(len(lengths)), self.lengths))
        self.order = self.order[self.lengths[self.order] > 0]
        self.most = int(self.lengths.max(initial=0))
        bits = self.lengths[self.order].astype(np.int64)
        step = np.left_shift(np.int64(1), self.most - bits)
        self.start = np.concatenate([[0], np.cumsum(step)[:-1]]) if len(bits) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[self.order] = self.start >> (self.most - bits)
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, bits) for every string of `most` bits."""
        if self.table is None:
            bits = self.lengths[self.order]
            wide = np.left_shift(np.int64(1), self.most - bits.astype(np.int64))
            ids, length = np.zeros(1 << self.most, np.uint32), np.ones(1 << self.most, np.uint8)
            n = int(wide.sum())
            ids[:n], length[:n] = np.repeat(self.order, wide), np.repeat(bits, wide)
            self.table = ids, length
        return self.table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """(words, bits of each stretch of STRIDE ids, bits in all)."""
        bits = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(bits)
        total = int(ends[-1]) if len(ends) else 0
        at = ends - bits
        place = np.left_shift(self.codes[ids].astype(np.uint64), (64 - (at & 31) - bits).astype(np.uint64))
        word = at >> 5
        words = np.zeros((total + 31) // 32 + 1, np.uint64)
        for shift, off in ((np.uint64(32), 0), (np.uint64(0), 1)):  # a code touches at most two words; the sums are of separate bits
            part = ((place >> shift) & np.uint64(0xFFFFFFFF)).astype(np.float64)
            got = np.bincount(word, part, len(words) - off)
            words[off:] |= got.astype(np.uint64)[: len(words) - off]
        marks = np.concatenate([at[::STRIDE], [total]])
        return words[:-1].astype(">u4").tobytes(), np.diff(marks).astype(np.uint16), total

    def decode(self, data: np.ndarray, first_bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of stretches: data holds the words (and two more), stretches begin at first_bit and have count ids, STRIDE but for those at a block's end."""
        out = np.zeros((len(count), STRIDE), np.uint32)
        symbol, length = self.tables()
        pos, shift = first_bit.astype(np.int64), np.uint64(64 - self.most)
        wide = data.astype(np.uint64)
        pair = (wide[:-1] << np.uint64(32)) | wide[1:]
        order = np.argsort(-count, kind="stable")  # the stretches that go on are always the first
        pos, left = pos[order], count[order]
        for k in range(int(count.max(initial=0))):
            live = len(left) if left[-1] > k else int(np.searchsorted(-left, -k, "left"))
            p = pos[:live]
            x = (pair[p >> 5] << (p & 31).astype(np.uint64)) >> shift
            out[order[:live], k] = symbol[x]
            pos[:live] = p + length[x]
        return out


def write_block(code: Code, part: int, block: int, first: int, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block of whole documents: (doc_id or None, ids)."""
    sizes = np.array([len(x) for _, x in docs], "<u8")
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    words, stretches, bits = code.encode(ids)
    names = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], np.uint8).tobytes()
    body = names + sizes.tobytes() + stretches.astype("<u2").tobytes() + words
    return HEADER.pack(MAGIC, part, block, zlib.crc32(body), first, len(docs), len(ids), bits, HEADER.size + len(body)) + body


def read_blocks(data: bytes, code: Code, most: int = 1 << 20) -> Iterator[tuple[int, int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, block, first, doc_ids, sizes, ids) of the blocks of a file, a line feed after each; about `most` ids are decoded side by side."""
    at, waiting, n = 0, [], 0
    while at < len(data):
        magic, part, block, crc, first, docs, ids, bits, size = HEADER.unpack_from(data, at)
        body = memoryview(data)[at + HEADER.size : at + size]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a whole block of token ids")
        waiting.append((part, block, first, docs, ids, body))
        at, n = at + size + 1, n + ids
        if n >= most or at >= len(data):
            yield from _decoded(waiting, code)
            waiting, n = [], 0


def _decoded(blocks: list[tuple], code: Code) -> Iterator[tuple]:
    words, starts, counts, heads, base = [], [], [], [], 0
    for part, block, first, docs, ids, body in blocks:
        n = -(-ids // STRIDE)
        a, b, c = 9 * docs, 17 * docs, 17 * docs + 2 * n
        null = np.frombuffer(body[8 * docs : a], np.uint8)
        names = [None if z else x for x, z in zip(np.frombuffer(body[: 8 * docs], "<i8").tolist(), null, strict=True)]
        stretch = np.frombuffer(body[b:c], "<u2").astype(np.int64)
        w = np.frombuffer(body[c:], ">u4")
        words.append(w)
        starts.append(32 * base + np.concatenate([[0], np.cumsum(stretch)[:-1]]) if n else np.zeros(0, np.int64))
        counts.append(np.minimum(STRIDE, ids - STRIDE * np.arange(n)))
        heads.append((part, block, first, names, np.frombuffer(body[a:b], "<u8").astype(np.int64), n, ids))
        base += len(w)
    data = np.concatenate([*words, np.zeros(2, ">u4")]).astype(np.uint32)
    rows = code.decode(data, np.concatenate(starts), np.concatenate(counts))
    row = 0
    for part, block, first, names, sizes, n, ids in heads:
        yield part, block, first, names, sizes, rows[row : row + n].reshape(-1)[:ids]
        row += n
