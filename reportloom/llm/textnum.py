"""Words of many texts at once, as numpy arrays over an Arrow string column.

A batch is taken in blocks of bounded size; a block holds whole texts. Words are runs of word bytes within a text, and a
word's hash is mixed from its bytes, eight at a time. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
U = np.uint64
ODD = [U((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) | U(1) for i in range(1, 33)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words, after A-Z are lowered: everything but ASCII other than digits and letters; everything but ASCII white space.
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
SOLID = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])

KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Block:
    """Texts one after another: data (bytes), and text i from off[i] to off[i + 1]. at: place of text 0 in the batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, at: int):
        self.data, self.off, self.at, self.n = data, off, at, len(off) - 1

    def lowered(self) -> Block:
        return Block(LOWER[self.data], self.off, self.at)

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def words(self, table: np.ndarray) -> Words:
        return Words(self, table)


class Words:
    """All words of a block: start and end (bytes), text (index), first (index of each text's first word, and the end)."""

    def __init__(self, block: Block, table: np.ndarray):
        self.block = block
        data, off = block.data, block.off
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = table[data]
        edge = np.diff(inside)
        cut = off[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word that would run on into the next text
        self.start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])) if len(cut) else np.flatnonzero(edge == 1)
        self.end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut])) if len(cut) else np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(block.n), self.count)

    def hashes(self) -> np.ndarray:
        """64 bits a word."""
        data, length = self.block.data, self.end - self.start
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix((eight[self.start] & KEEP[np.minimum(length, 8)]) * ODD[0] + length.astype(np.uint64))
        more, done = np.flatnonzero(length > 8), 8
        while len(more) and done < 64:
            part = eight[self.start[more] + done] & KEEP[np.minimum(length[more] - done, 8)]
            out[more] = mix(out[more] * ODD[1] + part * ODD[2])
            done += 8
            more = more[length[more] > done]
        for i in more:
            out[i] = xxhash.xxh64_intdigest(data[self.start[i] : self.end[i]].tobytes())
        return out

    def word(self, i: int) -> bytes:
        return self.block.data[self.start[i] : self.end[i]].tobytes()


def sequence_hash(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each start on; different for different n."""
    out = np.full(len(start), n, dtype=np.uint64) * ODD[31]
    for k in range(n):
        out = out * U(0xD6E8FEB86659FD93) + h[start + k] * ODD[k % 16]
    return mix(out)


def blocks(column: pa.Array) -> Iterator[Block]:
    """The column's texts in blocks; a null is an empty text, a text longer than a block stands alone."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j
