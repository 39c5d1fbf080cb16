"""One pass of a byte transducer over texts, and a verified hash table of the words it finds (operators 11 and 13).

The transducer is two tables: ``CLASSES`` gives each byte's class and ``NEXT`` the state after a byte of that class. Every
class leads to one state from all states, so a whole chunk takes its states from one look-up of the bytes before; the
only state carried from chunk to chunk is the last byte's. A move from outside to inside a word starts a span, the move
back ends it. Bytes that continue a code point are a class of their own: all others begin one.

Words of a chunk go into an open-addressing table together: a round sends every word to its next slot, free slots take
the first that comes, and a word is settled when its slot's word has the same owner, hash, length and bytes. So equal
hashes alone never make two words one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .windows import mix

#: Bytes of text that a chunk holds at most (one longer word makes a longer chunk); bytes of a word that are compared as numbers, longer ones as strings.
CHUNK, SHORT = 1 << 20, 64
GAP, PLAIN, CAPITAL, SYMBOL, INNER = range(5)
OUTSIDE, INSIDE = 0, 1
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
_odd = np.uint64(0x9E3779B97F4A7C15)
_masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def classes(gap: bytes, symbols: bytes = b"") -> np.ndarray:
    """The class of each byte: gaps, symbols, A-Z, bytes 0x80-0xBF, which continue a code point, and all others."""
    table = np.full(256, PLAIN, np.uint8)
    table[0x80:0xC0] = INNER
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[list(symbols)] = SYMBOL
    table[list(gap)] = GAP
    return table


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (null: empty) and the borders between its rows."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, classes of the bytes, starts, ends of the spans) of pieces of ``data``, cut where no span is."""
    size, at, n = size or CHUNK, 0, len(data)
    edges = np.unique(bounds)
    next_edge = lambda place: int(edges[np.searchsorted(edges, place)])
    while at < n:
        end = min(at + size, n)
        while end < next_edge(end) and (NEXT[table[data[end - 1 : end + 1]]] == INSIDE).all():  # no cut inside a word
            outside = NEXT[table[data[end : end + size]]] == OUTSIDE
            end = min(end + (int(outside.argmax()) if outside.any() else len(outside)), next_edge(end))
        kind = table[data[at:end]]
        state = NEXT[kind]
        border = edges[np.searchsorted(edges, at) : np.searchsorted(edges, end, side="right")] - at
        before = np.concatenate([[OUTSIDE], state[:-1]])
        before[border[border < len(state)]] = OUTSIDE
        after = np.concatenate([state[1:], [OUTSIDE]])
        after[border[border > 0] - 1] = OUTSIDE
        yield at, kind, at + np.flatnonzero((state == INSIDE) & (before == OUTSIDE)), at + np.flatnonzero((state == INSIDE) & (after == OUTSIDE)) + 1
        at = end


class Words:
    """Hashes and equality of spans of ``data``, by pieces of eight bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))

    def piece(self, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.eight[start]).view("<u8")[:, 0] & _masks[np.minimum(left, 8)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(self.piece(start, size) + size.astype(np.uint64) * _odd)
        more = np.flatnonzero((size > 8) & (size <= SHORT))
        at = 8
        while len(more):
            out[more] = mix((out[more] ^ self.piece(start[more] + at, size[more] - at)) + _odd)
            at += 8
            more = more[size[more] > at]
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[start[k] : end[k]].tobytes(), 42)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` bytes from a and from b are the same."""
        out = self.piece(a, size) == self.piece(b, size)
        more, at = np.flatnonzero(out & (size > 8) & (size <= SHORT)), 8
        while len(more):
            out[more] = self.piece(a[more] + at, size[more] - at) == self.piece(b[more] + at, size[more] - at)
            at += 8
            more = more[out[more] & (size[more] > at)]
        for k in np.flatnonzero(out & (size > SHORT)).tolist():
            out[k] = np.array_equal(self.data[a[k] : a[k] + size[k]], self.data[b[k] : b[k] + size[k]])
        return out


class Table:
    """Different words by owner (the text they are in): an open-addressing table over spans of one ``Words``."""

    def __init__(self, words: Words, slots: int = 1 << 12):
        self.words, self.slots = words, np.full(slots, -1, np.int64)
        self.owner, self.hash, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _place(self, keys: np.ndarray, entry: np.ndarray, same) -> np.ndarray:
        """For each key the entry its slot holds in the end: its own, or one that ``same`` finds equal."""
        out, open_, probe, mask = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, np.uint64(len(self.slots) - 1)
        while len(open_):
            slot = ((keys[open_] + np.uint64(probe)) & mask).astype(np.int64)
            free = self.slots[slot] < 0
            self.slots[slot[free][::-1]] = entry[open_[free]][::-1]  # of several, the first
            held = self.slots[slot]
            settled = held == entry[open_]
            other = np.flatnonzero(~settled)
            settled[other] = same(open_[other], held[other])
            out[open_[settled]] = held[settled]
            open_, probe = open_[~settled], probe + 1
        return out

    def _grown(self, more: int) -> None:
        size = len(self.slots)
        while size < 2 * (len(self.owner) + more):
            size *= 2
        if size > len(self.slots):
            self.slots = np.full(size, -1, np.int64)
            self._place(self._keys(self.owner, self.hash), np.arange(len(self.owner)), lambda a, b: np.zeros(len(a), bool))

    @staticmethod
    def _keys(owner: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        return mix(hashed + owner.astype(np.uint64) * _odd)

    def insert(self, owner: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each word; entries are numbered as they come."""
        self._grown(len(owner))
        known, size = len(self.owner), end - start
        owners, hashes, starts, sizes = (np.concatenate(x) for x in ((self.owner, owner), (self.hash, hashed), (self.start, start), (self.size, size)))

        def same(own: np.ndarray, held: np.ndarray) -> np.ndarray:
            out = (owners[held] == owner[own]) & (hashes[held] == hashed[own]) & (sizes[held] == size[own])
            likely = np.flatnonzero(out)
            out[likely] = self.words.equal(starts[held[likely]], start[own[likely]], size[own[likely]])
            return out

        found = self._place(self._keys(owner, hashed), np.arange(known, known + len(owner)), same)
        new = found == np.arange(known, known + len(owner))
        number = np.concatenate([np.arange(known), known - 1 + np.cumsum(new)])
        self.slots[self.slots >= known] = number[self.slots[self.slots >= known]]
        kept = np.concatenate([np.ones(known, bool), new])
        self.owner, self.hash, self.start, self.size = owners[kept], hashes[kept], starts[kept], sizes[kept]
        return number[found]
