"""Operator 4: byte-level BPE with a hierarchical-bitmap rank queue.

The symbols of a pre-token form a linked list. Each merge rank has a bucket of list positions; a bitmap
of two levels (words of 256 ranks, and one word that tells which are not empty) gives the lowest rank
by find-first-set. Positions whose pair has changed meanwhile are stale and skipped when popped. A
merge costs a few operations however long the pre-token is, so one of millions of bytes needs no
quadratic scan. Equal ranks merge from the left, as the public encoders do.

Pre-tokens repeat: a worker encodes each distinct one once and keeps its ids, within a bound.
Null texts count as empty; repeated rows are encoded once each, long texts whole (in parts cut where a
pre-token starts anyway); an empty table gives no rows; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_slice, texts

LATIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The usual split pattern for texts of the characters above, in the terms of ``re``.
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK, WORD = 1 << 19, 256

_coders: dict[tuple, ByteBpe] = {}


class RankQueue:
    """Positions by rank: push, and pop of the leftmost position of the lowest rank."""

    def __init__(self, ranks: int):
        self.words, self.top, self.buckets = [0] * (ranks // WORD + 1), 0, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.words[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        k = (self.top & -self.top).bit_length() - 1
        word = self.words[k]
        rank = (k << 8) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word &= word - 1
            self.words[k] = word
            if not word:
                self.top &= self.top - 1
        return rank, position


class ByteBpe:
    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.symbols: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for symbol, rank in self.ranks.items():
            self.symbols[rank] = symbol
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern, self.usual = regex.compile(pattern), pattern == USUAL
        self.queue = RankQueue(len(self.symbols))  # empty between uses
        self.kept = Memo(lambda piece: array("I", self.merge(piece.encode())).tobytes())

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, get, queue = len(data), self.ranks.get, self.queue
        ends, before, ids = list(range(1, n + 1)), list(range(-1, n - 1)), [self.bytes[b] for b in data]
        waiting = [-1] * n  # rank of the pair that starts at a position
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                queue.push(rank, i)
        while (found := queue.pop()) is not None:
            rank, i = found
            if waiting[i] != rank:
                continue  # stale
            j = ends[i]
            end = ends[j]
            ends[i], ids[i], waiting[j], ids[j] = end, rank, -1, -1
            waiting[i] = -1
            if end < n:
                before[end] = i
                if (right := get(data[i : ends[end]])) is not None:
                    waiting[i] = right
                    queue.push(right, i)
            if (h := before[i]) >= 0:
                left = get(data[h:end])
                if left is None:
                    waiting[h] = -1
                elif waiting[h] != left:
                    waiting[h] = left
                    queue.push(left, h)
        return [x for x in ids if x >= 0]

    def _pieces(self, text: str) -> list[str]:
        return LATIN_SPLIT.findall(text) if self.usual and LATIN.fullmatch(text) else self.pattern.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.kept.joined(self._pieces(chunk)) for chunk in self.chunks(text))

    def chunks(self, text: str):
        """Parts of a long text; a single space between two other characters always starts a pre-token of the usual pattern."""
        at = 0
        while self.usual and len(text) - at > CHUNK and (cut := CUT.search(text, at + CHUNK)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.symbols.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(ranks_file: bytes, pattern: str) -> ByteBpe:
    key = hashlib.md5(ranks_file).digest(), pattern
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(ranks_file, pattern)
    return _coders[key]


def _over_texts(docs: DataFrame, ranks: str, pattern: str, row, fields: str) -> DataFrame:
    """``row(coder, text)`` for every document, behind its doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())
    kinds = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}
    names, types = zip(*(x.split() for x in fields.split(", ")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(sent.value, pattern)
        columns = zip(*(row(own, t) for t in texts(batch)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kinds[t]) for c, t in zip(columns, types))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(by_slice(run), f"doc_id bigint, {fields}")


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded bytes of every text."""

    def row(own: ByteBpe, text: str):
        ids = own.encode(text)
        return len(ids) // 4, ids, own.decode(ids)

    return _over_texts(docs, ranks, pattern, row, "n_tokens bigint, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """As ``encoded``, with SHA-256 digests taken in the task in place of the bytes."""

    def row(own: ByteBpe, text: str):
        ids = own.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _over_texts(docs, ranks, pattern, row, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
