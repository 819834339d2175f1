"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The positions of mergeable pairs lie in buckets, one for each merge rank; a bitmap of the ranks whose bucket is not empty,
with another one of its words above it, gives the least rank by finding the first set bit twice. Symbols are a linked
list over byte positions. A merge changes the pairs on both its sides; what the buckets still hold of old pairs is stale and
skipped when it comes up. A pre-token of n bytes takes O(n) queue operations however long it is, where rescanning all pairs
after each merge takes O(n * n). One queue serves hundreds of short pre-tokens, with gaps between them that no pair crosses: a
bucket is then emptied in one go, unless a merge gives a pair of a lesser rank, which comes first.

A pre-token that is itself in the vocabulary is one id, whatever merges would make of it. Ids are those of the tiktoken
library without special tokens. Null and empty texts have no ids; null lists of ids decode to no bytes. Repeated rows are
encoded alike. Other columns are ignored. Empty tables give no rows. Narrow passes: nothing is shuffled.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate, batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import parts

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bits of a word of the bitmaps; two levels hold WORD_BITS ** 2 ranks.
SHIFT = 9
WORD_BITS = 1 << SHIFT
MASK, BIT = WORD_BITS - 1, [1 << k for k in range(WORD_BITS)]
#: Bytes of pre-tokens merged together, up to which plain lists are used, which are faster than arrays and larger.
TOGETHER = 1 << 12
#: Characters of texts whose new pre-tokens are merged together, and pre-tokens that are taken from a longer text at a time.
CHARACTERS, PIECES = 1 << 20, 1 << 18
#: Pre-tokens remembered by a worker, and the longest of them in characters.
MOST_KNOWN, LONGEST_KNOWN = 3 << 17, 48


class Known(dict):
    """Ids of the pre-tokens met so far, as 32-bit numbers in a row, by the text of each; a bounded number of short ones is remembered.

    A new pre-token gets an empty bytearray, which `settle` fills. When they are more than MOST_KNOWN they become the old ones,
    which go with the next such change unless they are met again.
    """

    def __init__(self, merged: Callable[[list[bytes]], Iterable[bytes]]):
        super().__init__()
        self._merged, self._old, self._new = merged, {}, {}

    def __missing__(self, piece: str) -> bytes | bytearray:
        if (found := self._old.get(piece)) is None and (found := self._new.get(piece)) is None:
            found = self._new[piece] = bytearray()
        if len(piece) <= LONGEST_KNOWN:
            self[piece] = found
        return found

    def settle(self) -> None:
        """Give the new pre-tokens their ids."""
        new, self._new = self._new, {}
        for (piece, waiting), ids in zip(new.items(), self._merged([piece.encode() for piece in new])):
            waiting[:] = ids
            if len(piece) <= LONGEST_KNOWN:
                self[piece] = ids
        if len(self) > MOST_KNOWN:
            self._old = dict(self)
            self.clear()


class Vocabulary:
    """Ranks of byte strings, which are their ids too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= WORD_BITS**2:
            raise ValueError(f"a vocabulary of more than {WORD_BITS**2} ranks")
        self.ranks, self.pieces, self.known = ranks, regex.compile(pattern), Known(self._merged)
        self._spelled = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self._spelled[rank] = piece
        self.spelled, self._lengths = pa.array(self._spelled, pa.binary()), np.array(list(map(len, self._spelled)))
        self._bytes = np.array([ranks.get(bytes([k]), -2) for k in range(256)])  # -2: a byte without an id
        self._pairs = np.array([ranks.get(bytes([k >> 8, k & 255]), -1) for k in range(1 << 16)])
        self._low = [0] * WORD_BITS  # all zero between two calls

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return memoryview(next(self._merged([piece]))).cast("i").tolist()

    def _merged(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of each pre-token, as 32-bit numbers in a row."""
        at = 0
        while at < len(pieces):
            some, size = [], 0
            while at < len(pieces) and (not some or size + len(pieces[at]) < TOGETHER):
                some.append(pieces[at])
                size += len(pieces[at]) + 1
                at += 1
            found = [None if (whole := self.ranks.get(piece)) is None else whole.to_bytes(4, sys.byteorder) for piece in some]
            merged = self._merged_together([piece for piece, ids in zip(some, found) if ids is None])
            yield from (next(merged) if ids is None else ids for ids in found)

    def _merged_together(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of pre-tokens that are not in the vocabulary, by one queue for all of them."""
        if not pieces:
            return
        data, low, bit, top, buckets, get = b"\0" + b"\0".join(pieces) + b"\0", self._low, BIT, 0, {}, self.ranks.get
        n, gaps = len(data), np.cumsum([0, *(len(piece) + 1 for piece in pieces)])  # no symbol is where the gaps are, nor a pair across them
        letters = np.frombuffer(data, np.uint8).astype(np.int64)
        symbol = self._bytes[letters]
        ranks = np.append(self._pairs[letters[:-1] << 8 | letters[1:]], -1)
        symbol[gaps] = ranks[gaps] = ranks[gaps - 1] = -1

        order = np.argsort(ranks, kind="stable")[np.count_nonzero(ranks < 0) :]
        found, starts = np.unique(ranks[order], return_index=True)
        places, starts = order.tolist(), [*starts.tolist(), len(order)]
        for rank, a, b in zip(found.tolist(), starts, starts[1:]):
            buckets[rank] = places[a:b]  # heaps: of one rank the leftmost comes first
            low[rank >> SHIFT] |= bit[rank & MASK]
            top |= bit[rank >> SHIFT]
        held = list if n <= 2 * TOGETHER else lambda numbers: array("q", numbers)
        symbol, pair = held(symbol.tolist()), held(ranks.tolist())  # the id that begins here, the rank of it and the next one
        after, before = held(range(1, n + 1)), held(range(-1, n - 1))  # where the next and the last symbol begin

        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << SHIFT | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            while bucket:
                at = heappop(bucket)
                if pair[at] != rank:
                    continue  # stale: one of the two symbols has been merged since
                gone, left = after[at], before[at]
                end = after[at] = after[gone]
                before[end] = at
                symbol[at], symbol[gone], pair[gone] = rank, -1, -1
                pair[at] = right = get(data[at : after[end]], -1) if symbol[end] != -1 else -1
                if right >= 0:
                    if right in buckets:
                        heappush(buckets[right], at)
                    else:
                        buckets[right] = [at]
                        low[right >> SHIFT] |= bit[right & MASK]
                        top |= bit[right >> SHIFT]
                if symbol[left] != -1:
                    pair[left] = new = get(data[left:end], -1)
                    if new >= 0:
                        if new in buckets:
                            heappush(buckets[new], left)
                        else:
                            buckets[new] = [left]
                            low[new >> SHIFT] |= bit[new & MASK]
                            top |= bit[new >> SHIFT]
                        if new < rank:
                            break  # what has a lesser rank now comes before the rest of the bucket
                if 0 <= right < rank:
                    break
            if not bucket:
                del buckets[rank]
                low[word] ^= bit[rank & MASK]
                if not low[word]:
                    top ^= bit[word]

        symbol = np.array(symbol)
        ends, ids = (4 * np.cumsum(symbol != -1)[gaps]).tolist(), symbol[symbol != -1].astype(np.int32)
        if ids.min() < 0:
            raise KeyError("a byte that is not in the vocabulary")
        ids = ids.tobytes()
        yield from (ids[a:b] for a, b in zip(ends, ends[1:]))

    def encoded(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as 32-bit numbers in a row."""
        held, size = [], 0
        for text in texts:
            if len(text) > CHARACTERS:
                yield from self._settled(held)
                held, size = [], 0
                found = (m[0] for m in self.pieces.finditer(text))
                yield b"".join(ids for some in batched(found, PIECES) for ids in self._settled([self._looked_up(some)]))
                continue
            held.append(self._looked_up(self.pieces.findall(text)))
            size += len(text)
            if size > CHARACTERS:
                yield from self._settled(held)
                held, size = [], 0
        yield from self._settled(held)

    def _looked_up(self, pieces: Iterable[str]) -> list[bytes | bytearray]:
        return list(map(self.known.__getitem__, pieces))

    def _settled(self, texts: list[list[bytes | bytearray]]) -> list[bytes]:
        self.known.settle()
        return list(map(b"".join, texts))

    def encode(self, text: str) -> list[int]:
        return memoryview(next(self.encoded([text]))).cast("i").tolist()

    def decoded(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes that each list of ids spells."""
        ends = lists.offsets.to_numpy()  # a null list has no ids between its ends
        ids = lists.values.slice(ends[0], ends[-1] - ends[0])
        if ids.null_count:
            raise ValueError("an id is null")
        letters = self.spelled.take(ids).buffers()[2] or pa.py_buffer(b"")
        ends = np.cumsum(np.append(0, self._lengths[ids.to_numpy()]))[ends - ends[0]].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), letters])

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(map(self._spelled.__getitem__, ids or ()))


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    """A vocabulary file in tiktoken's form; a bare name is looked up among the public tokenizers."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return Vocabulary(ranks, public_tokenizers.PATTERN)


def encode(docs: DataFrame, name: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row for each of docs: doc_id and ids, an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lists = list(vocabulary(name).encoded(text or "" for text in batch.column(1).to_pylist()))
            ends = list(accumulate((len(ids) // 4 for ids in lists), initial=0))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(lists))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = DEFAULT_VOCABULARY) -> DataFrame:
    """encoded (doc_id, ids) with `decoded`, the bytes that the ids spell. An id outside the vocabulary fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = vocabulary(name).decoded(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
