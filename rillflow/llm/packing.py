"""Packing examples into fixed-length sequences: vector bin packing by the dot-product heuristic.

An example has a demand for tokens, for segments and for loss-bearing tokens, and a sequence a capacity for each. A
sequence is filled by placing, time and again, the waiting piece that fits and whose demand has the largest dot product
with what is left. What then remains is filled by cutting a piece, where cutting is allowed. Each task packs its own
documents as they stream by, from a window of waiting pieces; nothing is shuffled and no group is gathered. The last
sequence of a task is cut into powers of two, which need no padding.

A null text is an empty one and packs its end mark alone. Rows with a null doc_id and repeated rows are packed like any
other. Empty tables give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import parts
from rillflow.llm.secrets import encoding

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Pieces that wait in a task before sequences are closed.
WINDOW = 1024
#: Shorter pieces aren't cut off; that much of a sequence may stay empty.
LEAST_CUT = 8
#: The vocabularies' only special token.
SPECIAL = "<|endoftext|>"
BEYOND = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=2)
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenized(texts: list[str], vocabulary: str) -> list[np.ndarray]:
    """Ids under a byte-level vocabulary `<name>.json`.

    `<name>.tiktoken` holds the same vocabulary and is several times as fast; ids agree for every character of the basic
    plane. Texts with characters beyond it go to the slower library, and so do texts that spell out the special token, which
    is one id, and those on whose runs of white space the fast one's pattern gives up.
    """
    import public_tokenizers

    path = vocabulary + ".json" if "/" in vocabulary else public_tokenizers.path(vocabulary + ".json")
    fast, out = encoding(vocabulary + ".tiktoken"), []
    for text in texts:
        ids = None
        if SPECIAL not in text and (text.isascii() or not BEYOND.search(text)):
            try:
                ids = fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        out.append(np.array(whole_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32) if ids is None else ids)
    return out


class Bin:
    """Pieces waiting in one task, and the rows of the sequences closed so far."""

    def __init__(self, part: int, tokens: int, segments: int, loss: int, cut: bool):
        self.capacity = np.array([tokens, segments, loss], float)
        self.tokens, self.cut, self.next_id = tokens, cut, part << 40
        self.need = np.zeros((0, 3))
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens, free): the first `free` ids bear no loss
        self.fresh: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, free: int) -> None:
        """Whole sequences leave at once where cutting is allowed; the rest waits."""
        start, total = 0, len(ids)
        if self.cut:
            while total - start >= self.tokens and max(0, self.tokens - max(0, free - start)) <= self.capacity[2]:
                self.close([(doc_id, start, ids[start : start + self.tokens], total, max(0, free - start))])
                start += self.tokens
        elif total > self.tokens:
            raise ValueError(f"an example of {total} tokens exceeds {self.tokens}, and cutting is off")
        if start < total:
            self.fresh.append((doc_id, start, ids[start:], total, max(0, free - start)))

    def waiting(self) -> int:
        return len(self.pieces) + len(self.fresh)

    @staticmethod
    def loss(piece: tuple) -> int:
        return max(0, len(piece[2]) - piece[4])

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total, free in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.next_id, at, max(0, len(ids) - free)))
            at += len(ids)
        self.next_id += 1

    def settle(self) -> None:
        if self.fresh:
            more = np.array([(len(p[2]), 1, self.loss(p)) for p in self.fresh], float)
            self.need, self.pieces, self.fresh = np.vstack([self.need, more]), self.pieces + self.fresh, []

    @staticmethod
    def divided(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total, free = piece
        return (doc_id, start, ids[:n], total, free), (doc_id, start + n, ids[n:], total, max(0, free - n))

    def pack(self, leave: int) -> None:
        """Close sequences until at most `leave` pieces wait."""
        self.settle()
        need, pieces = self.need / self.capacity, self.pieces
        alive = np.ones(len(pieces), bool)
        n_alive = len(pieces)
        while n_alive > leave:
            left, chosen = np.ones(3), []
            while True:
                fits = alive & (need <= left + 1e-9).all(axis=1)
                if not fits.any():
                    break
                k = int(np.argmax(np.where(fits, need @ left, -1.0)))
                chosen.append(pieces[k])
                alive[k] = False
                n_alive -= 1
                left = left - need[k]
            gap = int(round(left[0] * self.tokens))
            # A prefix of any waiting piece may fill the gap, if a segment and its loss-bearing tokens still fit.
            if (self.cut or not chosen) and gap >= LEAST_CUT and left[1] * self.capacity[1] > 0.5 and n_alive:
                room = int(round(left[2] * self.capacity[2]))
                longer = np.where(alive, need[:, 0], np.inf)
                k = int(np.argmin(np.where(longer > left[0], longer, np.inf)))
                if alive[k] and longer[k] > left[0]:
                    n = min(gap, pieces[k][4] + room)
                    if n >= LEAST_CUT:
                        head, pieces[k] = self.divided(pieces[k], n)
                        chosen.append(head)
                        need[k] = np.array([len(pieces[k][2]), 1, self.loss(pieces[k])]) / self.capacity
            if not chosen:  # a single piece beyond a limit of its own: cut it at the limit of loss-bearing tokens
                k = int(np.flatnonzero(alive)[0])
                head, pieces[k] = self.divided(pieces[k], max(1, min(self.tokens, int(self.capacity[2]))))
                chosen.append(head)
                need[k] = np.array([len(pieces[k][2]), 1, self.loss(pieces[k])]) / self.capacity
            if n_alive == 0 and self.cut:
                self.close_in_powers(chosen)
            else:
                self.close(chosen)
        keep = np.flatnonzero(alive)
        self.need, self.pieces = need[keep] * self.capacity, [pieces[k] for k in keep]

    def close_in_powers(self, pieces: list[tuple]) -> None:
        """Close the task's last pieces as sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        if self.tokens - left < LEAST_CUT:
            return self.close(pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                piece = pieces.pop(0)
                if len(piece[2]) > size:
                    piece, rest = self.divided(piece, size)
                    pieces.insert(0, rest)
                out.append(piece)
                size -= len(piece[2])
            self.close(out)
        return None

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(
    docs: DataFrame,
    max_tokens: int = 1024,
    max_segments: int = 64,
    max_loss_tokens: int | None = None,
    vocabulary: str = "byte_bpe_50k",
    end_id: int = 0,
    prompt: str | None = None,
    cut: bool = True,
) -> DataFrame:
    """One row for each piece; sequence_id is unique, and offset tells where in the sequence the piece stands.

    An example is the ids of `text`, after those of the column `prompt` if one is named, and end_id. Ids of the prompt bear
    no loss. With cut=False examples stay whole and none may exceed max_tokens.
    """
    most_loss = max_tokens if max_loss_tokens is None else max_loss_tokens
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"] + ([F.col(prompt).alias("_prompt")] if prompt else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Bin(TaskContext.get().partitionId(), max_tokens, max_segments, most_loss, cut)
        end = np.array([end_id], np.uint32)
        for batch in parts(batches):
            names = batch.column(0).to_pylist()
            texts = tokenized([t or "" for t in batch.column(1).to_pylist()], vocabulary)
            fronts = tokenized([t or "" for t in batch.column(2).to_pylist()], vocabulary) if prompt else [end[:0]] * len(names)
            for doc_id, front, ids in zip(names, fronts, texts):
                task.add(doc_id, np.concatenate([front, ids, end]), len(front))
                if task.waiting() >= 2 * WINDOW:
                    task.pack(WINDOW)
            yield task.batch()
        task.pack(0)
        yield task.batch()

    return docs.select(*columns).mapInArrow(run, SCHEMA)
