"""Quality rules: cheap counts, and repetition found with a suffix array over the words of each text.

Suffixes of all texts of a batch are sorted together by prefix doubling, with the text's number as the first letter, so
that no suffix is compared beyond its own text. Neighbours in that order share an LCP interval; the deepest interval of a
suffix gives the longest repeated run of words that starts there. The union of those runs is the repeated part of a text.

Null and empty texts have no words and fail the base rule; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
#: Words of one joint suffix array; a longer text is sorted on its own.
WORDS_AT_ONCE = 400_000


def longest_repeats(letters: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the length of the longest run from there that stands elsewhere in the same text too.

    letters: word numbers; owner: the text of each word, ascending; ends: for each place, where its text ends.
    """
    n = len(letters)
    if n == 0:
        return np.zeros(0, np.int64)
    key = owner.astype(np.int64) * (int(letters.max()) + 1) + letters
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)  # one array for each doubling is kept
    new = np.empty(n, bool)
    new[0], new[1:] = True, key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads, sizes)
    levels, active, h = [rank], order[np.repeat(sizes > 1, sizes)], 1
    while active.size:
        ahead = active + h
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        old = rank[active]
        split, fresh = np.ones(len(key), bool), np.ones(len(key), bool)
        split[1:], fresh[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
        at = np.arange(len(key))
        new_head = at[fresh]
        sizes = np.diff(np.append(new_head, len(key)))
        rank = rank.copy()
        rank[active] = old + np.repeat(new_head, sizes) - np.maximum.accumulate(np.where(split, at, 0))
        levels.append(rank)
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    alike = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[alike], right[alike]
    lcp = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + lcp, right + lcp
        ok = (a < ends[left]) & (b < ends[right])
        ok &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        lcp[ok] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, lcp)
    np.maximum.at(longest, right, lcp)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places inside the union of the repeated runs of `least` words or more."""
    starts = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + longest[starts], 1)
    return np.cumsum(edge[:-1]) > 0


def measured(texts: list[str | None], least: int) -> list[tuple[int, ...]]:
    """Of each text: words, characters in words, symbols, repeated lines, words in repeated 3-word windows, words in
    repeated runs of `least` words, longest repeated run."""
    out, todo, waiting = [], [], 0
    numbers: dict[bytes, int] = {}

    def flush() -> None:
        nonlocal todo, waiting
        lengths = np.array([len(ids) for _, ids in todo], np.int64)
        letters = np.array([i for _, ids in todo for i in ids], np.int64)
        owner = np.repeat(np.arange(len(todo)), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        longest = longest_repeats(letters, owner, ends)
        short, long = np.bincount(owner[covered(longest, 3)], minlength=len(todo)), np.bincount(owner[covered(longest, least)], minlength=len(todo))
        most = np.zeros(len(todo), np.int64)
        np.maximum.at(most, owner, longest)
        out.extend((*counts, int(a), int(b), int(c)) for (counts, _), a, b, c in zip(todo, short, long, most))
        todo, waiting = [], 0
        numbers.clear()

    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        chars = len(text) - len(raw) + sum(map(len, words))
        lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").split()]
        counts = (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)))
        if waiting and waiting + len(words) > WORDS_AT_ONCE:
            kept = [(words, counts)]
            flush()
            ids = [numbers.setdefault(w, len(numbers)) for w in kept[0][0]]
        todo.append((counts, ids))
        waiting += len(words)
    if todo:
        flush()
    return out


def assess(docs: DataFrame, least: int = 20, max_covered: float = 0.3, max_repeat: int = 50) -> DataFrame:
    """One row for each of docs with its counts, covered fraction, longest repeat, base_failed and kept.

    A line or two that a short text repeats, a header or a closing, are shorter than `least` and no reason to reject it.
    kept: the base rule passes, at most max_covered of the words lie in repeated runs of `least` words or more, and no
    repeated run is longer than max_repeat words. A narrow pass over whole texts; nothing is shuffled.
    """

    def per_batch(batch: pa.RecordBatch) -> list:
        rows = measured(batch.column(1).to_pylist(), least)
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_covered, most = map(list, zip(*rows, strict=True))
        fraction = [c / w if w else 0.0 for c, w in zip(n_covered, n_words)]
        failed = [w < 50 or 100 * r > 50 * w for w, r in zip(n_words, n_repeat)]
        kept = [not b and f <= max_covered and m <= max_repeat for b, f, m in zip(failed, fraction, most)]
        return [batch.column(0), n_words, word_chars, n_symbols, n_dup_lines, n_repeat, fraction, most, failed, kept]

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_fraction double, longest_repeat long, base_failed boolean, kept boolean"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, per_batch)
