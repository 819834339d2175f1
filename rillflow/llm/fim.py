"""Fill-in-middle transformation by repeated-capture matching.

One fullmatch of `(unit)*` over a whole text keeps every repetition of the group, so `match.ends(1)` holds the end of each
token: its length is the number of tokens, and the two cuts are looked up in it. Nothing walks over the text in Python.

Draws come from a digest of seed and doc_id, so reruns agree and no row depends on another one. A null doc_id draws as the
empty string does. Null and empty texts have no tokens and stay plain, as do texts that hold one of the three marks, since
they could not be told apart again. Repeated rows are transformed alike. Other columns are ignored. Empty tables give no
rows. A narrow pass: nothing is shuffled, and a task holds one text and the ends of its tokens at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_rows

#: A word with the white space before it, or white space at the end; possessive, so that nothing is tried twice.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def cuts(doc_id: int | None, n: int, seed: int) -> tuple[int, int, int, int]:
    """Units before the first and second cut, and two draws from 0 to 99."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[at : at + 8], 16) for at in range(0, 32, 8))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return low, high, h3 % 100, h4 % 100


def transformed(doc_id: int | None, text: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, output."""
    ends = UNITS.fullmatch(text).ends(1)
    low, high, chance, kind = cuts(doc_id, len(ends), seed)
    if not text or chance >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    first, second = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if kind < spm_rate:
        return len(ends), "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row for each of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    rate: documents in a hundred that are cut; spm_rate: of those, how many in a hundred have the suffix first.
    """

    def per_batch(batch: pa.RecordBatch) -> list:
        ids = batch.column(0)
        rows = [transformed(d, t or "", seed, rate, spm_rate) for d, t in zip(ids.to_pylist(), batch.column(1).to_pylist())]
        return [ids, *(list(column) for column in zip(*rows))] if rows else [ids, [], [], [], [], []]

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, per_batch)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by the marks in it alone."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    head, middle = part(output, MIDDLE, 1), part(output, MIDDLE, 2)
    first, second = (PREFIX, SUFFIX), (SUFFIX, PREFIX)
    pieces = {}
    for name, (outer, inner) in (("psm", first), ("spm", second)):
        body = part(head, outer, 2)
        pieces[name] = {outer: part(body, inner, 1), inner: part(body, inner, 2)}
    whole = {name: F.concat(found[PREFIX], middle, found[SUFFIX]) for name, found in pieces.items()}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).otherwise(output)
