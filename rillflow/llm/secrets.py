"""Secret scan: three fixed patterns, and random strings exposed by a poor yield of characters per token.

A string of chance letters compresses badly under a byte-pair vocabulary trained on ordinary text. Candidate runs with
letters are encoded with a tiktoken vocabulary; a run that yields fewer than `max_ratio` characters per token is reported as
kind `random`, unless it is a known kind of digest or identifier or overlaps a mail address or a span of the patterns.

Null and empty texts have no spans; repeated rows are scanned alike; other columns are ignored by `scan` and kept, with
their values, by `redact`. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_rows, parts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
#: Mail addresses are no secrets; what stands between `//` or `:` and `@` is, unless the colon follows the word mail.
MAIL = re.compile(
    r"(?:(?<=mailto:)|(?<=mail:)|(?<![A-Z0-9._%+/:-]))[A-Z0-9._%+-]{1,64}@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}", re.IGNORECASE | re.ASCII
)
#: Not secrets: digests of the usual lengths, UUIDs, decimal numbers, paths and names of dictionary-like parts.
HARMLESS = re.compile(
    r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/]+={0,2}"
    r"|[0-9+/_=-]+"
    r"|(?:[A-Za-z]+|[0-9]{1,8})(?:[/_-]+(?:[A-Za-z]+|[0-9]{1,8}))+)\Z"
)
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
DEFAULT_MAX_RATIO = 2.1
#: Runs without a digit may be long words of any language, which yield 2.05 and more; random letters yield 1.3 to 2.0.
LETTERS_MAX_RATIO = 2.0


@lru_cache(maxsize=4)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The vocabulary file as an encoding; a bare name is looked up among the public tokenizers."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans from left to right that cover the same places."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], vocabulary: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """Spans of runs with letters whose characters per token fall short of max_ratio, outside mail addresses."""
    found, at = [], 0
    mails = [m.span() for m in MAIL.finditer(text)] if "@" in text else []
    shut = united([*((start, end) for start, _, end in taken), *mails])
    for m in CANDIDATE.finditer(text):
        while at < len(shut) and shut[at][1] <= m.start():
            at += 1  # candidates come from left to right, so what ended before one is done with
        run = m[0]
        if not any(c.isalpha() for c in run) or HARMLESS.match(run):
            continue
        if at < len(shut) and shut[at][0] < m.end():
            continue
        least = max_ratio if any(c.isdigit() for c in run) else min(max_ratio, LETTERS_MAX_RATIO)
        if len(run) < least * len(encoding(vocabulary).encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, max_ratio: float = DEFAULT_MAX_RATIO) -> DataFrame:
    """One row for each of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Offsets count code points, ends exclusive. A narrow pass: each task scans its own texts and nothing is shuffled.
    """

    def per_batch(batch: pa.RecordBatch) -> list:
        columns: list[list] = [batch.column(0), [], [], [], [], [], []]
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = sorted(base + random_spans(text, base, vocabulary, max_ratio))
            n = [sum(x[1] == kind for x in spans) for kind in range(4)]
            values = (*n[:3], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), n[3])
            for column, value in zip(columns[1:], values, strict=True):
                column.append(value)
        return columns

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, per_batch)


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str = DEFAULT_VOCABULARY, max_ratio: float = DEFAULT_MAX_RATIO) -> DataFrame:
    """docs with each run of overlapping spans in `text` replaced by mark; the rows and all other columns stay."""
    place = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted(base + random_spans(text, base, vocabulary, max_ratio))
        if not spans:
            return text
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in parts(batches):
            texts = pa.array([clean(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    return docs.mapInArrow(run, docs.schema)
