import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF
from tokenizers import Tokenizer

from rillflow.llm import packing


@lru_cache
def whole():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, ids, limit=1024, segments=64):
    """Every id of every document in one piece, sequences gapless and within their limits; the share of padding."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(by) == set(ids)
    for d, want in ids.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit and len(own) <= segments
        total, padding = total + at, padding + (limit - at if at & (at - 1) else 0)
    return padding / max(total, 1)


def test_whole_table(spark):
    docs, t = spark.read.parquet(f"{SF}/documents.parquet"), whole()
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert check(packing.pack(docs).collect(), ids) < 0.01


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_fast_ids_equal_the_slow_ones(text):
    got = packing.tokenized([text], "byte_bpe_50k")[0]
    assert list(got) == whole().encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext|", "endoftext", " ", "\n", "😀", "é", "a b"]), st.text(max_size=8)), max_size=12).map("".join))
def test_special_tokens_are_one_id(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert list(packing.tokenized([text], "byte_bpe_50k")[0]) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert list(packing.tokenized(["a <|endoftext|> b"], "byte_bpe_50k")[0]) == [64, 220, 50256, 275]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(2, 9), st.integers(5, 32), st.booleans())
def test_limits_hold(lengths, segments, loss, cut):
    task = packing.Bin(3, 32, segments, max(loss, 12), cut)
    if not cut:
        lengths = [1 + n % 12 for n in lengths]
    want = {}
    for k, n in enumerate(lengths):
        want[k] = list(range(n))
        task.add(k, np.arange(n, dtype=np.uint32), n // 3)
    task.pack(0)
    rows = [dict(zip([x.split()[0] for x in packing.SCHEMA.split(", ")], r)) for r in task.rows]
    check(rows, want, 32, segments)
    for s in {r["sequence_id"] for r in rows}:
        assert sum(r["loss_tokens"] for r in rows if r["sequence_id"] == s) <= max(loss, 12)
    if not cut:
        assert len(rows) == len(lengths)


def test_long_runs_crash_nothing(spark):
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " \n" * 600_000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = whole()
    check(packing.pack(df).collect(), {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in enumerate(texts)})


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "what is it", "an answer"), (2, None, "another"), (3, "only a prompt", None)], "doc_id long, q string, text string")
    rows = {r["doc_id"]: r for r in packing.pack(df, prompt="q", cut=False).collect()}
    t = whole()
    for d, q, a in ((1, "what is it", "an answer"), (2, "", "another"), (3, "only a prompt", "")):
        assert rows[d]["loss_tokens"] == len(t.encode(a).ids) + 1 and rows[d]["length"] == len(t.encode(q).ids) + len(t.encode(a).ids) + 1
    with pytest.raises(Exception, match="exceeds"):
        packing.pack(spark.createDataFrame([(1, "a b " * 2000)], "doc_id long, text string"), cut=False).collect()


def test_awkward_rows(docs, no_docs):
    rows, t = packing.pack(docs).collect(), whole()
    total = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == total
    assert packing.pack(no_docs).count() == 0


def test_answers_keep_all_three_limits(spark):
    from collections import defaultdict

    from oracle import SF

    from rillflow.llm import registry

    t = whole()
    rows = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    want = {}
    for (c, n), r in rows.items():
        if r["role"] == "assistant":
            before = rows.get((c, n - 1))
            front = t.encode(before["text"] or "", add_special_tokens=False).ids if before and before["role"] == "user" else []
            want[c * 1_000_000 + n] = (len(front), len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    covered, loss, used = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in registry.QUERIES["packing_answers"](spark, SF).collect():
        covered[r["doc_id"]] += r["length"]
        loss[r["sequence_id"]] += r["loss_tokens"]
        used[r["sequence_id"]] += r["length"]
        assert r["doc_tokens"] == sum(want[r["doc_id"]])
    assert covered == {d: sum(n) for d, n in want.items()} and sum(loss.values()) == sum(n for _, n in want.values())
    assert max(loss.values()) <= 384 and max(used.values()) <= 1024
    assert max(loss.values()) > 370  # the limit binds
