import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from rillflow.llm import bpe, registry


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    ranks = bpe.vocabulary(bpe.DEFAULT_VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("aabct'sl \n\x1c é1٣😀한"), max_size=80)))
def test_equals_the_library(library, text):
    own = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin", "éüñ漢字"])
def test_very_long_pretokens(library, letters):
    rng = random.Random(7)
    text = "".join(rng.choice(letters) for _ in range(60_000))
    assert bpe.vocabulary(bpe.DEFAULT_VOCABULARY).encode(text) == library.encode_ordinary(text)


def slow_merge(ranks, piece):
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_other_ranks_by_rescanning():
    """Vocabularies whose merges are not in the order of their making: equal ranks leftmost first, stale pairs skipped."""
    rng = random.Random(5)
    for _ in range(200):
        pieces = [bytes([k]) for k in range(256)]
        while len(pieces) < 290:
            new = rng.choice(pieces[97:100] + pieces[256:]) + rng.choice(pieces[97:100] + pieces[256:])
            if new not in pieces:
                pieces.append(new)
        order = list(range(256)) + rng.sample(range(256, 290), 34)
        ranks = dict(zip(pieces, order))
        own = bpe.Vocabulary(ranks, r"\w+|\W")
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
            want = [ranks[piece]] if piece in ranks else slow_merge(ranks, piece)
            assert own.merged(piece) == want


def test_many_pretokens_in_one_queue():
    """Pairs across two pre-tokens are none, and each pre-token's merges are those it has alone, whatever the order of ranks."""
    rng = random.Random(11)
    for _ in range(60):
        pieces = [bytes([k]) for k in range(256)]
        while len(pieces) < 300:
            new = rng.choice([b"\0", *pieces[97:100], *pieces[256:]]) + rng.choice([b"\0", *pieces[97:100], *pieces[256:]])
            if new not in pieces:
                pieces.append(new)
        ranks = dict(zip(pieces, [*range(256), *rng.sample(range(256, 300), 44)]))
        some = [bytes(rng.choice(b"\0abc") for _ in range(rng.randrange(1, 30))) for _ in range(80)]
        got = [memoryview(ids).cast("i").tolist() for ids in bpe.Vocabulary(ranks, r"\w+|\W")._merged(some)]
        assert got == [[ranks[piece]] if piece in ranks else slow_merge(ranks, piece) for piece in some]


def test_new_pretokens_share_a_queue(monkeypatch, library):
    own, queues = bpe.Vocabulary(bpe.vocabulary(bpe.DEFAULT_VOCABULARY).ranks, library._pat_str), []
    monkeypatch.setattr(own, "_merged_together", lambda pieces, f=own._merged_together: queues.append(len(pieces)) or f(pieces))
    texts = [" ".join(f"qzx{k}vjw{k % 7}kfp" for k in range(at, at + 100)) for at in range(20)]
    assert [memoryview(ids).cast("i").tolist() for ids in own.encoded(texts)] == list(map(library.encode_ordinary, texts))
    assert len(queues) <= 2


def test_texts_longer_than_are_taken_at_a_time(monkeypatch, library):
    monkeypatch.setattr(bpe, "CHARACTERS", 50)
    monkeypatch.setattr(bpe, "PIECES", 7)
    own = bpe.Vocabulary(bpe.vocabulary(bpe.DEFAULT_VOCABULARY).ranks, library._pat_str)
    texts = ["", "short one", " ".join(f"wörd{k}" for k in range(90)), "x" * 300, "", "last one"]
    assert [memoryview(ids).cast("i").tolist() for ids in own.encoded(texts)] == list(map(library.encode_ordinary, texts))


def test_bytes_without_an_id():
    own = bpe.Vocabulary({b"a": 0, b"bc": 1}, r"\w+|\W")
    assert own.merged(b"abc") == [0, 1]
    with pytest.raises(KeyError):
        own.merged(b"ab")


def test_ids_that_spell_nothing():
    own = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    lists = pa.array([[5], None, [], own.encode("one é two")], pa.list_(pa.int32()))
    assert own.decoded(lists).to_pylist() == [own.decode([5]), b"", b"", "one é two".encode()]
    assert own.decoded(lists.slice(3)).to_pylist() == ["one é two".encode()] and own.decoded(lists.slice(1, 2)).to_pylist() == [b"", b""]
    assert own.decoded(lists[:0]).to_pylist() == []
    for wrong in (-1, 1 << 20, None):
        with pytest.raises((IndexError, ValueError)):
            own.decoded(pa.array([[wrong]], pa.list_(pa.int32())))


def test_too_many_ranks():
    with pytest.raises(ValueError):
        bpe.Vocabulary({bytes([k]): k for k in range(256)} | {b"ab": bpe.WORD_BITS**2}, r"\w+")


def test_remembered_pretokens_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MOST_KNOWN", 10)
    own = bpe.Vocabulary(bpe.vocabulary(bpe.DEFAULT_VOCABULARY).ranks, library._pat_str)
    text = " ".join(f"word{k}" for k in range(500))
    assert own.encode(text) == library.encode_ordinary(text) and len(own.known) <= 10


def test_awkward_rows(spark, docs, no_docs, library):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(repr((r["doc_id"], library.encode_ordinary(r["text"] or ""))) for r in rows)
    got = bpe.encode(docs)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in got.collect()) == want
    back = bpe.decode(got).collect()
    assert sorted(repr((r["doc_id"], bytes(r["decoded"]).decode())) for r in back) == sorted(repr((r["doc_id"], r["text"] or "")) for r in rows)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["decoded"] == b""
    assert bpe.encode(no_docs).collect() == [] and bpe.decode(bpe.encode(no_docs)).collect() == []


def test_query_by_the_library(spark, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.QUERIES["op13_byte_level_bpe"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    assert got == want
