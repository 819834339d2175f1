import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm import repetition


def slow(text, least):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    longest = [max((next((m for m in range(len(w)) if i + m >= len(w) or j + m >= len(w) or w[i + m] != w[j + m]), 0) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]
    cover = lambda n: sum(any(longest[i] >= n and i <= p < i + longest[i] for i in range(len(w))) for p in range(len(w)))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
    assert len(inside) == cover(3)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), cover(3), cover(least), max(longest, default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#é ", max_size=60)), max_size=6))
def test_counts_by_brute_force(texts):
    assert repetition.measured(texts, 4) == [slow(t, 4) for t in texts]


def test_long_periodic_text():
    n = 50_000
    got = repetition.longest_repeats(np.arange(n) % 7, np.zeros(n, int), np.full(n, n))
    assert got[0] == n - 7 and got[n - 1] == 1


def test_verdict(spark):
    plain = " ".join(f"w{k * k % 9973}" for k in range(400))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, plain), (2, plain + " " + passage + " mid " + passage), (3, "too short"), (4, "again and again " * 40), (5, plain + " " + " x ".join(" ".join(f"q{k}" for k in range(30)) for _ in range(8)))]
    got = {r["doc_id"]: r for r in repetition.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["base_failed"] for k in range(1, 6)] == [False, False, True, True, False]
    assert [got[k]["kept"] for k in range(1, 6)] == [True, False, False, False, False]


def test_awkward_rows(docs, no_docs):
    got = repetition.assess(docs).collect()
    assert len(got) == docs.count() and not any(r["kept"] for r in got if r["n_words"] == 0)
    assert repetition.assess(no_docs).count() == 0
