import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm import fim, registry

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text, rate=50, spm_rate=80, seed=42):
    """The rule as worded, token by token."""
    tokens = TOKEN.findall(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(p) for p in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text or ""
    if h[3] % 100 < spm_rate:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 10**12)), st.text(st.sampled_from("ab<>PSM \n\t\x0b\x1c é😀."), max_size=40))
def test_equals_plain_rule(doc_id, text):
    for rate, spm_rate in ((50, 80), (100, 50), (0, 0)):
        assert fim.transformed(doc_id, text, 42, rate, spm_rate) == slow(doc_id, text, rate, spm_rate)


@pytest.mark.parametrize("rate,spm_rate", [(50, 80), (100, 0), (100, 100)])
def test_awkward_rows_come_back_whole(spark, docs, rate, spm_rate):
    marked = docs.selectExpr("doc_id + 100 AS doc_id", "concat(text, '<', '<P', text, 'M>') AS text").union(docs.selectExpr("doc_id + 200", "concat(text, '<P>')"))
    rows = docs.select("doc_id", "text").union(marked)
    found = fim.transform(rows, rate=rate, spm_rate=spm_rate)
    got = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(found.output, found.form).alias("back")).collect()
    want = [(r["doc_id"], *slow(r["doc_id"], r["text"], rate, spm_rate), r["text"] or "") for r in rows.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    if rate == 100:
        assert {r["form"] for r in got} == {"plain", "spm" if spm_rate else "psm"}


def test_very_long_texts_and_empty_table(spark, no_docs):
    texts = ["w " * 400_000, " " * 1_000_000, "x" * 1_000_000]
    for text in texts:
        assert fim.transformed(1, text, 42, 100, 80) == slow(1, text, 100)
    assert fim.transform(no_docs).collect() == []


def test_query_over_awkward_rows_equals_sql(spark, docs, tmp_path):
    import duckdb

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = registry.QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).select(*names).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL['op11_fill_in_middle']})").fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
