from collections import defaultdict

import pytest

from rillflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    by = defaultdict(set)
    for c, t, r, x in rows:
        c = c if c is not None else (t, r, x)  # a row without an id is a conversation
        by[c].add((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    whole = {c: tuple((r, x) for *_, r, x in sorted(own, key=lambda v: v[:6])) for c, own in by.items()}
    out = {}
    for c, turns in whole.items():
        same = [d for d, other in whole.items() if other == turns]
        known = [d for d in same if not isinstance(d, tuple)]
        if any(other[: len(turns)] == turns and len(other) > len(turns) for other in whole.values()):
            continue
        if c == (min(known) if known else min(same, key=repr)):
            out[None if isinstance(c, tuple) else c, turns[0] if isinstance(c, tuple) else None] = (len(turns), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in turns))
    return out


def run(spark, rows):
    out = defaultdict(list)
    df = spark.createDataFrame(rows, SCHEMA)
    for r in chat.rendered(df).collect():
        alone = None if r["conv_id"] is not None else r["rendered"]
        out[r["conv_id"], alone].append(r)
    whole = sorted((str(r["conv_id"]), r["n_turns"], r["n_copies"], r["text"]) for r in chat.texts(df, turns_each=10_000).collect())
    assert whole == sorted((str(c), own[0]["n_turns"], own[0]["n_copies"], "".join(r["rendered"] for r in sorted(own, key=lambda r: r["position"]))) for (c, _), own in out.items())
    for own in out.values():
        assert sorted(r["position"] for r in own) == list(range(own[0]["n_turns"]))
    return {c: (own[0]["n_turns"], own[0]["n_copies"], "".join(r["rendered"] for r in sorted(own, key=lambda r: r["position"]))) for c, own in out.items()}


ROWS = [
    *((1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(6)),
    *((2, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(3)),  # a snapshot of 1
    *((3, t + 10, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(6)),  # a copy of 1, other numbers
    *((4, t, "user", f"m{t}") for t in range(3)),  # other roles
    (5, 0, "user", "m0"), (5, 0, "user", "m0"), (5, 1, None, None), (5, 2, "", ""),
    (6, 0, "user", "m0"), (6, 1, "", ""),  # null and empty differ: not a prefix of 5
    (None, 0, "user", "alone"), (None, None, "system", "first"), (None, 3, "user", "alone"), (None, 3, "user", "alone"), (None, 7, "user", "m0"),
    (8, 1, "system", "twin"), (None, 1, "system", "twin"),
    (7, 1, "user", "tie b"), (7, 1, "user", "tie a"),
]


@pytest.mark.parametrize("block", [4096, 2])
def test_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    told = lambda found: sorted((str(c), v) for (c, _), v in found.items())
    assert told(run(spark, ROWS)) == told(slow(ROWS))


def test_hot_conversation_and_common_opening(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(9000)] + [(k, t, "user", f"t{t}") for k in range(1, 40) for t in range(k)] + [(100 + k, t, "user", "hello" if t == 0 else f"{k}") for k in range(50) for t in range(2)]
    got = run(spark, rows)
    assert {c for c, _ in got} == {0, *range(100, 150)} and got[0, None][0] == 9000


def test_nameless_rows_and_long_texts(spark):
    rows = [(None, None, "user", f"line {k % 900}") for k in range(3000)] + [(1, t, "user", f"t{t}") for t in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert chat.rendered(df).count() == 925
    parts = {r["part"]: r["text"] for r in chat.texts(df, turns_each=10).filter("conv_id = 1").collect()}
    assert sorted(parts) == [0, 1, 2] and "".join(parts[k] for k in range(3)) == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(25))


def test_sql_of_nameless_rows(spark):
    import duckdb

    from rillflow.llm import registry

    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    names = ["conv_id", "position", "n_turns", "n_copies", "rendered"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL['op6_chat_format']})").fetchall()
    got = chat.rendered(spark.createDataFrame(ROWS, SCHEMA)).select(*names).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_empty(spark):
    assert run(spark, []) == {}
