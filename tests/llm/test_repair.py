import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from oracle import SF

from rillflow.llm import registry, repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spelled(x):
    return " " if x is None else str(x)


def damage(rows):
    for c, t, r, x in rows:
        kind, r, x = zlib.crc32(f"{spelled(c)}:{spelled(t)}".encode()) % 20, spelled(r), spelled(x)
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        yield from [(c, t, r, x)] * (2 if kind == 3 else 1)


def ordered(own):
    return sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))


def faults(own):
    seen, out = set(), []
    for _, _, role, text in own:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(own, found):
    """Every way of editing by brute force, up to two insertions at each place: (cost, audit, turns)."""
    def after(k):
        if k == len(own):
            yield 0, "", ()
            return
        _, _, role, text = own[k]
        for cost, audit, turns in list(ends(k + 1)):
            yield cost + 3, "D" + audit, turns
            if found[k] not in ("blank", "duplicate"):
                late = found[k] == "truncated"
                yield cost + late, "K" + audit, ((role, text), *turns)
                for new in ("user", "assistant"):
                    yield cost + late + 2, "R" + audit, ((new, text), *turns)

    def ends(k):
        rest = list(after(k))
        for n in range(3):
            for new in itertools.product(("user", "assistant"), repeat=n):
                for cost, audit, turns in rest:
                    yield cost + 2 * n, "I" * n + audit, (*((r, "") for r in new), *turns)

    initial = lambda turns: "".join(r[:1] or "?" for r, _ in turns)  # noqa: E731  an empty role is no legal one
    return [(c, a, t) for c, a, t in ends(0) if LEGAL.match(initial(t))]


def plain(codes):
    """Cheapest edits state by state: a dynamic program that allows insertions anywhere."""
    def with_insertions(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                new = (cost + 2, audit + "I")
                best[repair.CHOSEN[state]] = min(best.get(repair.CHOSEN[state], new), new)
        return best

    best = with_insertions({0: (0, "")})
    for code in codes:
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 3, "D")]
            if not code & repair.MUST_GO:
                late = 1 if code & repair.BREAKS_OFF else 0
                ways.append((repair.CHOSEN[state], 2 + late, "R"))
                if (state, code & 3) in repair.LEGAL:
                    ways.append((code & 3, late, "K"))
            for to, more, letter in ways:
                new = (cost + more, audit + letter)
                after[to] = min(after.get(to, new), new)
        best = with_insertions(after)
    return min(best[state] for state in (0, 3) if state in best)


def slow(rows, exhaustive=True):
    by = defaultdict(list)
    for row in damage(rows):
        by[row[0]].append(row)
    out = []
    for c in {r[0] for r in rows}:
        own = ordered(by[c])
        found = faults(own)
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        if exhaustive:
            cost, audit, repaired = min(all_repairs(own, found))
        else:
            codes = [{"s": 1, "u": 2, "a": 3}.get(r[2][:1], 0) | (4 if f in ("blank", "duplicate") else 8 if f else 0) for r, f in zip(own, found)]
            cost, audit = plain(codes)
            repaired, left = [], list(own)
            for letter in audit:
                row = None if letter == "I" else left.pop(0)
                if letter != "D":
                    role = row[2] if letter == "K" else "assistant" if repaired and repaired[-1][0][:1] == "u" else "user"
                    repaired.append((role, row[3] if row else ""))
        told = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out.append((c, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, told))
    return sorted(map(repr, out))


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_kind", repair.F.lit("clash")).withColumn("audit", repair.F.lit(1))
    return sorted(repr(tuple(r)) for r in repair.digests(repair.damaged(df)).select(*NAMES).collect())


@pytest.mark.parametrize("block", [256, 3, 1])
def test_search_equals_dynamic_program(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    repair.search.cache_clear()
    rng = random.Random(block)
    for _ in range(2500):
        codes = bytes(rng.choice((0, 1, 1, 2, 2, 2, 3, 3, 3, 6, 7, 9, 10, 11)) for _ in range(rng.randrange(20)))
        assert repair.cheapest_edits(codes) == plain(codes)
    repair.search.cache_clear()


def test_bounds_never_exceed_the_cost():
    rng = random.Random(4)
    for _ in range(400):
        codes = bytes(rng.choice((0, 1, 2, 3, 6, 9, 10, 11)) for _ in range(rng.randrange(14)))
        bounds = repair.suffix_bounds(codes, True)
        for at in range(len(codes) + 1):
            for state in range(4):
                assert bounds[at][state] <= repair.search(codes[at:], state, True)[repair.ASSISTANT][0]


def test_by_trying_all_edits(spark):
    rng, rows = random.Random(1), []
    for c in range(120):
        for t in range(rng.randrange(1, 4)):
            rows.append((c, rng.choice((t, t, t + 3, None)), rng.choice(("system", "user", "user", "assistant", "assistant", "tool", None, "")), rng.choice(("One.", "One.", "Two!", "cut off", " \n", None, "", "Why? \x0b"))))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (500, None, "user", "a."), (500, None, "assistant", "b."), (500, None, "assistant", "b.")]
    assert run(spark, rows) == slow(rows)


def test_long_and_hot_conversations(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("same.", f"turn {t}.", f"turn {t}"))) for t in range(3000)]
    rows += [(2, 7, "user", "copy.")] * 2000 + [(3, t, "user" if t % 2 == 0 else "assistant", f"fine {t}.") for t in range(600)]
    assert run(spark, rows) == slow(rows, exhaustive=False)


def test_dropped_conversation_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [repr((gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]
    assert run(spark, []) == []
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (1, 3, "assistant", ""), (2, 0, "assistant", "Only.")]
    got = sorted(tuple(r) for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [
        (1, 0, "K", "user", "A."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "B."), (1, 3, "K", "assistant", "C."),
        (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Only."),
    ]


def test_query_by_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(repr(tuple(r)) for r in registry.QUERIES["op12_structure_repair"](spark, SF).select(*NAMES).collect())
    assert got == slow(rows, exhaustive=False)
