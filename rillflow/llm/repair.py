"""Conversation structure repair by depth-first branch and bound.

A conversation is repaired by the cheapest edits of its turns after which role initials read `(s?(ua)+)?`: Keep (0), Rerole to
user or assistant (2), Delete (3), Insert an empty turn of user or assistant anywhere (2). A blank turn, and one whose role and text
were seen before, must go; a turn that breaks off costs 1 more unless it goes. Of equally cheap edits those whose initials
are least in ASCII order win.

A search node is (turn, state), where the state is what the roles so far end in. An explicit stack holds open nodes; the
cost of the rest is bounded from below by forced deletions, turns that break off and illegal neighbours, of which one edit
mends two at most. A table keeps for each node the least cost it was reached with and all ways in at that cost: a dearer
prefix is dropped, an equally cheap one is noted and not followed again. When the stack is empty the incumbent is optimal, and
its audit is read from the noted ways, least letter first. Insertions stand right before the turn they serve or at the end,
behind deletions, which is where the least audit has them; two before one turn are never cheaper.

Conversations longer than BLOCK turns are searched block by block, from each state a block may be entered in to each it
may be left in; costs are added up from the end, and a walk from the start then picks each block's audit. A task holds one
byte for each turn of one conversation, as the audit it returns does, and streams the texts by in order. A digest of a whole conversation
can't be had in parts, so one conversation is read by one task.

Turns are in the order of `turn`, nulls first; turns that share a number follow by role and digest of the text. Null ids,
turns, roles and texts read as one space where they are spelled or compared; rows with a null conv_id are one conversation.
An empty role and one with another initial than s, u and a can't be kept. Repeated rows are duplicates. Other columns are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import parts

#: Turns of one search.
BLOCK = 256
#: What the roles so far end in: nothing, a system turn, a user turn, an assistant turn. A turn's own role: the same numbers, 0 for others.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state after keeping a turn of a role, where that is allowed, and after a turn whose role may be chosen.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
CHOSEN = (USER, USER, ASSISTANT, USER)
#: A turn as a byte: its role, whether it must go, whether it breaks off.
MUST_GO, BREAKS_OFF = 4, 8
#: Edits that end a conversation in each state, None for those that cannot end.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
REROLE, DELETE, INSERT = 2, 3, 2


def edits(turn: int, state: int) -> list[tuple[str, int, int]]:
    """(letters, cost, next state) of all edits of a turn, insertions before it included."""
    found = [("D", DELETE, state)]
    if not turn & MUST_GO:
        role, late, other = turn & 3, 1 if turn & BREAKS_OFF else 0, CHOSEN[state]
        if (state, role) in LEGAL:
            found.append(("K", late, role))
        found.append(("R", REROLE + late, other))
        if (other, role) in LEGAL:
            found.append(("IK", INSERT + late, role))
        found.append(("IR", INSERT + REROLE + late, CHOSEN[other]))
    return found


EDITS = [[edits(turn, state) for state in range(4)] for turn in range(16)]


def suffix_bounds(turns: bytes, closes: bool) -> list[list[int]]:
    """For each turn and state a cost that what remains cannot fall short of."""
    forced, broken, following = 0, 0, None  # None: the end
    bounds = []
    for at in range(len(turns), -1, -1):
        if at < len(turns):
            turn = turns[at]
            if turn & MUST_GO:
                forced += DELETE
            else:
                forced += 1 if turn & BREAKS_OFF else 0
                role = turn & 3
                broken += illegal(role, following, closes) if role else 1
                following = role
        bounds.append([forced + 2 * -(-(broken + illegal(state, following, closes)) // 2) for state in range(4)])
    return bounds[::-1]


def illegal(state: int, following: int | None, closes: bool) -> int:
    if following is None:
        return 1 if closes and state in (SYSTEM, USER) else 0
    return 0 if (state, following) in LEGAL else 1


@lru_cache(maxsize=1 << 15)
def search(turns: bytes, entry: int, closes: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits of a block by the state it is left in: (cost, audit). With closes, by ASSISTANT alone, that of a whole rest."""
    n, bounds = len(turns), suffix_bounds(turns, closes)
    free = [t & 3 for t in turns if not t & MUST_GO]
    exits = [ASSISTANT] if closes else [entry, *(x for x in (SYSTEM, USER, ASSISTANT) if x != entry and (free if x > SYSTEM else entry == START and SYSTEM in free))]
    incumbents: dict[int, int | float] = dict.fromkeys(exits, float("inf"))
    cheapest: list[dict[int, int]] = [{} for _ in range(n + 1)]
    ways: list[dict[int, list[tuple[int, str]]]] = [{} for _ in range(n + 1)]
    cheapest[0][entry], ways[0][entry] = 0, []
    stack, most = [(0, entry, 0)], float("inf")
    while stack:
        at, state, cost = stack.pop()
        if cost > cheapest[at][state] or cost + bounds[at][state] > most:
            continue
        if at == n:
            left, whole = (ASSISTANT, cost + INSERT * len(CLOSING[state])) if closes else (state, cost)
            if whole < incumbents[left]:
                incumbents[left] = whole
                most = max(incumbents.values())
            continue
        open_nodes = []
        for letters, more, after in EDITS[turns[at]][state]:
            total, known = cost + more, cheapest[at + 1].get(after)
            bound = total + bounds[at + 1][after]
            if bound > most or known is not None and known < total:
                continue
            if known == total:
                ways[at + 1][after].append((state, letters))
                continue
            cheapest[at + 1][after], ways[at + 1][after] = total, [(state, letters)]
            open_nodes.append((bound, letters, after, total))
        for _, _, after, total in sorted(open_nodes, reverse=True):  # the most promising on top
            stack.append((at + 1, after, total))
    found = {}
    for left, cost in incumbents.items():
        ends = [s for s, c in cheapest[n].items() if c + INSERT * len(CLOSING[s]) == cost] if closes else [left]
        audit, state = least_audit(ways, entry, ends)
        found[left] = (int(cost), audit + (CLOSING[state] if closes else ""))
    return found


def least_audit(ways: list[dict[int, list[tuple[int, str]]]], entry: int, ends: list[int]) -> tuple[str, int]:
    """The ASCII-least of the noted ways to one of ends, and which: no edit's letters begin those of another one."""
    marked, onward = set(ends), []
    for at in range(len(ways) - 1, 0, -1):
        out: dict[int, list[tuple[str, int]]] = {}
        for after in marked:
            for state, letters in ways[at][after]:
                out.setdefault(state, []).append((letters, after))
        onward.append(out)
        marked = set(out)
    letters, state = [], entry
    for out in reversed(onward):
        piece, state = min(out[state])
        letters.append(piece)
    return "".join(letters), state


def cheapest_edits(turns: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    blocks = [turns[at : at + BLOCK] for at in range(0, len(turns), BLOCK)] or [b""]
    rest = [search(blocks[-1], state, True)[ASSISTANT][0] for state in range(4)] if len(blocks) > 1 else []
    after = [rest]  # least cost of all later blocks, by the state they are entered in
    for block in reversed(blocks[1:-1]):
        rest = [min(cost + rest[left] for left, (cost, _) in search(block, state, False).items()) for state in range(4)]
        after.append(rest)
    total, audit, state = 0, [], START
    for block in blocks[:-1]:
        rest = after.pop()
        ways = [(cost + rest[left], piece, left, cost) for left, (cost, piece) in search(block, state, False).items()]
        _, piece, state, cost = min(ways)  # no piece begins another one: each edits the whole block
        total += cost
        audit.append(piece)
    cost, piece = search(blocks[-1], state, True)[ASSISTANT]
    return total + cost, "".join([*audit, piece])


# -- damage -------------------------------------------------------------------------------------------------------------


def spelled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Five twentieths of turns, by a checksum of conv_id and turn: dropped, emptied, without their ends, repeated or said by the user.

    conv_id, turn, role, text and `dropped`; a dropped turn stays as a row, so that its conversation does.
    """
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), spelled("role").alias("role"), spelled("text").alias("text"))
    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


# -- repair -------------------------------------------------------------------------------------------------------------

#: What stands after the last character that is no white space, and nothing.
NOT_BLANK, BREAKS = r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
ORDER = ["conv_id", "_kind", "turn", "role", "_digest"]
PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, and a digest that tells texts apart."""
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    text = spelled("text")
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), spelled("role").alias("role"), text.alias("text"), dropped.alias("dropped"), F.unhex(F.md5(text)).alias("_digest"))


def streamed(df: DataFrame, order: list[str], per_conversation: Callable[[object, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """One conversation after the other, its rows (without conv_id) in order and never all at once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names, after = [c for c in df.columns if c != "conv_id"], StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = to_arrow_schema(after)
        rows = (row for batch in parts(batches) for row in zip(batch.column("conv_id").to_pylist(), *(batch.column(n).to_pylist() for n in names)))
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(told)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, told)], schema=told)
            out.clear()
            return batch

        for conv_id, own in groupby(rows, key=lambda row: row[0]):
            for row in per_conversation(conv_id, (r[1:] for r in own)):
                out.append(row)
                if len(out) >= 500:
                    yield sent()
        yield sent()

    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def plans(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, and cost and audit of the cheapest edits. turns may have a boolean `dropped`.

    Texts stay behind: a turn goes along as its role, its flags and its digest. The first of equal turns is found by a
    partial minimum for each role and text and comes along as a row ahead of that turn, so no group of equal turns is gathered.
    """
    rows = prepared(turns)
    blank = ~F.col("text").rlike(NOT_BLANK)
    narrow = rows.select("conv_id", F.when(F.col("dropped"), 0).otherwise(2).alias("_kind"), "turn", "role", "_digest", blank.alias("blank"), F.col("text").rlike(BREAKS).alias("breaks"))
    live = narrow.filter("_kind = 2")
    first = live.groupBy("conv_id", "role", "_digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    marks = first.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "_digest", F.lit(False).alias("blank"), F.lit(False).alias("breaks"))

    def planned(conv_id: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        codes, faults, illegal_pairs, low, high, distinct = bytearray(), [0, 0, 0], 0, None, None, 0
        last, unseen = None, None
        for kind, turn, role, digest, is_blank, breaks in own:
            if kind == 0:
                continue
            if kind == 1:
                unseen = (turn, role, digest)
                continue
            seen, unseen = unseen != (turn, role, digest), None
            fault = 0 if is_blank else 1 if seen else 2 if breaks else None
            if fault is not None:
                faults[fault] += 1
            initial = role[:1]
            if last is not None and last + initial not in ("su", "ua", "au"):
                illegal_pairs += 1
            last = initial
            codes.append(INITIALS.get(initial, 0) | (MUST_GO if fault in (0, 1) else BREAKS_OFF if fault == 2 else 0))
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
        cost, audit = cheapest_edits(bytes(codes))
        yield conv_id, 0 if low is None else high - low + 1 - distinct, *faults, illegal_pairs, cost, audit

    return streamed(narrow.unionByName(marks), ["conv_id", "turn", "role", "_digest", "_kind"], planned, PLAN)


def edited(audit: str, own: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each repaired turn of a conversation."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(own)
        if letter == "D":
            continue
        if letter == "K":
            state = INITIALS[role[:1]]
        else:
            state = CHOSEN[state]
            role = "user" if state == USER else "assistant"
        yield letter, role, text


def with_plans(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The plan of each conversation ahead of its turns."""
    own = [c for c in found.columns if c != "conv_id"]
    ahead = found.select("conv_id", F.lit(0).alias("_kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("_digest", "binary"), ("text", "string"))), F.struct(*own).alias("plan"))
    rows = prepared(turns).filter("NOT dropped").select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "_digest", "text", F.lit(None).cast(ahead.schema["plan"].dataType).alias("plan"))
    return ahead.unionByName(rows)


def repaired(turns: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv_id, position from 0, edit (K, R or I), role, text."""

    def rows(conv_id: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        audit = next(own)[5]["audit"]
        for position, turn in enumerate(edited(audit, ((r[2], r[4]) for r in own))):
            yield conv_id, position, *turn

    return streamed(with_plans(turns, plans(turns)), ORDER, rows, "conv_id bigint, position bigint, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """The plan of each conversation and repaired_sha256, the digest of its repaired turns as lines `role:text`."""
    names = [part.split()[0] for part in PLAN.split(", ")][1:]

    def rows(conv_id: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        plan, told = next(own)[5], hashlib.sha256()
        for k, (_, role, text) in enumerate(edited(plan["audit"], ((r[2], r[4]) for r in own))):
            told.update(f"{'\n' if k else ''}{role}:{text}".encode())
        yield conv_id, *(plan[n] for n in names), told.hexdigest()

    return streamed(with_plans(turns, plans(turns)), ORDER, rows, f"{PLAN}, repaired_sha256 string")
