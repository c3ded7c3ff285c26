"""Conversation repair against a search over all cheapest edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from churnspark.llm import conversation_repair as repair

WHITE = "\t\n\x0b\x0c\r "


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def cheapest(rows, must, cut):
    """(cost, audit, messages) of the cheapest edits, ties by audit: uniform-cost search over (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, made, messages = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, list(messages)
        state = (i, made[-1:])
        if state in done:
            continue
        done.add(state)
        for c, role in (("u", "user"), ("a", "assistant")):
            if re.fullmatch("s?(ua)*u?", made + c):
                heapq.heappush(heap, (cost + 5, audit + "I", i, made + c, (*messages, (role, ""))))
                if i < len(rows) and not must[i]:
                    heapq.heappush(heap, (cost + 1 + 5 * cut[i], audit + "R", i + 1, made + c, (*messages, (role, rows[i][3]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made, messages))
            if not must[i] and rows[i][2] and re.fullmatch("s?(ua)*u?", made + rows[i][2][0]):
                heapq.heappush(heap, (cost + 5 * cut[i], audit + "K", i + 1, made + rows[i][2][0], (*messages, rows[i][2:4])))


def brute(rows, damaging=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own = damage(own) if damaging else own
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        seen, blank, twice, cut = set(), [], [], []
        for _, _, role, text in own:
            end = text.rstrip(WHITE)
            blank.append(not end)
            twice.append(bool(end) and (role, text) in seen)
            cut.append(bool(end) and not twice[-1] and end[-1] not in ".!?")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, messages = cheapest(own, [a or b for a, b in zip(blank, twice)], cut)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
        out[conv] = (gaps, sum(blank), sum(twice), sum(cut), illegal, cost, audit, sha)
    return out


def conversations(seed, n, longest, roles=("system", "user", "assistant", "user", "assistant", "tool")):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = r.randrange(-2, 3)
        for _ in range(r.randrange(1, longest)):
            turn += r.choice((1, 1, 1, 2))
            text = r.choice(("Fine.", "No!", "and then", " \n", "", None, f"text {r.randrange(6)}?\t", "long " * 9 + "."))
            rows.append((conv, turn, r.choice(roles), text))
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def run(spark, rows, parts=3, **bounds):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos bigint, present string").repartition(parts)
    found = repair.digested(repair.repaired(repair.damaged(df), "present", **bounds)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("bounds", [{}, {"long_rows": 5, "block_rows": 4}, {"long_bytes": 40, "block_rows": 1}])
def test_repair_equals_search(spark, bounds):
    rows = conversations(1, 120, 14)
    rows += [(None, t, "user" if t % 2 else "assistant", f"null conversation {t}.") for t in range(9)]
    rows += [(200, None, None, "no turn."), (201, 3, "user", None), (202, 1, "", "no role."), (203, 1, "user", "a."), (203, 1, "user", "a.")]
    assert run(spark, rows, **bounds) == brute(rows)


def test_long_conversation_in_blocks(spark):
    """One conversation holds most rows; copies of one message, repeated rows, and every block boundary."""
    rows = [(7, t, ("user", "assistant")[t % 2], "the same." if t % 3 else f"text {t}.") for t in range(600)]
    rows += [(7, 5, "user", "repeated row.")] * 40
    rows = [r for r in rows if r[1] != 5 or r[3] == "repeated row."]
    rows += [(c + 10, *r) for c, *r in conversations(2, 20, 6)]
    assert run(spark, rows, long_rows=50, block_rows=16) == run(spark, rows) == brute(rows)


def test_adversarial_roles(spark):
    """Few roles and no full stops: many equal costs, hence ties that only the audit decides."""
    rows = conversations(3, 150, 10, ("user",)) + [(1000 + c, t, role, text) for c, t, role, text in conversations(4, 150, 10, ("system", "assistant"))]
    assert run(spark, rows) == brute(rows)


def test_every_row_dropped(spark):
    rows = [(c, t, "user", "x.") for c in range(50) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert rows
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, rows) == {r[0]: empty for r in rows}
    assert run(spark, [], 1) == {}


def test_messages_and_parts(spark):
    """The operator returns the repaired messages; parts of a long conversation join to the same."""
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "a question?"), (1, 2, "user", "and"), (1, 3, "tool", "result.")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = repair.repaired(df).first()
    parts = repair.repaired(df, long_rows=1, block_rows=2).where("at >= 0").orderBy("at").collect()
    assert whole["audit"] == "".join(p["audit"] for p in parts)
    assert whole["messages"] == [m for p in parts for m in p["messages"]]
    assert [m["role"] for m in whole["messages"]] in (["user", "assistant"], ["user", "assistant", "user", "assistant"])


def test_very_long_text(spark):
    rows = [(1, 0, "user", "q " * 500_000 + "?"), (1, 1, "assistant", " " * 2_000_000 + "!")]
    found = repair.repaired(spark.createDataFrame(rows, SCHEMA)).first()
    assert (found["audit"], found["cost"]) == ("KK", 0)
