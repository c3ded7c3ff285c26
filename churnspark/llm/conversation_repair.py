"""Repair of the role structure of conversations at least cost.

Rows of a conversation, by turn, are kept, given another role or deleted, and empty messages are inserted, until the
initials of the roles read ``(s?(ua)+)?``. A node is a place between rows and one of four states (what the last kept
role was). Costs to the end of every node are a scan of (min, +) products of one matrix per row, so a scan may begin
anywhere in a conversation. Among the arcs on cheapest paths the least audit is found by prefix doubling: nodes are
ranked by their least audits of length 1, 2, 4, ... (a pair of ranks gives the next rank), with pointers to where these
audits end. Nodes of equal final rank have equal audits; each is walked once, through the doubled pointers.

A conversation of ordinary size is repaired in one task, many at a time. One above ``long_rows`` or ``long_bytes`` is cut
into blocks: block matrices are folded from the end, blocks are solved for every state that they may be entered in, and
the states are then folded from the start. No task holds more than a block of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from churnspark.llm.check_sql import CRC_TABLE, crc32
from churnspark.operators.sizing import fits
from churnspark.session import materialize

#: What edits cost; an undeleted truncated row adds TRUNCATED.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LABELS = "DIKR"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing kept, after s, after u, after a. INSERTED: the state after an inserted or renamed message.
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = np.array([USER, USER, ASSISTANT, USER])
#: Costs to the end when no rows are left: legal, u and a missing, a missing, legal.
END = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40
#: Initials of roles as stored: s, u, a, any other.
OTHER = 3
#: State after a kept row of an initial, by state; -1 where the initial is not legal.
KEPT = np.full((4, 4), -1)
KEPT[0, START] = SYSTEM
KEPT[1, [START, SYSTEM, ASSISTANT]] = USER
KEPT[2, USER] = ASSISTANT
LEGAL_PAIRS = np.zeros((4, 4), bool)
LEGAL_PAIRS[[0, 1, 2], [1, 2, 1]] = True
#: A conversation above either is cut into blocks of BLOCK_ROWS rows.
LONG_ROWS, LONG_BYTES, BLOCK_ROWS = 2048, 16 << 20, 4096
SPACES = " \t\n\x0b\x0c\r"


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of id and turn: of twenty rows, one is dropped, one loses its
    text, one its full stops, one is repeated and one becomes the user's. A null counts as one space, but for the order
    and gaps of turns. A dropped row stays with ``present`` false, so that no conversation is lost."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    draw = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text"), F.lit(" "))
    return df.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(draw != 0, F.when(draw == 3, 2).otherwise(1))).alias("present"),
    )


def _insert_closure() -> np.ndarray:
    """Cost from state to state by insertions alone."""
    cost = np.full((4, 4), FAR)
    np.fill_diagonal(cost, 0)
    for q in range(4):
        once, twice = INSERTED[q], INSERTED[INSERTED[q]]
        cost[q, once] = min(cost[q, once], INSERT)
        cost[q, twice] = min(cost[q, twice], 2 * INSERT)
    return cost


CLOSURE = _insert_closure()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


def row_costs(initial: np.ndarray, must: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    """(n, 4, 4): cost from state to state over the insertions before a row and the row itself."""
    n = len(initial)
    cost = np.full((n, 4, 4), FAR)
    cost[:, range(4), range(4)] = DELETE
    stay = np.where(must, FAR, TRUNCATED * truncated)
    for q in range(4):
        cost[:, q, INSERTED[q]] = np.minimum(cost[:, q, INSERTED[q]], RENAME + stay)
        to = KEPT[initial, q]
        rows = np.flatnonzero(to >= 0)
        cost[rows, q, to[rows]] = np.minimum(cost[rows, q, to[rows]], stay[rows])
    return np.minimum(_product(np.broadcast_to(CLOSURE, cost.shape), cost), FAR)


def suffix_costs(cost: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(n, 4, 4): cost from the state before a row to the state after the last row of its segment, by doubling."""
    cost = cost.copy()
    at, reach = np.arange(len(cost)), 1
    while True:
        rows = np.flatnonzero(at + reach <= last)
        if not len(rows):
            return cost
        cost[rows] = np.minimum(_product(cost[rows], cost[rows + reach]), FAR)
        reach *= 2


def least_audits(initial: np.ndarray, must: np.ndarray, truncated: np.ndarray, starts: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Solve segments of consecutive rows, none empty: ``starts`` holds their first rows, ``end`` (segments, 4) the costs
    to the end after them.

    Returns (costs of shape (segments, 4) by state of entry, number of the audit of shape (segments, 4), audits).
    """
    n, segments = len(initial), len(starts)
    lasts = np.append(starts[1:], n) - 1
    of = np.repeat(np.arange(segments), lasts - starts + 1)
    suffix = suffix_costs(row_costs(initial, must, truncated), lasts[of])
    ahead = (suffix + end[of][:, None, :]).min(axis=2)  # cost to the end of each node
    after = np.where((np.arange(n) == lasts[of])[:, None], end[of], np.roll(ahead, -1, axis=0))
    following = np.where(np.arange(n) == lasts[of], 4 * (n + of), 4 * np.arange(1, n + 1))  # number of the next place's first node
    # The arc of the least label among those on a cheapest path. A label leads from a node to one node.
    label = np.zeros((n, 4), np.int64)
    to = np.zeros((n, 4), np.int64)
    stay = np.where(must, FAR, TRUNCATED * truncated)
    row = np.arange(n)
    for q in range(4):
        kept = KEPT[initial, q]
        arcs = [
            (DELETE + after[:, q], following + q),
            (INSERT + ahead[:, INSERTED[q]], 4 * row + INSERTED[q]),
            (np.where(kept >= 0, stay + after[row, kept], FAR), following + kept),
            (RENAME + stay + after[:, INSERTED[q]], following + INSERTED[q]),
        ]
        for rank in range(len(arcs), 0, -1):
            cost, node = arcs[rank - 1]
            tight = cost == ahead[:, q]
            label[tight, q] = rank
            to[tight, q] = node[tight]
    # Nodes after the last row of a segment end the audit there: rank 0, pointing to themselves.
    nodes = 4 * (n + segments)
    labels = np.append(label.ravel(), np.zeros(4 * segments, np.int64))
    pointer = np.append(to.ravel(), np.arange(4 * n, nodes))
    rank, steps, jumps = labels, (labels > 0).astype(np.int64), [pointer]
    while (pointer < 4 * n).any():
        pairs = rank * (int(rank.max()) + 1) + rank[pointer]
        rank = np.unique(pairs, return_inverse=True)[1]
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        jumps.append(pointer)
    entry = (4 * starts[:, None] + np.arange(4)).ravel()
    _, first, number = np.unique(rank[entry], return_index=True, return_inverse=True)
    audits = _walked(entry[first], steps, jumps, labels)
    return ahead[starts], number.reshape(segments, 4), audits


def _walked(begin: np.ndarray, steps: np.ndarray, jumps: list[np.ndarray], labels: np.ndarray) -> list[str]:
    """Audits of nodes: every place of a path is reached by the jumps that its distance is the sum of."""
    lengths = steps[begin]
    node = np.repeat(begin, lengths)
    distance = np.arange(len(node)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k, jump in enumerate(jumps):
        node = np.where(distance >> k & 1, jump[node], node)
    letters = np.frombuffer(LABELS.encode(), np.uint8)[labels[node] - 1].tobytes().decode()
    cuts = np.cumsum(lengths)
    return [letters[b - l : b] for l, b in zip(lengths, cuts)]


def replay(audit: str, initials: list[int], state: int = START) -> Iterator[tuple[int | None, str, int]]:
    """(row or None for an insertion, edit, state after it) of each edit; a new role is the letter of the state."""
    row = 0
    for edit in audit:
        if edit == "I":
            state = int(INSERTED[state])
            yield None, edit, state
            continue
        if edit == "K":
            state = int(KEPT[initials[row], state])
        elif edit == "R":
            state = int(INSERTED[state])
        yield row, edit, state
        row += 1


_LETTER = {USER: "u", ASSISTANT: "a"}


def _messages(audit: str, initials: list[int], roles: list[str], texts: list[str]) -> list[dict]:
    out = []
    for row, edit, state in replay(audit, initials):
        if edit == "I":
            out.append({"role": ROLES[_LETTER[state]], "text": ""})
        elif edit != "D":
            out.append({"role": ROLES[_LETTER[state]] if edit == "R" else roles[row], "text": texts[row]})
    return out


_MESSAGE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WHOLE = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), *[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("messages", _MESSAGE)])
COLUMNS = "conv_id bigint, at bigint, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string, messages array<struct<role:string,text:string>>"


def _conversations(rows: pa.Table) -> pa.RecordBatch:
    """One row per conversation of a table of whole, sorted conversations."""
    ids = rows["conv_id"].to_pylist()
    first = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]]
    present = np.array(rows["present"].to_pylist(), bool)
    live = np.flatnonzero(present)
    kept = rows.take(pa.array(live))
    turns, roles, texts = (kept[c].to_pylist() for c in ("turn", "role", "text"))
    flags = kept["flags"].to_numpy()
    initial, blank, cut = flags & 3, (flags & 4) > 0, (flags & 8) > 0
    bounds = np.searchsorted(live, [*first, len(ids)])  # first live row of each conversation
    twice = np.zeros(len(live), bool)
    for a, b in zip(bounds, bounds[1:]):
        seen = set()
        for i in range(a, b):
            message = (roles[i], texts[i])
            twice[i] = message in seen
            seen.add(message)
    duplicate = twice & ~blank
    cut &= ~blank & ~duplicate
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    solved: dict[int, tuple[int, str]] = {}
    if len(full):
        costs, number, audits = least_audits(initial, blank | duplicate, cut, bounds[full], np.broadcast_to(END, (len(full), 4)))
        for j, c in enumerate(full):
            solved[c] = int(costs[j, START]), audits[number[j, START]]
    out: list[tuple] = []
    for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
        cost, audit = solved.get(c, (0, ""))
        known = {t for t in turns[a:b] if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = int((~LEGAL_PAIRS[initial[a : b - 1], initial[a + 1 : b]]).sum()) if b - a > 1 else 0
        own = initial[a:b].tolist()
        audit += _closing(audit, own)
        figures = (gaps, int(blank[a:b].sum()), int(duplicate[a:b].sum()), int(cut[a:b].sum()), illegal, cost)
        out.append((ids[first[c]], 0, *figures, audit, _messages(audit, own, roles[a:b], texts[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WHOLE)], schema=_WHOLE)


def _closing(audit: str, initials: list[int]) -> str:
    """Insertions after the last row."""
    state = START
    for _, _, state in replay(audit, initials):
        pass
    return "I" * int(END[state] // INSERT)


def _whole(batches):
    """Repair sorted conversations; the last one of a batch waits for the rest of its rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_pylist()
        if held and held[-1].column("conv_id")[0].as_py() != ids[0]:
            yield _conversations(pa.Table.from_batches(held))
            held = []
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if cut:
            yield _conversations(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _conversations(pa.Table.from_batches(held))


def _prepared(df: DataFrame, present: str | None) -> DataFrame:
    """conv_id, turn, role, text, present, flags (initial, 4 if blank, 8 if truncated), tie."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    ends = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    blank = ends == ""
    cut = ~blank & ~F.substring(ends, -1, 1).isin(".", "!", "?")
    flags = code + F.when(blank, 4).otherwise(0) + F.when(cut, 8).otherwise(0)
    there = F.coalesce(F.col(present), F.lit(True)) if present else F.lit(True)
    plain = df.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"), there.alias("present"))
    return plain.select("*", flags.alias("flags"), F.xxhash64("text").alias("tie"))


#: Order of a conversation's rows; rows of one turn go by role, then by a hash of the text.
ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "tie")


def _order() -> list:
    return [direction(c) for direction, c in ORDER]


def repaired(df: DataFrame, present: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, at, gaps, blank, duplicate, truncated, illegal, cost, audit, messages, whole.

    Takes (conv_id, turn, role, text); ``present`` names a boolean column that is false for rows which only tell that
    their conversation exists. A conversation of ordinary size is one row with ``whole`` true and ``at`` 0. Of a longer
    one, the row ``at`` -1 has the figures, and further rows, in the order of ``at``, parts of audit and messages, which
    are to be joined; their figures are null.

    Turns go up, null turns first; rows of one turn go by role, then by a hash of the text, and equal rows are alike. A
    null role or text is one space; a role whose first letter is not s, u or a can only be deleted or renamed. The null
    conv_id is a conversation. A conversation without present rows has zeros, an empty audit and no messages; an empty
    table gives no rows. Other columns are not read.
    """
    rows = _prepared(df, present)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("_long"))
    long = materialize(long, "long-conversations")
    if long.isEmpty():
        return _short(rows).withColumn("whole", F.lit(True))
    known = F.broadcast(long) if fits(long) else long
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = _short(rows.join(known, same, "left_anti")).withColumn("whole", F.lit(True))
    return short.unionByName(_long(rows.join(known, same, "left_semi"), block_rows).withColumn("whole", F.lit(False)))


def _short(rows: DataFrame) -> DataFrame:
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return dealt.select("conv_id", "turn", "role", "text", "present", "flags").mapInArrow(_whole, COLUMNS)


# Conversations in blocks.


def _long(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of long conversations, repaired block by block."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sorted rows are numbered by task and place, so numbers go up along every conversation; the salt tells equal rows apart.
    dealt = salted.repartitionByRange(parts, "conv_id", *_order(), "salt").sortWithinPartitions("conv_id", *_order(), "salt")
    placed = materialize(dealt.drop("salt", "tie").withColumn("pos", F.monotonically_increasing_id()), "placed")
    live = placed.where("present")
    digest = F.sha2(F.concat_ws("\n", F.octet_length("role"), "role", "text").cast("binary"), 256)
    light = materialize(live.select("conv_id", "turn", "pos", "flags", digest.alias("message")), "messages")
    again = light.groupBy(F.col("conv_id").alias("c"), F.col("message").alias("m")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = light.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left")
    blank = F.col("flags").bitwiseAND(4) > 0
    twice = ~blank & F.coalesce(F.col("pos") != F.col("first"), F.lit(False))
    cut = ~blank & ~twice & (F.col("flags").bitwiseAND(8) > 0)
    block = F.expr(f"pos div {block_rows}")
    coded = marked.select("conv_id", "turn", "pos", block.alias("block"), F.col("flags").bitwiseAND(3).alias("initial"), blank.alias("blank"), twice.alias("duplicate"), cut.alias("truncated"))
    coded = materialize(coded, "coded")
    by_block = coded.select("conv_id", "block", "pos", "initial", (F.col("blank") | F.col("duplicate")).alias("must"), "truncated")
    costs = "conv_id bigint, block bigint, cost array<bigint>, illegal bigint, first int, last int"
    blocks = materialize(_by_block(by_block).mapInArrow(_block_costs, costs), "block-costs")
    backwards = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = materialize(backwards.select("conv_id", "block", "cost").mapInArrow(_fold_back, "conv_id bigint, block bigint, end array<bigint>, ahead bigint"), "block-ends")
    keyed = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "end")
    solvable = by_block.join(keyed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    tokens = "conv_id bigint, block bigint, pos bigint, edits array<string>, exits array<int>"
    solved = materialize(_by_block(solvable).mapInArrow(_block_edits, tokens), "block-edits")
    forwards = solved.where("exits is not null").select("conv_id", "block", "pos", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    entries = materialize(forwards.mapInArrow(_fold_forward, "conv_id bigint, block bigint, pos bigint, entry int, exit int"), "block-entries")
    last = entries.groupBy("conv_id").agg(F.max_by("exit", "block").alias("state"), F.max("pos").alias("end_pos"))
    closing = last.select(F.col("conv_id").alias("lc"), "end_pos", F.when(F.col("state") == USER, "A").when(F.col("state") == SYSTEM, "UA").otherwise("").alias("closing"))
    chosen = (
        solved.join(entries.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
        .join(closing, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("pos") == F.col("end_pos")), "left")
        .select(F.col("pos").alias("p"), F.concat(F.col("edits")[F.col("entry")], F.coalesce("closing", F.lit(""))).alias("edits"))
    )
    chars = F.filter(F.split("edits", ""), lambda e: e != "")
    role = lambda e: F.when(e.isin("U", "r"), "user").when(e.isin("A", "q"), "assistant").otherwise(F.col("role"))
    made = F.transform(F.filter(chars, lambda e: e != "D"), lambda e: F.struct(role(e).alias("role"), F.when(e.isin("U", "A"), "").otherwise(F.col("text")).alias("text")))
    parts_of = live.join(chosen, F.col("pos") == F.col("p")).select(
        "conv_id", F.col("pos").alias("at"), *[F.lit(None).cast("bigint").alias(c) for c in FIGURES], F.translate("edits", "UArq", "IIRR").alias("audit"), made.alias("messages")
    )
    return _figures(placed, coded, blocks, ends).unionByName(parts_of)


def _figures(placed: DataFrame, coded: DataFrame, blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """The row ``at`` -1 of every long conversation."""
    turns = coded.where("turn is not null").select("conv_id", "turn").distinct()
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = coded.groupBy("conv_id").agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")])
    pair = F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")) * 4 + F.col("first")
    legal = [int(4 * a + b) for a, b in zip(*np.nonzero(LEGAL_PAIRS))]
    joints = blocks.select("conv_id", "illegal", pair.alias("pair"))
    illegal = joints.groupBy("conv_id").agg(F.sum(F.col("illegal") + F.when(F.col("pair").isNotNull() & ~F.col("pair").isin(legal), 1).otherwise(0)).alias("illegal"))
    cost = ends.groupBy("conv_id").agg(F.min_by("ahead", "block").alias("cost"))
    out = placed.select("conv_id").distinct()
    for part in (gaps, faults, illegal, cost):
        out = out.join(part.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    return out.select("conv_id", F.lit(-1).cast("bigint").alias("at"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in FIGURES], F.lit("").alias("audit"), none.alias("messages"))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")


def _blocks_of(batches) -> Iterator[pa.Table]:
    """Whole blocks of sorted rows, one at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist()))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if held and keys[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _coded(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array(block[c].to_pylist(), kind) for c, kind in (("initial", np.int64), ("must", bool), ("truncated", bool)))


def _block_costs(batches):
    for block in _blocks_of(batches):
        initial, must, truncated = _coded(block)
        whole = suffix_costs(row_costs(initial, must, truncated), np.full(len(initial), len(initial) - 1))[0]
        illegal = int((~LEGAL_PAIRS[initial[:-1], initial[1:]]).sum())
        row = {"conv_id": block["conv_id"][0].as_py(), "block": block["block"][0].as_py(), "cost": whole.ravel().tolist(), "illegal": illegal, "first": int(initial[0]), "last": int(initial[-1])}
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))


def _fold_back(batches):
    """Costs to the end after each block, from the last block on."""
    now, end = (), END
    for batch in batches:
        ends, aheads = [], []
        for conv, cost in zip(batch.column("conv_id").to_pylist(), batch.column("cost").to_pylist()):
            if (conv,) != now:
                now, end = (conv,), END
            ends.append(end.tolist())
            end = (np.array(cost).reshape(4, 4) + end).min(axis=1)
            aheads.append(int(end[START]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(ends, pa.list_(pa.int64())), pa.array(aheads, pa.int64())], ["conv_id", "block", "end", "ahead"])


def _block_edits(batches):
    """For every row, its edits under each state the block may be entered in: U and A insert, r and q rename to user and
    assistant. The last row of a block has the states in which the block is left."""
    for block in _blocks_of(batches):
        initial, must, truncated = _coded(block)
        end = np.array(block["end"][0].as_py())[None, :]
        _, number, audits = least_audits(initial, must, truncated, np.array([0]), end)
        codes = initial.tolist()
        edits = [[""] * 4 for _ in codes]
        exits = []
        for entry in range(4):
            before, state = "", entry
            for row, edit, state in replay(audits[number[0, entry]], codes, entry):
                if row is None:
                    before += "U" if state == USER else "A"
                else:
                    edits[row][entry] = before + (("r" if state == USER else "q") if edit == "R" else edit)
                    before = ""
            exits.append(state)
        left = [None] * (len(codes) - 1) + [exits]
        columns = [block["conv_id"].combine_chunks(), block["block"].combine_chunks(), block["pos"].combine_chunks(), pa.array(edits, pa.list_(pa.string())), pa.array(left, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "pos", "edits", "exits"])


def _fold_forward(batches):
    """States in which each block is entered and left, from the first block on."""
    now, state = (), START
    for batch in batches:
        entries, left = [], []
        for conv, exits in zip(batch.column("conv_id").to_pylist(), batch.column("exits").to_pylist()):
            if (conv,) != now:
                now, state = (conv,), START
            entries.append(state)
            state = exits[state]
            left.append(state)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(entries, pa.int32()), pa.array(left, pa.int32())], ["conv_id", "block", "pos", "entry", "exit"])


def digested(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: conv_id, figures, audit, repaired_sha256 (``role:text``, newline-joined).

    A digest is taken in order, so the parts of a long conversation stream through one task, which holds only the digest
    and the audit.
    """
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    whole = parts.where("whole").select("conv_id", *FIGURES, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    split = parts.where("not whole")
    flat = split.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "at", *FIGURES, "audit", "messages")
    kinds = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string, repaired_sha256 string"
    return whole.unionByName(flat.mapInArrow(_streamed, kinds))


def _streamed(batches):
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    head, sha, audit, empty = None, None, [], True

    def closed():
        return pa.RecordBatch.from_pylist([{**head, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["at"] == -1:
                if head:
                    yield closed()
                head, sha, audit, empty = {c: row[c] for c in ("conv_id", *FIGURES)}, hashlib.sha256(), [], True
            audit.append(row["audit"])
            for m in row["messages"]:
                sha.update(f"{'' if empty else chr(10)}{m['role']}:{m['text']}".encode())
                empty = False
    if head:
        yield closed()


#: Cheapest edits row by row: ``paths`` keeps the best (cost, audit, lines) of each state after i rows.
CHECK_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
drawn AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
    FROM conversations, crc_table
),
planted AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM drawn, range(2) AS copies(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM planted),
faults AS (
    SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        left(role, 1) AS own, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
),
coded AS (
    SELECT *, again AND NOT blank AS duplicate,
        NOT blank AND NOT again AND regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS truncated
    FROM faults
),
inserted(state, ahead, edits, price, lines) AS (
    VALUES ('', '', '', 0, []::VARCHAR[]), ('s', 's', '', 0, []), ('u', 'u', '', 0, []), ('a', 'a', '', 0, []),
        ('', 'u', 'I', 5, ['user:']), ('s', 'u', 'I', 5, ['user:']), ('a', 'u', 'I', 5, ['user:']), ('u', 'a', 'I', 5, ['assistant:']),
        ('', 'a', 'II', 10, ['user:', 'assistant:']), ('s', 'a', 'II', 10, ['user:', 'assistant:'])
),
edits(ahead, edit, own, after, price) AS (
    VALUES ('', 'D', NULL, '', 2), ('s', 'D', NULL, 's', 2), ('u', 'D', NULL, 'u', 2), ('a', 'D', NULL, 'a', 2),
        ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0),
        ('', 'R', NULL, 'u', 1), ('s', 'R', NULL, 'u', 1), ('a', 'R', NULL, 'u', 1), ('u', 'R', NULL, 'a', 1)
),
paths AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM conversations
    UNION ALL
    SELECT p.conv_id, p.i + 1, e.after, min({{
        'cost': p.best.cost + n.price + e.price + CASE WHEN e.edit <> 'D' AND c.truncated THEN 5 ELSE 0 END,
        'audit': p.best.audit || n.edits || e.edit,
        'lines': p.best.lines || n.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [c.role || ':' || c.text]
            ELSE [CASE e.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || c.text] END}})
    FROM paths p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1
    JOIN inserted n ON n.state = p.state
    JOIN edits e ON e.ahead = n.ahead AND (e.edit = 'D' OR NOT c.blank AND NOT c.duplicate) AND (e.own IS NULL OR e.own = c.own)
    GROUP BY p.conv_id, p.i, e.after
),
closed AS (
    SELECT p.conv_id, p.i, min({{'cost': p.best.cost + n.price, 'audit': p.best.audit || n.edits, 'lines': p.best.lines || n.lines}}) AS best
    FROM paths p JOIN inserted n ON n.state = p.state AND n.ahead IN ('', 'a') GROUP BY p.conv_id, p.i
),
solved AS (SELECT conv_id, arg_max(best, i) AS best FROM closed GROUP BY conv_id),
figures AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
        count_if(truncated) AS truncated, count_if(before || own NOT IN ('su', 'ua', 'au')) AS illegal
    FROM coded GROUP BY conv_id
)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, s.best.cost::BIGINT AS cost, s.best.audit AS audit,
    sha256(array_to_string(s.best.lines, chr(10))) AS repaired_sha256
FROM solved s LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM s.conv_id
"""
