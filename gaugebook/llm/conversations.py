"""Repair of conversations by a least-cost edit script, with checkpointed backward costs.

A repaired conversation reads `(s?(ua)+)?` in initials of roles. Rows are kept (0), given
the role that is due (1) or deleted (2); empty rows may be inserted (5); a truncated row
that stays costs 5. Which script is cheapest is a dynamic programme over rows and four
states (nothing yet, after the system's, a user's, an assistant's row).

A conversation of any length is cut into segments: rows are dealt by ranges of
(conversation, turn, role, text), so a segment is what one range holds of a conversation.

1. `segments`: each segment becomes one byte a row and the 4 x 4 matrix of its least costs
   from state to state. Nothing but bytes of one range is held.
2. `with_costs`: the matrices of a conversation, one for each of its ranges, are combined
   from the last to the first; this gives the cost of all that follows at each segment's end.
3. `walks`: inside a segment, backward cost vectors are stored at checkpoints only, one
   every sqrt(rows); walking forward, the vectors of one block at a time are recomputed
   from its checkpoint, and the ASCII-least edit whose cost is tight is taken. A segment is
   walked from each state it may be entered in.
4. `scripts`: the entry states follow from segment to segment, which selects the walks.

Defined results: a null role or text counts as one space; turns sort with nulls first, and
rows of one turn by role, then text; a null conv_id is a conversation like any other; rows
that are equal in all columns are one row and further copies, which are duplicates;
conversations without rows have an empty script; an empty table gives no rows; extra
columns are ignored. A role counts by its first character only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugebook.session import stage

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: Characters of a text that ranges are told apart by.
RANGE_CHARS = 256
#: Rows handed on at a time.
OUT_ROWS = 4096
FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the user's or assistant's row that is due in a state.
DUE = (USER, USER, ASSISTANT, USER)
#: What may follow the last row: nothing, or the rows that complete a pair.
ENDING = (0, 2 * INSERT, INSERT, 0)
#: A row's byte: 3 * initial (s, u, a, other) + 0 sound, 1 truncated, 2 to be deleted.
SOUND, CUT, GONE = range(3)


def _transitions() -> list[list[list[tuple[str, int, int]]]]:
    """[byte][state] -> edits that consume the row: (letter, cost, next state), in ASCII order."""
    table = []
    for initial in range(4):
        for fault in (SOUND, CUT, GONE):
            states = []
            for state in range(4):
                edits = [("D", DELETE, state)]
                if fault != GONE:
                    more = TRUNCATED if fault == CUT else 0
                    if initial == 0 and state == START:
                        edits.append(("K", more, SYSTEM))
                    due = DUE[state]
                    if initial == due - 1:
                        edits.append(("K", more, due))
                    edits.append(("R", REROLE + more, due))
                states.append(edits)
            table.append(states)
    return table


EDITS = _transitions()
_STEPS = [[[(cost, after) for _, cost, after in edits] for edits in states] for states in EDITS]


def before(code: int, after: list[int]) -> list[int]:
    """Costs from each state ahead of a row, given those behind it."""
    steps = _STEPS[code]
    c = [min([cost + after[s] for cost, s in steps[state]]) for state in range(4)]
    return with_inserts(c)


def with_inserts(c: list[int]) -> list[int]:
    """Rows may be inserted ahead; more than two in a row only come back to the same state."""
    return [min(c[s], INSERT + c[DUE[s]], 2 * INSERT + c[DUE[DUE[s]]]) for s in range(4)]


def matrix(codes: bytes) -> list[int]:
    """Least costs [from * 4 + to] through the rows of a segment, inserts ahead of each row included."""
    columns = []
    for to in range(4):
        c = [FAR] * 4
        c[to] = 0
        for code in reversed(codes):
            c = before(code, c)
        columns.append(c)
    return [min(columns[to][s], FAR) for s in range(4) for to in range(4)]


def behind(matrices: list[list[int]]) -> list[list[int]]:
    """The cost vector at the end of each segment of a conversation."""
    ends = []
    vector = list(ENDING)
    for m in reversed(matrices):
        ends.append(vector)
        vector = [min(m[s * 4 + to] + vector[to] for to in range(4)) for s in range(4)]
    return ends[::-1]


def walk(codes: bytes, end: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least tight edits from `state`, and the state they lead to.

    Only the vectors at checkpoints and those of the block at hand are stored.
    """
    n = len(codes)
    size = isqrt(n) + 1
    vector = list(end)
    checkpoints = {n: vector}
    for i in range(n - 1, -1, -1):
        vector = before(codes[i], vector)
        if i % size == 0:
            checkpoints[i] = vector
    out = []
    for start in range(0, n, size):
        stop = min(start + size, n)
        block = [checkpoints[stop]]
        for i in range(stop - 1, start - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for i in range(start, stop):
            here, after = block[i - start], block[i - start + 1]
            while True:
                edits = EDITS[codes[i]][state]
                cost = here[state]
                letter, _, to = edits[0]
                if DELETE + after[to] == cost:
                    out.append("D")
                    break
                if INSERT + here[DUE[state]] == cost:
                    out.append("I")
                    state = DUE[state]
                    continue
                letter, to = next((e, s) for e, c, s in edits[1:] if c + after[s] == cost)
                out.append(letter)
                state = to
                break
    while last and ENDING[state]:
        out.append("I")
        state = DUE[state]
    return "".join(out), state


# ---- rows ------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) that are left of `conversations` after the damage.

    crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`,
    3 repeats it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn = rows["conv_id"].cast("long"), rows["turn"].cast("long")
    kind = F.crc32(F.concat(text(conv), F.lit(":"), text(turn)).cast("binary")) % 20
    return rows.select(
        conv.alias("conv_id"), turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(text(rows["role"])).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text(rows["text"]), ".!?", "")).otherwise(text(rows["text"])).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number; `fault` of the first: blank, duplicate, truncated or null."""
    key = ["conv_id", "role", "text"]
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    by_turn = folded.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text"))
    first = by_turn.groupBy(*key).agg(F.min("turn").alias("first"), F.count_if(F.col("turn").isNull()).alias("unset"),
                                      F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("text").alias("f_text"), "first", "unset")
    told = folded.withColumn("t_sha", F.sha2("text", 256)).join(
        first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("t_sha") == F.col("f_text")), "left")
    again = F.col("turn").isNotNull() & F.coalesce((F.col("unset") > 0) | (F.col("turn") > F.col("first")), F.lit(False))
    ending = F.expr(f"right(trim(TRAILING '{_sql(WHITE)}' FROM text), 1)")
    fault = F.when(ending == "", "blank").when(again, "duplicate").when(~ending.isin(".", "!", "?"), "truncated")
    return told.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _sql(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in chars)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def dealt(rows: DataFrame) -> DataFrame:
    """Judged rows in ranges, staged: `part` is the range, `at` the first of a row's places in it."""
    fault = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    rows = rows.withColumn("code", (3 * _initial(F.col("role")) + fault).cast("int"))
    ranges = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))
    # All of null's rows come first, in ranges as in the sort.
    ordered = ranges.sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")


# ---- segments --------------------------------------------------------------------------


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _streamed(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())),
                      ("pairs", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def segments(turns: DataFrame) -> DataFrame:
    """One row per conversation and range: bytes of its rows, matrix, illegal neighbours, end initials."""
    def closed(key, codes, illegal):
        return *key, bytes(codes), matrix(codes), illegal, codes[0] // 3, codes[-1] // 3

    def fold(batches):
        def rows():
            key, codes, illegal = None, bytearray(), 0
            for conv, part, code, copies in _streamed(batches, ["conv_id", "part", "code", "copies"]):
                if key != (conv, part) and codes:
                    yield closed(key, codes, illegal)
                    codes, illegal = bytearray(), 0
                key = conv, part
                initial = code // 3
                illegal += copies - 1 + (len(codes) > 0 and not _legal(codes[-1] // 3, initial))
                codes.append(code)
                codes.extend(bytes([3 * initial + GONE]) * (copies - 1))
            if codes:
                yield closed(key, codes, illegal)

        yield from _batches(rows(), SEGMENTS)

    # A file split may hold several ranges, and a range may lie in several splits.
    rows = turns.select("conv_id", "part", "at", "code", "copies").repartition("conv_id", "part")
    return stage(rows.sortWithinPartitions("conv_id", "part", "at").mapInArrow(
        fold, "conv_id long, part int, codes binary, matrix array<long>, pairs long, first int, last int"), "segments")


def _per_conversation(rows: DataFrame, columns: list[str], fn: Callable, out: pa.StructType, schema: str) -> DataFrame:
    """`fn` over the segments of a conversation, of which there is one a range, in their order."""
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias("s"))

    def each(batches):
        for batch in batches:
            found = [fn(s) for s in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(found, pa.list_(out))], names=["conv_id", "found"])

    return lists.mapInArrow(each, f"conv_id long, found array<struct<{schema}>>").select("conv_id", F.inline("found"))


def with_costs(cut: DataFrame) -> DataFrame:
    """Adds `end`, the cost vector behind each segment, and `final`. The first segment of a
    conversation gets `cost` and `illegal` of the whole."""
    def chain(found):
        ends = behind([s["matrix"] for s in found])
        m = found[0]["matrix"]
        cost = min(m[to] + ends[0][to] for to in range(4))
        illegal = sum(s["pairs"] for s in found) + sum(not _legal(a["last"], b["first"]) for a, b in zip(found, found[1:]))
        return [{"c_part": s["part"], "end": e, "final": i == len(found) - 1, "cost": None if i else cost,
                 "illegal": None if i else illegal} for i, (s, e) in enumerate(zip(found, ends))]

    out = pa.struct([("c_part", pa.int32()), ("end", pa.list_(pa.int64())), ("final", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
    costs = _per_conversation(cut, ["matrix", "pairs", "first", "last"], chain, out,
                              "c_part: int, end: array<bigint>, final: boolean, cost: bigint, illegal: bigint")
    costs = costs.withColumnRenamed("conv_id", "c_conv")
    joined = cut.join(costs, cut["conv_id"].eqNullSafe(costs["c_conv"]) & (cut["part"] == costs["c_part"]))
    return joined.select("conv_id", "part", "codes", "end", "final", "cost", "illegal")


WALKS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()),
                   ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])


def walks(costed: DataFrame) -> DataFrame:
    """For each segment and each state it may be entered in: its edits and the state behind them."""
    def go(batches):
        def rows():
            names = ["conv_id", "part", "codes", "end", "final", "cost", "illegal"]
            for conv, part, codes, end, final, cost, illegal in _streamed(batches, names):
                for state in (START,) if cost is not None else range(4):
                    edits, leads = walk(codes, end, state, final)
                    yield conv, part, state, leads, edits, cost, illegal

        yield from _batches(rows(), WALKS)

    return stage(costed.mapInArrow(
        go, "conv_id long, part int, entry int, exit int, edits string, cost long, illegal long"), "walks")


def scripts(walked: DataFrame) -> DataFrame:
    """The walk of each segment that the walks before it lead into."""
    def follow(found):
        leads: dict[int, dict[int, int]] = {}
        for s in found:
            leads.setdefault(s["part"], {})[s["entry"]] = s["exit"]
        state, out = START, []
        for part in sorted(leads):
            out.append({"t_part": part, "t_entry": state})
            state = leads[part][state]
        return out

    taken = _per_conversation(walked, ["entry", "exit"], follow, pa.struct([("t_part", pa.int32()), ("t_entry", pa.int32())]),
                              "t_part: int, t_entry: int").withColumnRenamed("conv_id", "t_conv")
    joined = walked.join(taken, walked["conv_id"].eqNullSafe(taken["t_conv"]) & (walked["part"] == taken["t_part"])
                         & (walked["entry"] == taken["t_entry"]))
    return joined.select("conv_id", "part", "entry", "edits", "cost", "illegal")


# ---- repaired conversations ----------------------------------------------------------------

#: Roles that states stand for.
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _with_scripts(turns: DataFrame, taken: DataFrame, *key: str) -> DataFrame:
    """Rows and, ahead of the rows of each segment, its script; in order, whole by `key`."""
    rows = turns.select("conv_id", "part", "at", "role", "text", "copies", F.lit(None).cast("int").alias("entry"))
    heads = taken.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"),
                         F.col("edits").alias("text"), F.lit(0).cast("long").alias("copies"), "entry")
    return rows.unionByName(heads).repartition(*key).sortWithinPartitions("conv_id", "part", "at")


def _applied(batches) -> Iterator[tuple]:
    """(conv_id, part, edit, role, text) in order; deleted rows keep what they said."""
    conv = part = None
    script, at, state = "", 0, START

    def inserts():
        nonlocal at, state
        while at < len(script) and script[at] == "I":
            at += 1
            state = DUE[state]
            yield conv, part, "I", ROLES[state], ""

    for conv_, part_, role, text, copies, entry in _streamed(batches, ["conv_id", "part", "role", "text", "copies", "entry"]):
        if entry is not None:
            yield from inserts()
            conv, part, script, at, state = conv_, part_, text, 0, entry
            continue
        for _ in range(copies):
            yield from inserts()
            edit = script[at]
            at += 1
            if edit == "D":
                yield conv, part, "D", role, text
                continue
            state = SYSTEM if edit == "K" and state == START and role[:1] == "s" else DUE[state]
            yield conv, part, edit, role if edit == "K" else ROLES[state], text
    yield from inserts()


EDIT_ROWS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("step", pa.int64()), ("edit", pa.string()),
                       ("role", pa.string()), ("text", pa.string())])


def edits(turns: DataFrame, taken: DataFrame) -> DataFrame:
    """Every edit with the role and text it leaves (or deletes), in the order of (part, step)."""
    def go(batches):
        def rows():
            key, step = None, 0
            for conv, part, edit, role, text in _applied(batches):
                step = step + 1 if key == (conv, part) else 0
                key = conv, part
                yield conv, part, step, edit, role, text

        yield from _batches(rows(), EDIT_ROWS)

    return _with_scripts(turns, taken, "conv_id", "part").mapInArrow(
        go, "conv_id long, part int, step long, edit string, role string, text string")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digests(turns: DataFrame, taken: DataFrame) -> DataFrame:
    """conv_id, audit and sha256 of the repaired rows. The hash of a conversation is one running
    state, so its rows stream through one task in order; none of them is held."""
    def go(batches):
        def rows():
            now, letters, sha, empty, any_ = None, [], hashlib.sha256(), True, False
            for conv, _, edit, role, text in _applied(batches):
                if any_ and conv != now:
                    yield now, "".join(letters), sha.hexdigest()
                    letters, sha, empty = [], hashlib.sha256(), True
                now, any_ = conv, True
                letters.append(edit)
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if any_:
                yield now, "".join(letters), sha.hexdigest()

        yield from _batches(rows(), DIGESTS)

    return _with_scripts(turns, taken, "conv_id").mapInArrow(go, "conv_id long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judged rows in ranges, scripts of their segments) of conversations; see `edits`, `digests`.

    `rows` has conv_id, turn, role, text and copies, the number of times a row stands there.
    """
    turns = dealt(judged(rows))
    return turns, scripts(walks(with_costs(segments(turns))))


def audit(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and reports, per original conv_id, faults and cheapest repair."""
    turns, taken = repaired(damaged(conversations))
    taken = stage(taken, "scripts")
    is_first = lambda name: F.when(F.col("fault") == name, 1).otherwise(0)
    more = F.col("copies") - 1
    blank = F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0))
    again = F.sum(F.when(F.col("fault") == "blank", 0).otherwise(more + is_first("duplicate")))
    by_turn = turns.groupBy("conv_id", "turn").agg(blank.alias("blank"), again.alias("duplicate"), F.sum(is_first("truncated")).alias("truncated"))
    counted = by_turn.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = taken.where("cost IS NOT NULL").select("conv_id", "illegal", "cost")
    originals = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    parts = originals
    for part in (counted, whole, digests(turns, taken)):
        parts = parts.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = hashlib.sha256().hexdigest()
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256"))
