"""Conversation structure repair by divide and conquer over four states.

A conversation is in order if its roles read ``(s?(ua)+)?``: nothing, or a system turn
perhaps and then user and assistant in turn. Its state is what the turns so far end with:
nothing yet (0), system (1), user (2) or assistant (3); a conversation may end in 0 or 3.

Edits: Keep a row (0), Rerole it to user or assistant (3), Delete it (4; required for blank
and duplicate rows), Insert an empty user or assistant turn (3); a truncated row that is
not deleted adds 3. Of the cheapest edits those whose initials are least in ASCII win.

Hirschberg's method, with costs of four states in place of a table's row: costs from the
start to the middle and from the end back to it meet there, the cheapest crossing is
chosen, and both halves follow by themselves. Of equally cheap crossings the one with the
least initials before it wins. The initials that lead to different states after the same
rows differ, and none begins another, so their order is all that has to be carried along:
four ranks beside the four costs. Space is linear in the rows, whatever is kept.

A conversation of any size is spread out: its rows get places by a sort, ``FAN`` adjoining
places at most make a node, ``FAN`` nodes the next higher one. A node's costs and ranks
between all entry and exit states fit in 35 numbers. They are put together upwards, until
a conversation is one node, and downwards each node is told where it is entered and left.
Conversations inside one node, that is nearly all, need neither.

Defined cases: nulls count as one space, so a null text is blank and a null role in no
order. Rows are taken by turn (null first), then role and text. A null ``conv_id`` is one
conversation. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.llm.storage import written

INITIALS = "sua"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
TURN = {0: "u", 1: "u", 2: "a", 3: "u"}  # what a state asks for next
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 3, 4, 3, 3
FAULTS = ["", "blank", "duplicate", "truncated"]
FAN = 12  # bits
FAR = 1 << 60
#: Cost and edits from the last state to an accepting one.
ENDING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
SPACE = r"[\x20\x09-\x0D]"
PREFIX = 256


def kind_of(initial: str, fault: str) -> int:
    """A row as a small number: what it begins with (3: anything else) and its fault."""
    return (INITIALS.find(initial) if initial in ("s", "u", "a") else 3) * 4 + FAULTS.index(fault)


@lru_cache(None)
def steps(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """For entry and exit state: the cheapest edits around a row, ending with its own; the least initials of equal ones."""
    initial, fault = (*INITIALS, "")[kind // 4], FAULTS[kind % 4]
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(a: int, b: int, cost: int, edits: str):
        best[a, b] = min(best.get((a, b), (FAR, "")), (cost, edits))

    for a in range(4):
        state, spent, edits = a, 0, ""
        for _ in range(3):  # a third insertion only comes back to a state
            offer(a, state, spent + DELETE, edits + "D")
            if fault not in ("blank", "duplicate"):
                held = spent + TRUNCATED_KEPT * (fault == "truncated")
                if initial and state in NEXT[initial]:
                    offer(a, NEXT[initial][state], held, edits + "K")
                offer(a, NEXT[TURN[state]][state], held + REROLE, edits + "R")
            state, spent, edits = NEXT[TURN[state]][state], spent + INSERT, edits + "I"
    return best


@lru_cache(None)
def row_element(kind: int) -> tuple[int, ...]:
    """A row as an element: 16 costs by entry and exit, 16 ranks of the exits by the initials that lead to them,
    illegal neighbours inside, first and last initial (0-2, else 3)."""
    table = steps(kind)
    costs = [table.get((a, b), (FAR, ""))[0] for a in range(4) for b in range(4)]
    ranks = []
    for a in range(4):
        order = sorted(range(4), key=lambda b: table.get((a, b), (FAR, "~"))[1])
        ranks += [order.index(b) for b in range(4)]
    return (*costs, *ranks, 0, kind // 4, kind // 4)


LEGAL = {(0, 1), (1, 2), (2, 1)}


def forward(elements, entry: int) -> tuple[list[int], list[int]]:
    """Costs of the four states behind ``elements``, and the ranks of the least initials that lead there."""
    costs, ranks = [FAR] * 4, [0, 1, 2, 3]
    costs[entry] = 0
    for e in elements:
        found = []
        for b in range(4):
            cost, rank, a = min((costs[a] + e[4 * a + b], ranks[a], a) for a in range(4))
            found.append((cost, rank, e[16 + 4 * a + b]))
        costs = [min(f[0], FAR) for f in found]
        order = sorted(range(4), key=lambda b: found[b][1:])
        ranks = [order.index(b) for b in range(4)]
    return costs, ranks


def backward(elements, costs: list[int]) -> list[int]:
    """Costs from the four states before ``elements``, given those behind them."""
    for e in reversed(elements):
        costs = [min(min(e[4 * a + b] + costs[b] for b in range(4)), FAR) for a in range(4)]
    return costs


def ending(exit_: int | None) -> list[int]:
    """Costs behind the last element: of a given exit state, or of the end of a conversation."""
    return [ENDING[b][0] if exit_ is None else (0 if b == exit_ else FAR) for b in range(4)]


def crossings(elements, entry: int, exit_: int | None) -> list[int]:
    """The state behind each element, on the cheapest way with the least initials."""
    out = [0] * len(elements)

    def halve(low: int, high: int, entry: int, end: list[int]):
        """States behind the elements ``low`` to ``high - 1``; ``end``: the costs that follow."""
        middle = (low + high + 1) // 2
        costs, ranks = forward(elements[low:middle], entry)
        after = backward(elements[middle:high], end)
        out[middle - 1] = b = min(range(4), key=lambda b: (costs[b] + after[b], ranks[b]))
        if middle - low > 1:
            halve(low, middle, entry, [0 if c == b else FAR for c in range(4)])
        if middle < high:
            halve(middle, high, b, end)

    if elements:
        halve(0, len(elements), entry, ending(exit_))
    return out


def joined(elements) -> tuple[int, ...]:
    """One element for several in a row."""
    costs, ranks = [], []
    for a in range(4):
        c, r = forward(elements, a)
        costs += c
        ranks += r
    illegal = sum(e[32] for e in elements) + sum((x[34], y[33]) not in LEGAL for x, y in zip(elements, elements[1:]))
    return (*costs, *ranks, illegal, elements[0][33], elements[-1][34])


# -- rows -------------------------------------------------------------------


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, pos`` with places in the order of conversations and their turns, written.

    Rows are dealt by ranges that go down to the text (its first ``PREFIX`` characters and its hash), so a hot
    conversation, and even a hot turn of it, is spread; equal rows, which may go in any order, by a number.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    frame = rows.select("conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    keys = ["conv_id", "turn", "role", "_start", "_hash"]
    frame = frame.withColumns({"_start": F.substring("text", 1, PREFIX), "_hash": F.xxhash64("text"), "_spread": spread})
    frame = frame.repartitionByRange(*keys, "_spread").sortWithinPartitions(*keys, "text")
    return written(frame.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "ordered")


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, pos, initial, fault`` for ``ordered`` rows; earlier equal rows are found by 128-bit digests."""
    end = F.substring(F.regexp_extract("text", r"([^\x20\x09-\x0D])" + SPACE + r"*\z", 1), 1, 1)
    marked = rows.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"), end.alias("end"))
    marked = marked.withColumn("blank", F.col("end") == "")
    first = marked.filter(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    found = marked.join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    return found.select("conv_id", "turn", "pos", "initial", fault.alias("fault"))


def nodes(marks: DataFrame) -> DataFrame:
    """``conv_id, node, rows`` with the places and kinds of at most ``2 ** FAN`` rows, in order, and counts of faults; written."""
    initial = F.when(F.col("initial").isin(*INITIALS), F.instr(F.lit(INITIALS), F.col("initial")) - 1).otherwise(3)
    kind = initial * 4 + F.when(F.col("fault") == "", 0).otherwise(F.expr("array_position(array('blank', 'duplicate', 'truncated'), fault)"))
    grouped = marks.withColumn("node", F.shiftright("pos", FAN)).groupBy("conv_id", "node").agg(
        F.sort_array(F.collect_list(F.struct("pos", kind.cast("int").alias("kind")))).alias("rows"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS[1:]])
    return written(grouped, "nodes")


ELEMENT = "conv_id {id}, node long, element array<long>"
WAY = "conv_id {id}, node long, entry int, exit int"


def _typed(frame: DataFrame, schema: str) -> str:
    return schema.format(id=frame.schema["conv_id"].dataType.simpleString())


def _rows_of(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows, schema: pa.Schema, size: int = 1024):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _mapped(frame: DataFrame, make, ddl: str) -> DataFrame:
    """Rows as dictionaries through ``make`` (an iterable in, one out), in batches."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return frame.mapInArrow(lambda batches: _batches(make(_rows_of(batches)), schema), ddl)


def _of_rows(found):
    for row in found:
        yield {"conv_id": row["conv_id"], "node": row["node"], "element": joined([row_element(r["kind"]) for r in row["rows"]])}


def _of_nodes(found):
    for row in found:
        yield {"conv_id": row["conv_id"], "node": row["parent"], "element": joined([n["element"] for n in row["nodes"]])}


def _down(found):
    """The ways through the nodes below from the way through a node."""
    for row in found:
        state, below = row["entry"], row["nodes"]
        for n, after in zip(below, crossings([n["element"] for n in below], state, row["exit"])):
            yield {"conv_id": row["conv_id"], "node": n["node"], "entry": state, "exit": after}
            state = after


def matched(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Joined by ``conv_id``, where null equals null, and ``names``; what ``right`` has beside them is added."""
    own = right.select(*[F.col(c).alias(f"_{c}" if c in ("conv_id", *names) else c) for c in right.columns])
    condition = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for name in names:
        condition &= F.col(name) == F.col(f"_{name}")
    return left.join(own, condition, how).drop(*[f"_{c}" for c in ("conv_id", *names)])


def ways(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, node, entry, exit`` of the nodes of conversations in several nodes, and ``conv_id, element`` of these conversations.

    The number of levels follows from the length of a place, 63 bits; conversations leave once they are one node.
    """
    several = packed.groupBy("conv_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("conv_id")
    several = written(several, "several")
    inside = matched(packed, several, how="left_semi").select("conv_id", "node", "rows")
    level = written(_mapped(inside, _of_rows, _typed(packed, ELEMENT)), "level")
    levels, tops = [], []
    while not level.isEmpty():
        parents = level.groupBy("conv_id", F.shiftright("node", FAN).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "element"))).alias("nodes"))
        parents = written(parents, "parents")
        levels.append(parents)
        level = written(_mapped(parents, _of_nodes, _typed(packed, ELEMENT)), "level")
        done = level.groupBy("conv_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low = high").select("conv_id")
        done = written(done, "done")
        tops.append(matched(level, done, how="left_semi"))
        level = written(matched(level, done, how="left_anti"), "level")
    empty = packed.sparkSession.createDataFrame([], _typed(packed, WAY))
    way, roots = empty, packed.sparkSession.createDataFrame([], _typed(packed, ELEMENT))
    for parents, top in zip(reversed(levels), reversed(tops)):
        roots = roots.union(top)
        start = top.select("conv_id", "node", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("exit")).union(way)
        start = start.withColumnRenamed("node", "parent")
        both = matched(parents, start, "parent").select("conv_id", "nodes", "entry", "exit")
        way = written(_mapped(both, _down, _typed(packed, WAY)), "way")
    return way, roots.select("conv_id", "element")


def _edits(found):
    for row in found:
        state, last = row["entry"] or 0, row["exit"] is None or row["closing"]
        kinds = [r["kind"] for r in row["rows"]]
        elements = [row_element(k) for k in kinds]
        behind = crossings(elements, state, row["exit"])
        illegal = sum((x[34], y[33]) not in LEGAL for x, y in zip(elements, elements[1:]))
        for k, (r, after) in enumerate(zip(row["rows"], behind)):
            cost, edits = steps(r["kind"])[state, after]
            if last and k == len(kinds) - 1:
                cost, edits = cost + ENDING[after][0], edits + ENDING[after][1]
            yield {"conv_id": row["conv_id"], "pos": r["pos"], "state": state, "edits": edits, "cost": cost, "illegal": illegal if not k else 0}
            state = after


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: the ``ordered`` rows; the edits of each, ``conv_id, pos, state, edits, cost, illegal``;
    and ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` of each conversation.

    ``state`` is the one before the row's edits, which end with the insertions after the last row.
    """
    placed = ordered(rows)
    marks = faults(placed)
    packed = nodes(marks)
    way, roots = ways(packed)
    closing = way.groupBy("conv_id").agg(F.max("node").alias("node")).withColumn("closing", F.lit(True))
    way = matched(way, closing, "node", how="left").withColumn("closing", F.coalesce("closing", F.lit(False)))
    both = matched(packed, way, "node", how="left").select("conv_id", "rows", "entry", "exit", "closing")
    done = written(_mapped(both, _edits, _typed(packed, "conv_id {id}, pos long, state int, edits string, cost long, illegal long")), "edits")

    # Illegal neighbours at the edges of nodes are in the elements of conversations in several nodes.
    edits = done.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("inner"))
    whole = roots.select("conv_id", F.get("element", F.lit(32)).alias("whole"))
    counts = packed.groupBy("conv_id").agg(*[F.sum(f).alias(f) for f in FAULTS[1:]])
    turns = placed.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = matched(edits, whole, how="left").withColumn("illegal", F.coalesce("whole", "inner"))
    found = matched(matched(found, counts), turns)
    report = found.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *FAULTS[1:], "illegal", "cost")
    return placed, done, written(report, "report")


def turns_after(state: int, edits: str, role: str, text: str):
    """The turns that a row's edits leave, as role and text, and the state behind them."""
    out = []
    for edit in edits:
        if edit == "D":
            continue
        made = (NAMES[TURN[state]], "") if edit == "I" else (role if edit == "K" else NAMES[TURN[state]], text)
        state = NEXT[made[0][0]][state]
        out.append(made)
    return out, state


def repaired(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired rows, ``conv_id, turn, role, text, pos, step, edit``: inserted ones have the turn of the row beside them."""

    def made(found):
        for row in found:
            kept = [e for e in row["edits"] if e != "D"]
            turns, _ = turns_after(row["state"], row["edits"], row["role"], row["text"])
            for step, (edit, (role, text)) in enumerate(zip(kept, turns)):
                yield {"conv_id": row["conv_id"], "turn": row["turn"], "role": role, "text": text, "pos": row["pos"], "step": step, "edit": edit}

    both = placed.join(edits.select("pos", "state", "edits"), "pos")
    return _mapped(both, made, _typed(placed, "conv_id {id}, turn long, role string, text string, pos long, step int, edit string"))


def audits(edits: DataFrame) -> DataFrame:
    """``conv_id, audit``: the initials of all edits of a conversation, in order. One value of a row, so one task puts it together."""
    packed = edits.groupBy("conv_id", F.shiftright("pos", FAN).alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "edits"))), lambda x: x["edits"]), "").alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("node", "part")))
    return packed.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("audit"))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the ``role:text`` lines of each conversation.

    A hash goes through its bytes in order, so a conversation goes through one task; it is streamed, not held.
    """

    def run(found):
        current = None
        for row in found:
            if current is None or row["conv_id"] != current[0]:
                if current:
                    yield {"conv_id": current[0], "repaired_sha256": current[1].hexdigest()}
                current = (row["conv_id"], hashlib.sha256())
            else:
                current[1].update(b"\n")
            current[1].update(f"{row['role']}:{row['text']}".encode())
        if current:
            yield {"conv_id": current[0], "repaired_sha256": current[1].hexdigest()}

    lines = turns.select("conv_id", "pos", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")
    return _mapped(lines, run, _typed(turns, "conv_id {id}, repaired_sha256 string"))
