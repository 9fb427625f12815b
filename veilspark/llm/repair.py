"""Cheapest repair of conversation structure by a square-root checkpointed dynamic programme.

A repaired conversation has the roles ``(system? (user assistant)+)?``.  Costs of
the rest of a conversation are vectors over four states: nothing yet, after a
system turn, after a user turn, after an assistant turn.  Vectors are computed
backwards and kept at checkpoints only; the walk forward recomputes the stretch
between two checkpoints and takes the least edit that is still cheapest.

A conversation is cut into blocks of turns.  The effect of a block is a 4 x 4
matrix of costs, so blocks are handled in parallel however long a conversation
is: matrices give the vectors at the ends of blocks, which are the outer
checkpoints, and each block is walked from every state it may be entered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import staged

#: Positions of a block; rows of one conversation inside it are walked together.
BLOCK_BITS = 14
#: Costs of the edits, and of keeping a truncated turn.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.  Next state by an added or renamed turn.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: What it costs to end in each state.
FINAL = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 50
#: Bits of a turn's code beside its initial (0 system, 1 user, 2 assistant, 3 other).
TRUNCATED, REPEATED, BLANK = 4, 8, 16

_BLANKS = r"' \t\n\u000B\u000C\r'"


def before(v: tuple[int, ...], code: int, times: int) -> tuple[int, ...]:
    """The cost vector in front of ``times`` equal turns from the one behind them."""
    if code & (REPEATED | BLANK):
        return tuple(x + DELETE * times for x in v)
    more = DELETE * (times - 1)
    v0, v1, v2, v3 = (x + more for x in v)
    cut = CUT if code & TRUNCATED else 0
    initial = code & 3
    to_user = v2 + cut + (0 if initial == 1 else REROLE)
    b0 = min(v0 + DELETE, to_user, v1 + cut) if initial == 0 else min(v0 + DELETE, to_user)
    b1 = min(v1 + DELETE, to_user)
    b2 = min(v2 + DELETE, v3 + cut + (0 if initial == 2 else REROLE))
    b3 = min(v3 + DELETE, to_user)
    b2, b3 = min(b2, b3 + INSERT), min(b3, b2 + INSERT)
    return min(b0, b2 + INSERT), min(b1, b2 + INSERT), b2, b3


def matrix(codes: list[int], times: list[int]) -> list[int]:
    """Cost from each state before the turns to each state behind them, row by row."""
    columns = []
    for end in range(4):
        v = tuple(0 if q == end else NEVER for q in range(4))
        for i in range(len(codes) - 1, -1, -1):
            v = before(v, codes[i], times[i])
        columns.append(v)
    return [columns[e][q] for q in range(4) for e in range(4)]


def kept(state: int, initial: int) -> int | None:
    """The state after keeping a turn, if it may be kept."""
    if initial == 1 and state != 2:
        return 2
    if initial == 2 and state == 2:
        return 3
    return 1 if initial == 0 and state == 0 else None


def walk(codes: list[int], times: list[int], end: tuple[int, ...], state: int) -> list[str]:
    """The least of the cheapest edits, one string per turn, inserts in front of it included."""
    n = len(codes)
    step = max(1, isqrt(n))
    checkpoints, v = {n: end}, end
    for i in range(n - 1, -1, -1):
        v = before(v, codes[i], times[i])
        if i % step == 0:
            checkpoints[i] = v
    out = []
    for start in range(0, n, step):
        stop = min(n, start + step)
        vectors = [checkpoints[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(before(vectors[-1], codes[i], times[i]))
        vectors.reverse()
        for i in range(start, stop):
            here, there, code = vectors[i - start], vectors[i - start + 1], codes[i]
            if code & (REPEATED | BLANK):
                out.append("D")
                continue
            more = DELETE * (times[i] - 1)
            cut = CUT if code & TRUNCATED else 0
            edits = ""
            while True:
                if here[state] == DELETE + more + there[state]:
                    edits += "D"
                    break
                if here[state] == INSERT + here[NEXT[state]]:
                    edits, state = edits + "I", NEXT[state]
                    continue
                to = kept(state, code & 3)
                if to is not None and here[state] == cut + more + there[to]:
                    edits, state = edits + "K", to
                else:
                    edits, state = edits + "R", NEXT[state]
                break
            out.append(edits)
    return out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): planted faults, chosen by crc32 of ``conv:turn`` modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 removes ``.!?``, 3 repeats
    it, 4 makes it a user's.  Null roles and texts, and nulls in the key, are a blank.
    """
    key = f"coalesce(cast({conv} as string), ' '), ':', coalesce(cast({turn} as string), ' ')"
    return rows.select(conv, turn, role, text).withColumn("__k", F.expr(f"crc32(cast(concat({key}) as binary)) % 20")).selectExpr(
        f"{conv} as conv", f"cast({turn} as bigint) as turn",
        f"if(__k = 4, 'user', coalesce({role}, ' ')) as role",
        f"case __k when 1 then '' when 2 then regexp_replace(coalesce({text}, ' '), '[.!?]', '') else coalesce({text}, ' ') end as text",
        "case __k when 0 then 0L when 3 then 2L else 1L end as copies")


def _ordered(rows: DataFrame) -> DataFrame:
    """All turns in order, equal ones once with their number, each with a position that grows along.

    Rows are dealt out by ranges of (conversation, turn, role, beginning of the
    text), so a long conversation lies on many tasks.
    """
    trimmed = f"trim(trailing {_BLANKS} from text)"
    alike = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumns({
        "__role": F.expr("substr(role, 1, 32)"), "__text": F.expr("substr(text, 1, 64)")})
    dealt = alike.repartitionByRange("conv", "turn", "__role", "__text").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("__end", F.expr(f"right({trimmed}, 1)")).selectExpr(
        "conv", "turn", "role", "text", "n", "at",
        "sha2(concat(length(role), ':', role, text), 256) as h",
        f"""cast(case substr(role, 1, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end
            + case when __end = '' then {BLANK} when __end in ('.', '!', '?') then 0 else {TRUNCATED} end as int) as code""")


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, first, codes, times, costs) per block: its position, its turns and its matrix."""
    thin = turns.where("n > 0").select("conv", "at", "n", "h", "code")
    first = thin.groupBy("conv", "h").agg(F.min("at").alias("at")).selectExpr("at", "true as new")
    marked = thin.join(first, "at", "left").selectExpr(
        "conv", "at", "n", f"if(new or code >= {BLANK}, code, code | {REPEATED}) as code")
    grouped = marked.groupBy("conv", F.expr(f"shiftright(at, {BLOCK_BITS})").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code", "n"))).alias("t")).selectExpr(
        "conv", "t[0].at as first", "t.code as codes", "t.n as times")
    schema = T.StructType(grouped.schema.fields + [T.StructField("costs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [matrix(c, t) for c, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64()))], names=schema.names)

    return grouped.mapInArrow(run, schema)


def _ends(blocks: DataFrame) -> DataFrame:
    """(first, end, cost, opens): the vector behind each block, the cost from its start, whether it opens a conversation.

    One small row per block goes through the task of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, v = None, None, FINAL
        for b in batches:
            out = []
            for conv, first, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held is None or conv != now:
                    out += [(*held, True)] if held else []
                    now, v = conv, FINAL
                else:
                    out.append((*held, False))
                end, v = v, tuple(min(m[4 * q + e] + v[e] for e in range(4)) for q in range(4))
                held = first, list(end), v[0]
            if out:
                yield _batch(out, types, names)
        if held:
            yield _batch([(*held, True)], types, names)

    names, types = ["first", "end", "cost", "opens"], [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
    return blocks.select("conv", "first", "costs").repartition("conv").sortWithinPartitions(
        "conv", F.desc("first")).mapInArrow(run, "first long, end array<long>, cost long, opens boolean")


def _walked(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv, at, codes, edits, cost): the edits of each block for every state it may be entered with."""
    joined = blocks.drop("costs").join(ends, "first").select("conv", "first", "codes", "times", "end", "cost", "opens")
    kind = blocks.schema["conv"].dataType
    schema = T.StructType([
        T.StructField("conv", kind), T.StructField("at", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("edits", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("cost", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for at in range(b.num_rows):
                conv, first, codes, times, end, cost, opens = (c[at].as_py() for c in b.columns)
                ways = [walk(codes, times, tuple(end), q) for q in range(1 if opens else 4)]
                out.append((conv, first, codes, ways, cost))
                size += len(codes) * len(ways)
                if size >= 1 << BLOCK_BITS:
                    yield _batch(out, types(b), schema.names)
                    out, size = [], 0
            if out:
                yield _batch(out, types(b), schema.names)
                out, size = [], 0

    def types(b: pa.RecordBatch) -> list[pa.DataType]:
        return [b.schema.field(0).type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string())), pa.int64()]

    return joined.mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Edits and repaired turns in order: (conv, turn, was, edit, times, role, text, fault, cost).

    ``rows`` are (conv, turn, role, text, copies).  ``edit`` is K keep, R rerole,
    D delete or I insert; ``was`` is the role before it, ``role`` and ``text`` those
    after it (null for D).  ``times`` counts equal turns deleted together.
    ``fault`` is the first of blank, duplicate (role and text seen before),
    truncated (no ``.!?`` at its end).  ``cost`` stands on the first row of a conversation.

    Blank and duplicate turns are deleted (2); rerole to user or assistant costs
    1, delete 2, insert 5, a truncated turn that stays 5.  Of the cheapest edits those
    whose letters are least in ASCII are taken.  Turns order by number (null first),
    then role and text.  A null role or text is a blank; rows with a null
    conversation form one.  A conversation without copies gives one row with
    null edit.  Rows come out sorted inside their partition, conversations whole:
    the text of one conversation passes one task turn by turn, never held.
    """
    rows = rows.selectExpr("conv", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "copies")
    turns = staged(_ordered(rows), "turns")
    blocks = staged(_blocks(turns), "blocks")
    plans = _walked(blocks, _ends(blocks))
    kind = turns.schema["conv"].dataType
    both = turns.selectExpr("conv", "at", "1 as kind", "turn", "role", "text", "n").unionByName(
        plans.withColumn("kind", F.lit(0)), allowMissingColumns=True).select(
        "conv", "at", "kind", "turn", "role", "text", "n", "codes", "edits", "cost")
    schema = T.StructType([
        T.StructField("conv", kind), T.StructField("turn", T.LongType()), T.StructField("was", T.StringType()),
        T.StructField("edit", T.StringType()), T.StructField("times", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("cost", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        now, started, begun, state, seen = None, False, False, 0, 0
        codes: list[int] = []
        edits: list[str] = []

        def close(out: list[tuple]) -> None:
            """Turns that the last state lacks, or the only row of a conversation without turns."""
            at = state
            while FINAL[at]:
                at = NEXT[at]
                out.append((now, None, None, "I", 1, ROLES[at], "", None, None))
            if started and not begun:
                out.append((now, None, None, None, 0, None, None, None, 0))

        for b in batches:
            types[0] = b.schema.field(0).type
            out: list[tuple] = []
            for conv, _, mark, turn, role, text, n, its, ways, cost in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != now:
                    close(out)
                    now, started, begun, state = conv, True, False, 0
                if mark == 0:
                    codes, edits, seen, first, begun = its, ways[state], 0, None if begun else cost, True
                    continue
                if not n:
                    continue
                code, letters = codes[seen], edits[seen]
                seen += 1
                for letter in letters[:-1]:
                    state = NEXT[state]
                    out.append((conv, None, None, letter, 1, ROLES[state], "", None, first))
                    first = None
                fault = "blank" if code & BLANK else "duplicate" if code & REPEATED else "truncated" if code & TRUNCATED else None
                last, alone = letters[-1], 1
                if last == "D":
                    alone = n if code & (BLANK | REPEATED) else 1
                    out.append((conv, turn, role, "D", alone, None, None, fault, first))
                else:
                    state = NEXT[state] if last == "R" else kept(state, code & 3)
                    out.append((conv, turn, role, last, 1, ROLES[state] if last == "R" else role, text, fault, first))
                first = None
                if n > alone:
                    out.append((conv, turn, role, "D", n - alone, None, None, "duplicate", None))
            if out:
                yield _batch(out, types, schema.names)
        out = []
        close(out)
        if out:
            yield _batch(out, types, schema.names)

    return both.repartition("conv").sortWithinPartitions("conv", "at", "kind").mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def digests(done: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation the counts of its faults, the cost, the letters of the edits and a digest of the repaired turns.

    Reads ``repaired`` in the order in which it comes; no shuffle.
    """
    kind = done.schema["conv"].dataType
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField(conv, kind)] + [T.StructField(c, T.LongType()) for c in longs] + [
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    class Tally:
        def __init__(self, conv):
            self.conv, self.faults, self.illegal, self.cost = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
            self.low = self.high = self.turn = self.initial = None
            self.turns, self.audit, self.digest, self.lines = 0, [], hashlib.sha256(), 0

        def add(self, turn, was, edit, times, role, text, fault, cost):
            self.cost += cost or 0
            if edit is None:
                return
            self.audit.append(edit * times)
            if was is not None:
                if turn is not None and turn != self.turn:
                    self.low = turn if self.low is None else self.low
                    self.high = self.turn = turn
                    self.turns += 1
                if fault:
                    self.faults[fault] += times
                initial = was[:1]
                if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                    self.illegal += 1
                self.illegal += times - 1
                self.initial = initial
            if edit != "D":
                self.digest.update((("\n" if self.lines else "") + role + ":" + text).encode())
                self.lines += 1

        def row(self):
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal,
                    self.cost, "".join(self.audit), self.digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, types = None, [None] + [pa.int64()] * 6 + [pa.string()] * 2
        for b in batches:
            types[0] = b.schema.field(0).type
            out = []
            for conv, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if tally is None or tally.conv != conv:
                    if tally:
                        out.append(tally.row())
                    tally = Tally(conv)
                tally.add(*rest)
            if out:
                yield _batch(out, types, schema.names)
        if tally:
            yield _batch([tally.row()], types, schema.names)

    return done.mapInArrow(run, schema)
