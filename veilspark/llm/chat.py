"""Conversations as training text: windows under a token budget, with a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged

#: Tokens of new turns in a window, and of the turns before it that are repeated.
STRIDE, HISTORY = 768, 256
#: Turn numbers of a block; prefix sums are carried from block to block.
TURNS = 256
START, END = "<|im_start|>", "<|im_end|>"

#: One backslash more between < and |, so that no control string is left; reversible.
ESCAPE = r"regexp_replace({0}, r'<(\\*)\|', r'<$1\\|')"
UNESCAPE = r"regexp_replace({0}, r'<(\\*)\\\|', r'<$1|')"
#: Roles stand on one line.
ROLE = r"replace(replace({0}, '\\', '\\\\'), '\n', '\\n')"
UNROLE = r"replace(replace(replace({0}, '\\\\', '\\ '), '\\n', '\n'), '\\ ', '\\')"


def windows(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    stride: int = STRIDE, history: int = HISTORY,
) -> DataFrame:
    """(conv, window, formatted, loss, n_repeated, n_turns) rows.

    A turn has a quarter of its UTF-8 bytes in tokens, and four for the
    template.  The tokens of the turns before it decide its window: window w holds
    the turns that begin in [w stride, (w + 1) stride), so windows end between
    turns and exceed the stride by part of their last turn at most.  In front
    stand, repeated, a leading system turn and the turns that begin at most
    ``history`` tokens before the window.  ``loss`` lists (start, length) in code
    points of the assistant texts that are new; repeated ones are masked.

    Prefix sums work per block of turn numbers, so a conversation that holds a
    third of all rows is spread over many tasks; the text of a window is all that
    is ever put together.  Null roles and texts are empty; turns order by number,
    then role and text, a null number first; rows with a null conversation
    form one; repeated rows are turns of their own.  Other columns are ignored.
    """
    if not 0 <= history <= stride:
        raise ValueError("history must lie between 0 and the stride")
    t = rows.select(
        F.col(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("n"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.expr("4 + (octet_length(text) + 3) div 4")).withColumn("blk", F.expr(f"n div {TURNS}"))
    blocks = t.groupBy("c", "blk").agg(F.sum("tokens").alias("s")).selectExpr(
        "c as bc", "blk as bb",
        "coalesce(sum(s) over (partition by c order by blk rows between unbounded preceding and 1 preceding), 0) carried")
    t = t.withColumn("inside", F.expr(
        "coalesce(sum(tokens) over (partition by c, blk order by n, role, text"
        " rows between unbounded preceding and 1 preceding), 0)"))
    t = t.join(blocks, F.col("c").eqNullSafe(F.col("bc")) & (F.col("blk") == F.col("bb"))).selectExpr(
        "c", "role", "text", "carried + inside as at")
    t = t.withColumn("w", F.expr(f"at div {stride}")).withColumn("head", F.expr(
        f"concat('{START}', {ROLE.format('role')}, '\\n')")).withColumn("body", F.expr(ESCAPE.format("text")))
    t = staged(t.select("c", "at", "w", "role", "head", "body"), "turns")

    system = t.where("at = 0 and role = 'system'").selectExpr("c as sc", "head as shead", "body as sbody")
    turns = t.selectExpr(
        "c", f"""explode(if(at >= (w + 1) * {stride} - {history},
            array(struct(w as w, true as own), struct(w + 1 as w, false as own)), array(struct(w as w, true as own)))) x""",
        "struct(at, head, body, role) as turn").selectExpr("c", "x.w as w", "x.own as own", "turn")
    # a turn at 0 that is the system turn comes back in every later window, not as history
    turns = turns.where("own or turn.at > 0 or turn.role <> 'system'")
    grouped = turns.groupBy("c", "w").agg(
        F.array_sort(F.collect_list(F.struct("turn.at", "own", "turn.head", "turn.body", "turn.role"))).alias("turns"),
        F.sum(F.col("own").cast("int")).alias("n_own")).where("n_own > 0")
    grouped = grouped.join(system, F.col("c").eqNullSafe(F.col("sc")) & (F.col("w") > 0), "left").withColumn(
        "turns", F.expr(
            "if(shead is null, turns, concat(array(struct(-1L as at, false as own, shead as head, sbody as body,"
            " 'system' as role)), turns))"))
    masked = f"""aggregate(turns, named_struct('at', 0L, 'loss', cast(array() as array<struct<start: bigint, length: bigint>>)),
        (s, x) -> named_struct(
            'at', s.at + char_length(x.head) + char_length(x.body) + {len(END) + 1},
            'loss', if(x.own and x.role = 'assistant', concat(s.loss, array(named_struct(
                'start', s.at + char_length(x.head), 'length', cast(char_length(x.body) as bigint)))), s.loss)),
        s -> s.loss)"""
    return grouped.selectExpr(
        f"c as {conv}", "w as window",
        f"array_join(transform(turns, x -> concat(x.head, x.body, '{END}\\n')), '') as formatted",
        f"{masked} as loss", "cast(size(filter(turns, x -> not x.own)) as bigint) as n_repeated",
        "cast(size(turns) as bigint) as n_turns")


def new_turns(formatted: DataFrame) -> DataFrame:
    """Read windows back: adds ``turns``, the unescaped (role, text) of the turns that are not repeated, and ``targets``."""
    parts = f"split(formatted, '{END}\\n', -1)".replace("|", r"\\|")
    turns = f"""transform(filter(slice({parts}, cast(n_repeated as int) + 1, cast(n_turns - n_repeated as int)), x -> true),
        x -> struct({UNROLE.format(f"substring(x, {len(START) + 1}, instr(x, '\\n') - {len(START) + 1})")} as role,
                    {UNESCAPE.format("substring(x, instr(x, '\\n') + 1)")} as text))"""
    targets = f"transform(loss, s -> {UNESCAPE.format('substring(formatted, cast(s.start as int) + 1, cast(s.length as int))')})"
    return formatted.withColumn("turns", F.expr(turns)).withColumn("targets", F.expr(targets))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the windows read back: counts and running SHA-256 digests.

    Windows arrive in order and feed the digests one by one; no conversation is
    ever put together.
    """
    flat = new_turns(formatted).selectExpr(
        conv, "window", "cast(size(turns) as bigint) n", "array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '') t",
        "array_join(targets, '') l", "cast(char_length(array_join(targets, '')) as bigint) lc", "cast(char_length(formatted) as bigint) f")
    kind = formatted.schema[conv].dataType.simpleString()
    schema = f"{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for c, n, t, lt, lc, f in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                if state is None or state[0] != c:
                    if state:
                        done.append(state)
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(t.encode())
                state[3] += lc
                state[4].update(lt.encode())
                state[5] += f
            yield table(done, batch.schema.field(0).type)
            kept = batch.schema.field(0).type
        if state:
            yield table([state], kept)

    def table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows])) or [()] * 6
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return flat.repartition(conv).sortWithinPartitions(conv, "window").mapInArrow(run, schema)
