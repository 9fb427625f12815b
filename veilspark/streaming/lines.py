"""Event-stream replies: parse lines, restore them, carry cut placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import PLACEHOLDER, lit
from veilspark.operators.restore import Lookup, looked_up, restore_from_vault

_EVENT = """case
    when line = 'data: [DONE]' then 'done'
    when startswith(line, 'data: ') then 'message'
    when startswith(line, 'event: ') or startswith(line, ':') or line = '' then null
    else 'raw' end"""


def parse_lines(pieces: DataFrame, keys: list[str], piece: str = "piece") -> DataFrame:
    """One row per line that carries something: keys, line_no, event, data, raw.

    Works on batches and on streams, as each piece stands for itself.
    """
    return (
        pieces.select(*keys, F.posexplode(F.split(piece, "\n")).alias("line_no", "line"))
        .withColumn("event", F.expr(_EVENT))
        .filter("event is not null")
        .selectExpr(
            *keys, "line_no", "event",
            "if(event in ('message', 'done'), substr(line, 7), line) as data", "line as raw",
        )
    )


def framed(event: str, data: str, raw: str) -> str:
    """A line as it is sent on: messages framed again, raw lines unchanged."""
    return (
        f"case {event} when 'raw' then concat({raw}, '\\n') "
        f"else concat('data: ', {data}, '\\n\\n') end"
    )


def restore_lines(parsed: DataFrame, vault: DataFrame | Lookup, keys: list[str]) -> DataFrame:
    """Restore the message lines of a batch of parsed lines; ``vault`` as in ``restore_from_vault``."""
    back = restore_from_vault(parsed, vault, [*keys, "line_no"], "data", out="restored")
    return back.withColumn(
        "out", F.expr(framed("event", "if(event = 'message', restored, data)", "raw"))
    )


def flush_text(parsed: DataFrame, session: str = "session_id", order: list[str] = ("seq", "line_no")) -> DataFrame:
    """The raw lines of one reply joined again."""
    return parsed.groupBy(session).agg(
        F.expr(
            f"array_join(transform(sort_array(collect_list(struct({', '.join(order)}, raw))), "
            "x -> x.raw), '\\n')"
        ).alias("text")
    )


# -- placeholders cut in two by the framing ---------------------------------

_STATE = "idx long, tail string, done boolean"
_OUT = "session_id string, idx long, event string, data string"
#: How long after its last line a reply without an end counts as over.
QUIET = "10 minutes"


def _held_back(text: str) -> int:
    """Where an unfinished placeholder may begin at the end of a text, else its length.

    Only a ``[`` followed by nothing but placeholder characters can still become
    one, so the carried tail is bounded by the longest run of those.
    """
    i = text.rfind("[")
    if i < 0 or "]" in text[i:]:
        return len(text)
    rest = text[i + 1:]
    head = "PII_"
    fits = head.startswith(rest) or (
        rest.startswith(head) and all(c == "_" or c.isalnum() for c in rest)
    )
    return i if fits else len(text)


def _join_pieces(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        idx, tail, _ = state.get
        state.remove()
        if tail:
            yield pd.DataFrame({"session_id": [key[0]], "idx": [idx], "event": ["message"], "data": [tail]})
        return
    idx, tail, done = state.get if state.exists else (0, "", False)
    rows = pd.concat(list(frames)).sort_values(["seq", "line_no"])
    until = int(rows["until_ms"].max())
    if done:
        rows = rows.iloc[:0]
    ends = rows.loc[rows["event"] == "done", "seq"]
    if len(ends):  # lines after the end count only inside its own piece
        rows = rows[rows["seq"] <= ends.iloc[0]]
    # messages in a row become one, so the loop is over runs and not over lines
    message = rows["event"] == "message"
    runs = rows.assign(run=(~message | (message != message.shift())).cumsum()).groupby("run", sort=True).agg(
        event=("event", "first"), data=("data", "".join))
    events, texts = [], []
    for event, data in zip(runs["event"], runs["data"]):
        if event == "message":
            data = tail + data
            cut = _held_back(data) if not done else len(data)
            data, tail = data[:cut], data[cut:]
        elif event == "done":
            done = True
            if tail:
                events.append("message")
                texts.append(tail)
                tail = ""
        events.append(event)
        texts.append(data)
    if done:
        tail = ""
    state.update((idx + len(events), tail, done))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"session_id": key[0], "idx": range(idx, idx + len(events)), "event": events, "data": texts})


def reassemble(parsed: DataFrame, ts: str = "ts", quiet: str = QUIET, late: str = "1 minute") -> DataFrame:
    """Messages of a stream re-cut so that no placeholder is split.

    State per reply: the next message number, the text held back and whether the
    reply has ended; input after the end is not consumed.  Once no line has come
    for the quiet time, by event time, what is held back is sent and the state removed.
    """
    return (
        parsed.withWatermark(ts, late)
        .withColumn("until_ms", F.unix_millis(F.col(ts) + F.expr(f"interval {quiet}")))
        .groupBy("session_id")
        .applyInPandasWithState(_join_pieces, _OUT, _STATE, "append", "EventTimeTimeout")
    )


def with_summary(parsed: DataFrame, stats_by_session: DataFrame, keys: list[str]) -> DataFrame:
    """Lines as they are sent on, with a summary right before the end: how much was masked, and which types.

    Columns: keys, line_no, part (0 for the summary, 1 for the line), out.
    """
    told = stats_by_session.selectExpr(
        "session_id",
        "concat('event: masked\\ndata: ', to_json(named_struct('count', total, 'types', types, "
        "'session_id', session_id)), '\\n\\n') as summary")
    line = framed("event", "data", "raw")
    return parsed.join(told, "session_id", "left").selectExpr(
        *keys, "line_no",
        f"""posexplode(if(event = 'done' and summary is not null, array(summary, {line}), array('', {line}))) as (part, out)"""
    ).filter("out <> ''")


def cut_at_placeholders(messages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per placeholder of a message, with the text before it.

    Rows of this form can be restored by a stream-static join on (session,
    placeholder) without putting messages together again.
    """
    p = lit(PLACEHOLDER)
    return messages.select(
        *keys,
        F.expr(f"""posexplode(zip_with(
            split(data, {p}, -1), regexp_extract_all(data, {p}, 0),
            (g, t) -> named_struct('before', g, 'placeholder', t)))""").alias("part", "x"),
    ).select(*keys, "part", "x.before", "x.placeholder")


def restore_messages(messages: DataFrame, vault: DataFrame | Lookup, keys: list[str]) -> DataFrame:
    """Restore a batch of messages against the stored mappings, part by part.

    Only the mappings that the batch asks for are read together.  ``vault`` may
    be a function, as in ``restore_from_vault``.
    """
    on = ["session_id", "placeholder"]
    parts = cut_at_placeholders(messages, keys)
    return parts.join(looked_up(vault, parts, on), on, "left").withColumn(
        "text", F.expr("concat(before, coalesce(real_value, placeholder, ''))")
    ).select(*keys, "part", "text")
