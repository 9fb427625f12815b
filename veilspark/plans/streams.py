"""Streaming queries: each runs a stream to its end and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import stats
from veilspark.plans.governance import _lock, _streak
from veilspark.plans.masking import SHAPE
from veilspark.plans.registry import query
from veilspark.sources.tables import shared_folder, table
from veilspark.streaming import events as E
from veilspark.streaming import lines as L

# one reply per message: the text on one line, between two placeholders
_FLAT = "replace(replace(text, chr(10), ' '), chr(13), ' ')"
_SESSION = "concat('sess_', cast(conv_id as string), '_', cast(turn as string))"
_HOLDER = ("concat('[PII_PHONE_', translate(cast(conv_id * 100 + turn as string), '0123456789', "
           "'ABCDEFGHIJ'), ']')")
_VALUE = "cast(13000000000 + conv_id * 1000 + turn as string)"
_REPLY = f"concat('to ', {{0}}, ' ', {_FLAT}, ' ', {{0}}, '.')"


def _data(after: str) -> str:
    """The whole text as data lines, one per line of it."""
    return f"concat('data: ', replace(text, chr(10), concat({after}, 'data: ')))"


_LINES = _data("chr(10)")
_LINE_COUNT = "(length(text) - length(replace(text, chr(10), '')) + 1)"


def _vault(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn as id", f"{_SESSION} as session_id", f"{_HOLDER} as placeholder",
        f"{_VALUE} as real_value",
    )


def _stored(df, spark, name):
    """Write derived input once, so that it can be read as a stream."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return E.read_stream(spark, path, df.schema)


def _whole_lines(spark, sf_dir):
    """Whole texts as pieces of several lines in which no placeholder is cut."""
    return table(spark, sf_dir, "conversations").selectExpr(
        f"{_SESSION} as session_id", "0L as seq",
        f"concat('event: x', chr(10), {_LINES}, chr(10), ': note', chr(10), 'data: ', {_HOLDER}, "
        f"' end', chr(10), 'plain ', {_HOLDER}, chr(10), chr(10), 'data: [DONE]') as piece",
    )


def _cut_chunks(spark, sf_dir, width: int = 16):
    """Replies framed as messages of a few characters, which cut placeholders in two."""
    reply = _REPLY.format(_HOLDER)
    chunks = (
        f"transform(sequence(0, (length(reply) - 1) div {width}), i -> "
        f"concat('data: ', substr(reply, i * {width} + 1, {width})))"
    )
    return table(spark, sf_dir, "conversations").selectExpr(
        f"{_SESSION} as session_id", f"{reply} as reply"
    ).selectExpr(
        "session_id", f"posexplode(concat({chunks}, array('data: [DONE]'))) as (seq, piece)"
    ).selectExpr("session_id", "cast(seq as bigint) as seq", "piece", "timestamp '2024-01-01 00:00:00' as ts")


@query(
    "stream_parse",
    f"select {_SESSION} as session_id, e.event, cast(case when event = 'message' then 1 + {_LINE_COUNT} else 1 end "
    "as bigint) as n from conversations, (values ('message'), ('raw'), ('done')) as e(event)",
)
def stream_parse(spark, sf_dir):
    """Lines of event-stream pieces by kind."""
    pieces = _stored(_whole_lines(spark, sf_dir), spark, "pieces")
    out = E.run_to_end(L.parse_lines(pieces, ["session_id", "seq"]), spark, "stream_parse")
    return out.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_restore",
    f"select {_SESSION} as session_id, concat({_data('chr(10), chr(10)')}, chr(10), chr(10), 'data: ', {_VALUE}, "
    f"' end', chr(10), chr(10), 'plain ', {_HOLDER}, chr(10), 'data: [DONE]', chr(10), chr(10)) as sent "
    "from conversations",
)
def stream_restore(spark, sf_dir):
    """Message lines are restored and framed again, raw lines and the end pass."""
    keys = ["session_id", "seq"]
    pieces = _stored(_whole_lines(spark, sf_dir), spark, "pieces")
    vault = _vault(spark, sf_dir)
    out = E.run_to_end(
        L.parse_lines(pieces, keys), spark, "stream_restore",
        transform=lambda batch: L.restore_lines(batch, vault, keys),
    )
    return out.groupBy("session_id").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(seq, line_no, out))), x -> x.out), '')")
        .alias("sent")
    )


@query(
    "stream_restore_split",
    f"select {_SESSION} as session_id, {_REPLY.format(_VALUE)} as restored from conversations",
)
def stream_restore_split(spark, sf_dir):
    """Placeholders cut in two by the framing are restored as well."""
    chunks = _stored(_cut_chunks(spark, sf_dir), spark, "chunks")
    messages = L.reassemble(L.parse_lines(chunks, ["session_id", "seq", "ts"])).filter("event = 'message'")
    vault = _vault(spark, sf_dir)
    out = E.run_to_end(
        messages, spark, "stream_restore_split",
        transform=lambda batch: L.restore_messages(batch, vault, ["session_id", "idx"]),
    )
    return out.groupBy("session_id").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(idx, part, text))), x -> x.text), '')")
        .alias("restored")
    )


@query(
    "stream_done_summary",
    f"select {_SESSION} as session_id, concat({_data('chr(10), chr(10)')}, chr(10), chr(10), 'data: ', {_HOLDER}, "
    f"' end', chr(10), chr(10), 'plain ', {_HOLDER}, chr(10), 'event: masked', chr(10), "
    f"'data: {{\"count\":1,\"types\":[\"phone\"],\"session_id\":\"', {_SESSION}, '\"}}', chr(10), chr(10), "
    "'data: [DONE]', chr(10), chr(10)) as sent from conversations",
)
def stream_done_summary(spark, sf_dir):
    """Right before the end of a reply the client is told what was masked."""
    keys = ["session_id", "seq"]
    pieces = _stored(_whole_lines(spark, sf_dir), spark, "pieces")
    counts = _vault(spark, sf_dir).groupBy("session_id").agg(
        F.map_from_arrays(F.array(F.lit("phone")), F.array(F.count(F.lit(1)))).alias("stats")
    )
    total, types = stats.transparency("stats")
    told = counts.selectExpr("session_id", f"{total} as total", f"split({types}, ',') as types")
    out = E.run_to_end(
        L.parse_lines(pieces, keys), spark, "stream_done_summary",
        transform=lambda batch: L.with_summary(batch, told, keys),
    )
    return out.groupBy("session_id").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(seq, line_no, part, out))), x -> x.out), '')")
        .alias("sent")
    )


@query(
    "stream_flush",
    f"select {_SESSION} as session_id, concat({_LINES}, chr(10), 'data: ', {_HOLDER}, ' end', "
    f"chr(10), 'plain ', {_HOLDER}, chr(10), 'data: [DONE]') as text from conversations",
)
def stream_flush(spark, sf_dir):
    """All lines of a reply joined again."""
    pieces = _stored(_whole_lines(spark, sf_dir), spark, "pieces")
    out = E.run_to_end(L.parse_lines(pieces, ["session_id", "seq"]), spark, "stream_flush")
    return L.flush_text(out)


@query(
    "stream_mask",
    "select conv_id, turn, concat(text, ' 手机[PHONE]') as masked_shape from conversations",
)
def stream_mask(spark, sf_dir):
    """Messages masked as they arrive."""
    chat = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", f"concat(text, ' 手机', {_VALUE}) as text"
    )
    masked = E.mask_stream(_stored(chat, spark, "chat"), "text", message_no="turn")
    out = E.run_to_end(masked, spark, "stream_mask")
    return out.selectExpr("conv_id", "turn", f"{SHAPE.format('masked')} as masked_shape")


def _events(spark, sf_dir):
    """The event table as a stream."""
    stored = table(spark, sf_dir, "events")
    return E.read_stream(spark, f"{sf_dir}/events.parquet", stored.schema).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


@query(
    "stream_rate_limit",
    "select user_id, cast(date_trunc('minute', ts) as varchar) as minute, count(*) as n, "
    "count(*) > 1 as limited from events group by 1, 2",
)
def stream_rate_limit(spark, sf_dir):
    """Requests per client and minute, flagged beyond the limit."""
    counts = E.rate_counts(_events(spark, sf_dir), "user_id")
    out = E.run_to_end(counts, spark, "stream_rate_limit", "update")
    last = E.latest_update(out, ["user_id", "minute"])
    return last.selectExpr("user_id", "cast(minute as string) as minute", "n", "n > 1 as limited")


@query(
    "stream_live_counts",
    "select event_type, cast(date_trunc('hour', ts) as varchar) as start, count(*) as n "
    "from events group by 1, 2",
)
def stream_live_counts(spark, sf_dir):
    """Events per type and hour."""
    counts = E.live_counts(_events(spark, sf_dir), "event_type")
    out = E.run_to_end(counts, spark, "stream_live_counts", "update")
    last = E.latest_update(out, ["event_type", "start"])
    return last.selectExpr("event_type", "cast(start as string) as start", "n")


def _outcomes(spark, sf_dir):
    return _events(spark, sf_dir).filter("event_type in ('error', 'signup')").selectExpr(
        "event_id as id", "cast(user_id as string) as node", "ts", "event_type = 'error' as failed"
    )


@query("stream_health", _streak + "select node, id, cast(streak as bigint) as streak, "
       "streak < 3 as healthy from k")
def stream_health(spark, sf_dir):
    """Failures in a row, live; three make a node unhealthy."""
    out = E.run_to_end(E.streaks(_outcomes(spark, sf_dir)), spark, "stream_health")
    return E.health(out).select("node", "id", "streak", "healthy")


@query("stream_lockout", _streak + f"select node, id, {_lock} from k where failed")
def stream_lockout(spark, sf_dir):
    """Login lockout, live."""
    out = E.run_to_end(E.streaks(_outcomes(spark, sf_dir)), spark, "stream_lockout")
    return E.lockout(out.filter("streak > 0")).selectExpr(
        "node", "id", "cast(remaining as bigint) as remaining",
        "cast(date_trunc('second', locked_until) as string) as locked_until",
    )


@query(
    "stream_audit_feed",
    "select 'all' as sink, count(*) as n from events union all "
    "select 'copy' as sink, count(*) as n from events",
)
def stream_audit_feed(spark, sf_dir):
    """The audit event feed written to several sinks."""
    folders = {name: shared_folder(spark, name) for name in ("all", "copy")}
    feed = _events(spark, sf_dir).selectExpr("event_id as id", "user_id", "event_type as action", "ts")
    E.fan_out(feed, folders, shared_folder(spark, "checkpoint")).awaitTermination()
    parts = [
        spark.read.parquet(p).agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n"))
        for name, p in folders.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stream_expired_sessions",
    "with s as (select concat('sess_', user_id) as session_id, epoch_us(ts) // 1000 as ms from events), "
    "g as (select session_id, ms, lead(ms) over (partition by session_id order by ms) as next, "
    "max(ms) over () - 60000 as mark from s) "
    "select session_id, ms as last_seen_ms from g where next - ms > 3600000 or (next is null and mark > ms + 3600000)",
)
def stream_expired_sessions(spark, sf_dir):
    """Sessions whose mappings outlived their time to live, as the stream moves on."""
    seen = _events(spark, sf_dir).selectExpr("concat('sess_', user_id) as session_id", "ts")
    return E.run_to_end(E.expired_sessions(seen, 3600), spark, "stream_expired").select(
        "session_id", "last_seen_ms"
    )
