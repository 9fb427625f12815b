"""Stream parsing and re-cutting on small pieces."""

import datetime
import os
import tempfile
import time

from veilspark.streaming import events as E
from veilspark.streaming import lines as L


def test_parse_lines(spark):
    piece = "event: x\ndata: a\n\n: note\nraw line\ndata: [DONE]\ndata: late"
    df = spark.createDataFrame([("s", 0, piece)], "session_id string, seq long, piece string")
    got = [(r.event, r.data) for r in L.parse_lines(df, ["session_id", "seq"]).orderBy("line_no").collect()]
    assert got == [("message", "a"), ("raw", "raw line"), ("done", "[DONE]"), ("message", "late")]


SCHEMA = "session_id string, seq long, piece string, ts timestamp"


def _run(spark, batches):
    """One file per micro-batch of (session, seq, piece, minute); rows and the last state sizes."""
    folder = tempfile.mkdtemp()
    start = datetime.datetime(2024, 1, 1)
    for i, rows in enumerate(batches):
        full = [(s, n, p, start + datetime.timedelta(minutes=m)) for s, n, p, m in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, "in", "b=%d" % i))
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in/*")
    seen = []

    def sink(batch, number):
        seen.extend(batch.collect())

    query = L.reassemble(L.parse_lines(stream, ["session_id", "seq", "ts"])).writeStream.option(
        "checkpointLocation", folder + "/c").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    texts = {}
    for r in sorted(seen, key=lambda r: r.idx):
        if r.event == "message":
            texts.setdefault(r.session_id, []).append(r.data)
    return texts, left


def test_cut_placeholders_over_batches(spark):
    parts = ["data: tel [PII", "data: _PHONE_A", "data: B] and [x] [PII_", "data: [DONE]\ndata: z", "data: never"]
    texts, _ = _run(spark, [[("s", i, p, i), ("t", i, "data: plain %d" % i, i)] for i, p in enumerate(parts)])
    assert "".join(texts["s"]) == "tel [PII_PHONE_AB] and [x] [PII_z"
    assert any("[PII_PHONE_AB]" in t for t in texts["s"])
    assert "".join(texts["t"]) == "".join("plain %d" % i for i in range(5))


def test_reply_without_end_keeps_its_tail_and_no_state(spark):
    batches = [[("s", 0, "data: a [PII_PH", 0), ("t", 0, "data: b\ndata: [DONE]", 0)], [("late", 0, "data: c", 60)],
               [("later", 0, "data: d", 120)]]
    texts, left = _run(spark, batches)
    assert "".join(texts["s"]) == "a [PII_PH" and texts["t"] == ["b"]
    assert left[-1] == 1  # only the reply that is still young


def test_expiry_does_not_depend_on_batches(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", 0), ("b", 1), ("a", 30), ("a", 200), ("b", 202), ("c", 203), ("a", 230), ("a", 400), ("d", 600)]
    rows = [(s, start + datetime.timedelta(minutes=m)) for s, m in rows]
    got = []
    for n in (1, 5):
        folder = tempfile.mkdtemp()
        step = -(-len(rows) // n)
        for i in range(n):
            part = rows[i * step:(i + 1) * step]
            if part:
                spark.createDataFrame(part, "session_id string, ts timestamp").coalesce(1).write.parquet(
                    os.path.join(folder, "in", "b=%d" % i))
                time.sleep(0.02)
        stream = spark.readStream.schema("session_id string, ts timestamp").option("maxFilesPerTrigger", 10 if n == 1 else 1)
        out = E.run_to_end(E.expired_sessions(stream.parquet(folder + "/in/*"), 3600), spark, "t")
        got.append(sorted((r.session_id, r.last_seen_ms) for r in out.collect()))
    assert got[0] == got[1]
    base = int(rows[0][1].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert [(s, (ms - base) // 60_000) for s, ms in got[0]] == [("a", 30), ("a", 230), ("a", 400), ("b", 1), ("b", 202), ("c", 203)]


def test_held_back():
    assert L._held_back("abc [PII_PH") == 4
    assert L._held_back("abc [") == 4
    assert L._held_back("abc [x") == 6
    assert L._held_back("abc [PII_A_B]") == 13
    assert L._held_back("abc [PII_A B") == 12
