"""Operators against brute force on small fixtures."""

import hashlib
import json
import os
import random
import re
import tempfile
import time

from pyspark.sql import functions as F

from veilspark import RulePack, mask
from veilspark.functions.text import alpha_id, placeholders_in
from veilspark.operators import audit, compliance, keywords, nested, ordered, quality, requests, stats, vault
from veilspark.sources import rules, store


def test_alpha_ids(spark):
    want = {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA", 18278: "ZZZ", 18279: "AAAA"}
    df = spark.createDataFrame([(n,) for n in want], "n bigint").selectExpr("n", f"{alpha_id('n')} as a")
    assert {r.n: r.a for r in df.collect()} == want


def test_keyword_matches_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab中") for _ in range(60)) for _ in range(30)]
    words = ["a", "aa", "aba", "ab", "中a", "bb中", "aaaa"]
    want = {
        (i, w, p, p + len(w)) for i, t in enumerate(texts) for w in words
        for p in range(len(t)) if t.startswith(w, p)
    }
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    kw = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = [tuple(r) for r in keywords.keyword_matches(df, ["id"], kw).collect()]
    assert set(got) == want and len(got) == len(want)
    long = [(1, "x" * 1000 + "needle" + "y" * 250 + "needle"), (2, None), (3, "")]
    got = keywords.keyword_matches(spark.createDataFrame(long, "id int, text string"), ["id"],
                                   spark.createDataFrame([("needle",), ("",), ("y" * 250,)], "keyword string"))
    assert sorted((r.id, r.keyword[:2], r.start) for r in got.collect()) == [(1, "ne", 1000), (1, "ne", 1256), (1, "yy", 1006)]
    twice = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "xab"), (None, "ab")], "id int, text string")
    got = keywords.keyword_matches(twice, ["id"], spark.createDataFrame([("ab",), ("b",)], "keyword string"))
    assert sorted(map(str, ((r.id, r.keyword, r.start) for r in got.collect()))) == sorted(map(str, [
        (1, "ab", 0), (1, "ab", 0), (1, "ab", 1), (None, "ab", 0), (1, "b", 1), (1, "b", 1), (1, "b", 2), (None, "b", 1)]))
    none = spark.createDataFrame([], "keyword string")
    assert keywords.keyword_matches(df, ["id"], none).count() == 0
    ranked = keywords.ranked_matches(keywords.keyword_matches(df, ["id"], kw), ["id"]).first().matches
    order = [(-len(m.keyword), m.start, m.keyword) for m in ranked]
    assert order == sorted(order)


def test_masking_cost_is_near_linear(spark):
    def seconds(n):
        text = "".join("u%d@example.com, 1381234%04d; " % (i, i % 10000) for i in range(n // 2))
        df = spark.createDataFrame([(text,)], "text string")
        start = time.time()
        assert mask(df).selectExpr("size(mappings)").first()[0] == n
        return time.time() - start

    seconds(400)
    assert min(seconds(8000), seconds(8000)) < 2.5 * max(1.0, seconds(4000))


def test_one_scan_per_pattern(spark):
    df = spark.createDataFrame([("text",)], "text string")
    plan = mask(df)._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"regexp_replace\(__scan#\d+, ([^\n]*?), \ue001", plan)
    assert len(scans) > 10


def test_ordered_operators_cross_blocks(spark):
    rng = random.Random(1)
    rows = [(("hot" if i % 3 else "k%d" % (i % 7)), i, rng.random() < 0.6) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id bigint, failed boolean")
    seen, want_prev, want_streak = {}, {}, {}
    for k, i, failed in rows:
        want_prev[i] = seen.get(k, (None, 0))[0]
        streak = seen.get(k, (None, 0))[1] + 1 if failed else 0
        want_streak[i] = streak
        seen[k] = (i, streak)
    prev = ordered.previous_row(df, ["k"], "id", ["id"], block=16)
    assert {r.id: (r.prev.id if r.prev else None) for r in prev.collect()} == want_prev
    streaks = ordered.running_sum(df, ["k"], "id", "if(failed, 1L, 0L)", "s", block=16)
    total = {}
    for k, i, failed in rows:
        total[k] = total.get(k, 0) + failed
    assert {r.k: r.s for r in streaks.groupBy("k").agg(F.max("s").alias("s")).collect()} == total
    got = ordered.failure_streaks(df, ["k"], "id")
    assert {r.id: r.streak for r in got.collect()} == want_streak


def test_chain_equals_python(spark):
    rows = [(i * 3, "s%d" % (i % 3), "act", None if i % 4 else '{"a":1}', "2024-01-01 00:00:%02d" % i)
            for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, session_id string, action string, detail_json string, created_at string")

    def sha(*parts):
        return hashlib.sha256("|".join(parts).encode()).hexdigest()

    want, closes, segment, inner = {}, [], None, None
    for i, s, a, d, c in rows:
        if i // 10 != segment:
            segment, first = i // 10, True
            if inner:
                closes.append(inner)
            inner = None
        else:
            first = False
        want[i] = (sha(closes[-2] if len(closes) > 1 else "", closes[-1]) if closes else None) if first else inner
        inner = sha(inner or "", s, a, d or "", c)
    chain = audit.build_chain(df, 10)
    assert {r.id: r.prev_hash for r in chain.collect()} == want
    assert [i for i, h in want.items() if h is None] == [0]
    assert audit.chain_report(audit.verify_chain(chain)).filter("not intact").count() == 0
    ledger = audit.segment_ledger(chain)
    assert audit.verify_ledger(chain, ledger).filter("problem is not null").count() == 0
    for changed in (0, 27, 30, 57, 84):  # at and between the ends of segments
        bad = chain.withColumn("detail_json", F.expr(f"if(id = {changed}, 'x', detail_json)")) if changed % 2 else \
            chain.withColumn("session_id", F.expr(f"if(id = {changed}, 'x', session_id)"))
        broken = [r.id for r in audit.verify_chain(bad).filter("broken").collect()]
        # the last row of a segment counts in the links of two segments
        assert broken == ([changed + 3, changed + 15] if changed in (27, 57) else [changed + 3])
    lost = audit.verify_ledger(chain.filter("segment <> 4 and id <> 87"), ledger).filter("problem is not null")
    assert {r.segment: r.problem for r in lost.collect()} == {
        4: "dropped", 5: "follows another segment", 8: "rows lost or added"}


def test_chain_is_linear(spark):
    """A row costs the same in long segments as in short ones."""
    df = spark.range(20_000).selectExpr(
        "id", "concat('s', id % 7) as session_id", "'act' as action", "repeat('x', 100) as detail_json", "'now' as created_at")
    best = {}
    for _ in range(3):
        for size in (250, 4_000):
            start = time.time()
            audit.build_chain(df.coalesce(1), size).write.format("noop").mode("overwrite").save()
            best[size] = min(best.get(size, 1e9), time.time() - start)
    assert best[4_000] <= 1.2 * best[250] + 0.3, best


def test_exact_quantiles(spark):
    """More distinct latencies than the sketch can tell apart, ties, nulls and tiny endpoints."""
    rng = random.Random(4)
    rows = [("many", rng.random() ** 3) for _ in range(40_000)] + [("ties", float(i % 7)) for i in range(1_000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "endpoint string, latency double")
    got = {r.endpoint: (r.n, r.p50, r.p95, r.p99) for r in requests.latency_histogram(df).collect()}
    for endpoint in {e for e, _ in rows}:
        values = sorted(v for e, v in rows if e == endpoint and v is not None)
        n = len(values)
        want = tuple(values[max(1, n - int(n - q / 100 * n)) - 1] if n else None for q in (50, 95, 99))
        assert got[endpoint] == (sum(e == endpoint for e, _ in rows), *want)


def test_counters_in_one_exchange(spark):
    rows = [("d", "t", {"org": 1, "organization": 2, "phone": 0, "odd": 5}), ("d", None, {"odd": 9}), ("d", "t", {"phone": 3, "email": -1}),
            ("e", None, {"ip": 2}), ("d", "t", {}), ("d", "t", None)]
    df_schema = "date string, team_id string, stats map<string,bigint>"
    df = stats.counters(spark.createDataFrame(rows, df_schema))
    assert sorted(map(tuple, df.collect())) == [
        ("d", "t", "org", 3), ("d", "t", "phone", 3), ("d", "t", "total", 10), ("e", "default", "ip", 2), ("e", "default", "total", 2)]
    plan = stats.counters(spark.createDataFrame(rows, df_schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_crypto(spark):
    df = spark.createDataFrame([("abc",), ("",), ("中文",)], "real_value string")
    enc = vault.encrypt_values(df, "k" * 32)
    spelled = vault.decrypt_values(enc, "k" * 32)._jdf.queryExecution().toString()
    assert "k" * 32 not in spelled and ("k" * 32).encode().hex() not in spelled.lower()
    sizes = enc.selectExpr("octet_length(unbase64(real_value)) as n").collect()
    assert sorted(r.n for r in sizes) == [28, 31, 34]
    assert sorted(r[0] for r in vault.decrypt_values(enc, "k" * 32).collect()) == sorted(["abc", "", "中文"])
    assert vault.vault_key("short") == hashlib.sha256(b"short").digest()
    junk = spark.createDataFrame([("!!!",), ("QUJD",), ("plain",)], "real_value string")
    assert sorted(r[0] for r in vault.decrypt_values(junk, "x").collect()) == ["!!!", "QUJD", "plain"]


def test_json_masking_keeps_everything_else(spark):
    docs = [
        {"a": "call 13812345678", "b": [1, 2.5, True, None, "x@y.com \"q\" \\ \n é"], "13812345678": {"k:": "v"}},
        [], {"n": 1}, ["13900000000", ["13900000001"]],
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string")
    rows = {r.id: r for r in nested.mask_json(df, ["id"], "j").collect()}
    for i, d in enumerate(docs):
        text = rows[i].masked
        for m in rows[i].mappings:
            text = text.replace(m.placeholder, m.value)
        assert json.loads(text) == d
        assert json.loads(rows[i].masked) is not None
    assert [len(rows[i].mappings) for i in range(4)] == [2, 0, 0, 2]
    assert '"13812345678": {' in rows[0].masked


def test_chat_forms(spark):
    body = {"model": "m", "stream": True, "messages": [
        {"role": "user", "content": "hi 13812345678"},
        {"role": "user", "content": [{"type": "text", "text": "ip 1.2.3.4"}, {"type": "image", "url": "13900000000"}]},
        {"role": "system", "content": "[not a list]"}]}
    df = spark.createDataFrame([(1, json.dumps(body))], "id int, body string")
    row = nested.mask_chat(df, ["id"]).first()
    out = json.loads(row.masked_body)
    assert out["messages"][1]["content"][1] == {"type": "image", "url": "13900000000"}
    assert out["messages"][2]["content"] == "[not a list]"
    assert row.stats == {"phone": 1, "ip": 1} and len(row.used) == 2
    assert out["messages"][0]["content"].startswith("hi [PII_PHONE_")


def plain_parts(body):
    """(message, block, text) of a request as the standard parser reads it."""
    try:
        parsed = json.loads(body)
    except (TypeError, ValueError):
        return []
    out = []
    messages = parsed.get("messages") if isinstance(parsed, dict) else None
    for i, message in enumerate(messages if isinstance(messages, list) else []):
        content = message.get("content") if isinstance(message, dict) else None
        if isinstance(content, str):
            out.append((i, 0, content))
        for k, block in enumerate(content if isinstance(content, list) else []):
            if isinstance(block, dict) and block.get("type") == "text" and isinstance(block.get("text"), str):
                out.append((i, k, block["text"]))
    return [(i, k, re.sub("[\ud800-\udfff]", "?", t)) for i, k, t in out]


def test_chat_bodies_of_chance(spark):
    """Raw bodies put together at random, many of them broken, against the standard parser."""
    rng = random.Random(11)

    def value(depth):
        kind = rng.randrange(9 if depth < 5 else 5)
        if kind < 3:
            return rng.choice(['"text"', '"a@b.com"', r'"\ud800 x"', r'"q\"\\ \u00e9"', '"é,]}"', '"user"'])
        if kind < 5:
            return rng.choice(["1", "-0.5e3", "true", "null", "NaN", "01", "tru", "'x'", '"open'][: 5 if rng.random() < .97 else 9])
        pad = rng.choice(["", " ", "\n\t"])
        if kind < 7:
            return "[" + f"{pad},".join(value(depth + 1) for _ in range(rng.randrange(4))) + ("," if rng.random() < .02 else "") + "]"
        keys = ["messages", "content", "role", "type", "text", r"me\u0073sages", "x"]
        return "{" + ",".join(f'{pad}"{rng.choice(keys)}"{pad}:{pad}{value(depth + 1)}' for _ in range(rng.randrange(5))) + "}"

    def body():
        blocks = ",".join(rng.choice([value(4), '{"type":"text","text":' + value(5) + "}"]) for _ in range(rng.randrange(4)))
        content = rng.choice([value(3), f"[{blocks}]", '"hi a@b.com"'])
        message = '{"role":"user","content":' + content + rng.choice(["", ',"content":' + value(3)]) + "}"
        lists = [f'"messages":[{message},{value(2)},{message}]', f'"x":{value(1)}'] + [f'"messages":{value(1)}'] * (rng.random() < .2)
        return " {" + ",".join(rng.sample(lists, len(lists))) + "}" + rng.choice(["", " ", "\n", "x"][: 3 if rng.random() < .95 else 4])

    bodies = [body() for _ in range(1500)] + [value(0) for _ in range(200)] + [None, "", "{", '{"messages":[]}']
    bodies += ['{"a":' + "[" * 5000 + "]" * 5000 + ',"messages":[{"content":"a@b.com"}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: [] for r in df.select("id").collect()}
    for r in nested.chat_texts(df, ["id"]).collect():
        got[r.id].append((r.msg, r.block, r.text))
    want = {i: plain_parts(b) for i, b in enumerate(bodies[:-1])}
    want[len(bodies) - 1] = [(0, 0, "a@b.com")]
    assert got == want and sum(map(len, want.values())) > 1000
    for r in nested.mask_chat(df, ["id"]).collect():
        body = bodies[r.id]
        assert (r.masked_body == body) if not r.mappings else ("[PII_EMAIL_A]" in r.masked_body)


def test_store(spark):
    path = tempfile.mkdtemp() + "/vault"
    rows = spark.range(40).selectExpr(
        "id", "concat('s', id % 4) as session_id", "concat('[PII_X_', id, ']') as placeholder",
        "cast(id as string) as real_value", "'x' as data_type", "if(id % 2 = 0, 't/0', null) as team_id",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 5 as int)) as created_at",
    )
    store.save_mappings(rows, path)
    gone = spark.createDataFrame([("s1",)], "session_id string")
    assert store.delete_rows(spark, path, gone, ["session_id"]) == 10
    assert store.load(spark, path).filter("session_id = 's1'").count() == 0
    assert store.purge_before(spark, path, "2024-01-03 00:00:00") == 12
    assert store.load(spark, path).agg(F.min("created_at")).first()[0].day == 3
    left = store.load(spark, path).count()
    backup = tempfile.mkdtemp() + "/b"
    store.backup(spark, path, backup)
    try:
        store.restore_backup(spark, backup, path)
        raise AssertionError("must refuse")
    except ValueError:
        pass
    store.clear(spark, path)
    store.restore_backup(spark, backup, path)
    assert store.load(spark, path).count() == left == 18


def test_store_changes_in_one_step(spark, monkeypatch):
    """A reader in the middle of a change, a run that dies before its list counts, and what is removed later."""
    path = tempfile.mkdtemp() + "/vault"
    rows = spark.range(60).selectExpr(
        "id", "concat('s', id % 6) as session_id", "'p' as placeholder", "cast(id as string) as real_value", "'x' as data_type",
        "concat('t', id % 2) as team_id",
        "if(id = 59, null, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 5 as int))) as created_at")
    store.save_mappings(rows.filter("id < 30"), path)
    store.save_mappings(rows.filter("id >= 30"), path)
    before = sorted(r.id for r in store.load(spark, path).collect())
    assert before == list(range(60))
    reader = store.load(spark, path)
    gone = spark.createDataFrame([("s1",), ("s2",)], "session_id string")

    def fails(*args):
        raise RuntimeError("died")

    for step in ("_publish", "_write"):
        with monkeypatch.context() as m:
            m.setattr(store, step, fails)
            try:
                store.delete_rows(spark, path, gone, ["session_id"])
                raise AssertionError("must die")
            except RuntimeError:
                pass
        assert sorted(r.id for r in store.load(spark, path).collect()) == before
    # a list that is not complete does not count
    os.makedirs(f"{path}/lists/99")
    assert sorted(r.id for r in store.load(spark, path).collect()) == before
    os.rmdir(f"{path}/lists/99")
    assert store.delete_rows(spark, path, gone, ["session_id"]) == 20
    assert store.purge_before(spark, path, "2024-01-02 00:00:00") == sum(i % 6 not in (1, 2) and i % 5 == 0 for i in range(59))
    left = sorted(r.id for r in store.load(spark, path).collect())
    assert left == [i for i in range(60) if i % 6 not in (1, 2) and (i % 5 or i == 59)]
    assert sorted(r.id for r in reader.collect()) == before  # began with the old list
    assert store.remove_old(spark, path) > 0
    assert sorted(r.id for r in store.load(spark, path).collect()) == left
    assert sorted(r.id for r in spark.read.parquet(f"{path}/data").collect()) == left  # nothing else is kept
    assert store.remove_old(spark, path) == 0


def test_rule_tables_and_files(spark):
    folder = tempfile.mkdtemp()
    with open(os.path.join(folder, "c.json"), "w", encoding="utf-8") as f:
        json.dump({"version": "1", "entities": [
            {"key": "zip", "detector": "regex", "pattern": "z\\d+", "enabled": True},
            {"key": "off", "detector": "regex", "pattern": "o\\d+", "enabled": False}, {"name_en": "no key"}]}, f)
    pack = rules.load_pack(spark, os.path.join(folder, "c.json"))
    assert [e.key for e in pack.entities] == ["zip", "off"]
    assert [e.key for e in pack.catalog_rules()] == ["zip"]
    missing = rules.load_pack(spark, os.path.join(folder, "none.json"))
    assert len(missing.entities) == 20 and missing.is_enabled("person")
    with open(os.path.join(folder, "b.json"), "w", encoding="utf-8") as f:
        json.dump({"keywords": [" k1 ", "", "k1"], "regex_rules": [
            {"name": "r", "pattern": "(", "entity_type": "phone"},
            {"name": " s ", "pattern": "s+", "entity_type": "PHONE"}]}, f)
    words, incoming = rules.read_bundle(spark, os.path.join(folder, "b.json"))
    twice = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "xab"), (None, "ab")], "id int, text string")
    got = keywords.keyword_matches(twice, ["id"], spark.createDataFrame([("ab",), ("b",)], "keyword string"))
    assert sorted(map(str, ((r.id, r.keyword, r.start) for r in got.collect()))) == sorted(map(str, [
        (1, "ab", 0), (1, "ab", 0), (1, "ab", 1), (None, "ab", 0), (1, "b", 1), (1, "b", 1), (1, "b", 2), (None, "b", 1)]))
    none = spark.createDataFrame([], "keyword string")
    assert [r[0] for r in rules.add_keywords(none, words).collect()] == ["k1"]
    checked = rules.checked_rules(incoming)
    assert {r.name: r.error for r in checked.collect()} == {"r": "pattern does not compile", "s": None}
    stored = spark.createDataFrame([(1, "s", "s+", "phone", True), (2, "b", "(", "phone", True)],
                                   "id int, name string, pattern string, entity_type string, enabled boolean")
    pack = RulePack().with_tables(spark.createDataFrame([("w",)], "keyword string"), stored)
    assert pack.keywords == ("w",) and [r.name for r in pack.rules] == ["s"]


def test_catalog_listing_and_tokens(spark):
    table = RulePack().catalog_table(spark).collect()
    assert len(table) == 26 and {r.key: r.type for r in table}["bankcard"] == "PII_BANK"
    df = spark.createDataFrame([("[PII_BANKCARD_A]",), ("[PII_NOPE_A]",), ("text",)], "p string")
    got = [r[0] for r in df.selectExpr(compliance.placeholder_token(RulePack(), "p")).collect()]
    assert got == ["PII_BANK", "unknown", "unknown"]
    uses = spark.createDataFrame([("x [PII_A_B] [PII_A_B] [PII_C_1]",)], "t string")
    assert uses.selectExpr(placeholders_in("t")).first()[0] == ["[PII_A_B]"]


def test_scores_and_reasons(spark):
    p = spark.createDataFrame([(1, "a", 0, 2), (1, "a", 5, 6)], "doc_id int, entity_type string, start int, end int")
    g = spark.createDataFrame([(1, "a", 0, 2), (2, "a", 0, 1)], "doc_id int, entity_type string, start int, end int")
    row = quality.detector_scores(p, g, ["entity_type"]).first()
    assert (row.tp, row.fp, row.fn, row.f1) == (1, 1, 1, 0.5)
    df = spark.createDataFrame([("",), ("x",), ("x" * 102401,)], "t string")
    assert [r[0] for r in df.selectExpr(quality.text_reject_reason("t")).collect()] == ["empty", None, "too long"]
