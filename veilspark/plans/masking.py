"""Masking, restoring and checking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.fence import fence
from veilspark.functions.rulepack import RulePack
from veilspark.functions.sql import register
from veilspark.functions.text import LETTERS, alpha_id, fingerprint, lit, luhn_ok, session_key
from veilspark.operators import compliance, nested, quality, stats, vault
from veilspark.operators.detect import count_spans, detect
from veilspark.operators.mask import mask
from veilspark.operators.restore import restore, restore_from_vault
from veilspark.plans import derived as D
from veilspark.plans.detection import DIGITS, PATTERN, VALUES, luhn, where
from veilspark.plans.registry import CHECKS, query
from veilspark.sources import store
from veilspark.sources.tables import shared_folder, spread, table

PACK = RulePack()
# placeholders without their letters, so that a check does not depend on numbering
SHAPE = r"regexp_replace({}, '\\[PII_(\\w+)_[A-Z]+\\]', '[$1]')"


def shape(column: str) -> str:
    return SHAPE.format(column)


_card = "(^|[^0-9])([0-9]{16}|[0-9]{19})([^0-9]|$)"
# neighbouring cards share the character between them, so the replacement runs twice
_shape_sql = (
    f"regexp_replace(regexp_replace(text, '{VALUES['email'].split(chr(39))[1]}', "
    f"'[EMAIL]', 'g'), '{PATTERN['ip']}', '[IP]', 'g')"
)
_code = "(^|[^0-9])([1-9][0-9]{5})([^0-9]|$)"
for _run, _name in ((_card, "BANKCARD"), (_card, "BANKCARD"), (_code, "POSTCODE"), (_code, "POSTCODE")):
    _shape_sql = f"regexp_replace({_shape_sql}, '{_run}', '\\1[{_name}]\\3', 'g')"


@query(
    "mask_documents",
    f"with v as (select doc_id, text, len({VALUES['email']}) as e, "
    f"len({where(DIGITS, 'length(x) in (16, 19)')}) as b, len({VALUES['ip']}) as i, "
    f"len({VALUES['postcode']}) as p from documents) "
    "select doc_id, cast(e as bigint) as n_email, cast(b as bigint) as n_bankcard, "
    "cast(i as bigint) as n_ip, cast(p as bigint) as n_postcode, "
    f"cast(e + b + i + p as bigint) as n_total, {_shape_sql} as masked_shape from v",
)
def mask_documents(spark, sf_dir):
    """Flagship: mask whole documents with all rules."""
    masked = mask(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    count = {
        f"n_{k}": F.expr(f"coalesce(try_element_at(stats, '{k}'), 0L)")
        for k in ("email", "bankcard", "ip", "postcode")
    }
    return masked.withColumns(count).selectExpr(
        "doc_id", *count, "cast(size(mappings) as bigint) as n_total",
        f"{shape('masked')} as masked_shape",
    )


@query("sql_mask_documents", CHECKS["mask_documents"])
def sql_mask_documents(spark, sf_dir):
    """The flagship through SQL functions."""
    register(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ", ".join(
        f"coalesce(try_element_at(m.stats, '{k}'), 0L) as n_{k}" for k in ("email", "bankcard", "ip", "postcode"))
    return spark.sql(
        f"select doc_id, {counts}, cast(size(m.mappings) as bigint) as n_total, {shape('m.masked')} as masked_shape "
        "from (select doc_id, pii_mask_all(text) as m from {docs})", docs=docs)


@query(
    "sql_detect_values",
    f"with v as (select doc_id, {VALUES['email']} as found from documents) "
    "select doc_id, 'email' as entity_type, value, count(*) as n from "
    "(select doc_id, unnest(found) as value from v) group by 1, 2, 3",
)
def sql_detect_values(spark, sf_dir):
    """Spans as a SQL function finds them: the addresses of the documents."""
    register(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spark.sql(
        "select doc_id, s.entity_type, s.value, count(*) as n from (select doc_id, pii_detect(text) as found from {docs}) "
        "lateral view explode(found) as s where s.entity_type = 'email' group by 1, 2, 3", docs=docs)


_short = (
    "concat('Order ', cast(o_orderkey as string), ' of u', cast(o_custkey as string), "
    "'@example.com, tel ', cast(13000000000 + o_orderkey as string), ', id 110101', "
    "cast(1950 + o_orderkey % 60 as string), '0115', lpad(cast(o_orderkey % 1000 as string), 3, '0'), "
    "'X, seen at 10.1.', cast(o_custkey % 256 as string), '.', cast(o_orderkey % 256 as string), "
    "'. Please call back about the delivery; thanks and regards, the service team.')"
)


@query(
    "mask_short_texts",
    "select o_orderkey, concat('Order ', case when length(cast(o_orderkey as varchar)) = 6 then '[POSTCODE]' "
    "else cast(o_orderkey as varchar) end, ' of [EMAIL], tel [PHONE], id [IDCARD], seen at [IP]. Please "
    "call back about the delivery; thanks and regards, the service team.') as masked_shape, "
    "cast(case when length(cast(o_orderkey as varchar)) = 6 then 5 else 4 end as bigint) as n from orders",
)
def mask_short_texts(spark, sf_dir):
    """Batch masking of short messages that hold a handful of entities each."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    masked = mask(orders.selectExpr("o_orderkey", f"{_short} as text"))
    return masked.selectExpr(
        "o_orderkey", f"{shape('masked')} as masked_shape", "cast(size(mappings) as bigint) as n"
    )


_STAGED = [k for k, _ in C.ENTITY_STAGE]
_in_text = [k for k in D.GOLD_KEYS]
_numbered = [k for k in _in_text if k in _STAGED] + [
    k for k in C.RULE_ORDER if k in _in_text and k not in _STAGED
]
_letter = {k: LETTERS[i] for i, k in enumerate(_numbered)}


def _gold_rows(extra: str) -> str:
    from veilspark.plans.detection import gold_sql

    letters = " ".join(f"when '{k}' then '[PII_{k.upper()}_{v}]'" for k, v in _letter.items())
    return (
        f"select doc_id, entity_type, value, case entity_type {letters} end as placeholder, "
        f"{extra} from ({gold_sql()}) g"
    )


@query("mappings", _gold_rows('start, "end"'))
def mappings(spark, sf_dir):
    """The mapping table of masked texts, numbered by stage, rule and position."""
    masked = mask(D.derived(spark, sf_dir, "pii_text_on").select("doc_id", "text"))
    return masked.select("doc_id", F.explode("mappings").alias("m")).selectExpr(
        "doc_id", "m.entity_type", "m.value", "m.placeholder", "cast(m.start as bigint) as start",
        "cast(m.end as bigint) as end",
    )


_tokens = " ".join(f"when '{row[0]}' then '{row[6]}'" for row in C.ENTITIES)


@query(
    "entity_report",
    f"select r.doc_id, case entity_type {_tokens} end as type, r.value, r.placeholder, "
    "cast(strpos(t.text, r.value) - 1 as bigint) as position from ("
    + _gold_rows("start") + f") r join ({D.check_sql('pii_text_on')}) t using (doc_id)",
)
def entity_report(spark, sf_dir):
    """Token, value, placeholder and first position of every masked entity."""
    masked = mask(D.derived(spark, sf_dir, "pii_text_on").select("doc_id", "text"))
    return compliance.entity_report(masked, ["doc_id"], PACK)


@query(
    "placeholder_tokens",
    D.with_tables("vault") + f" select case data_type {_tokens} end as token, count(*) as n "
    "from vault group by 1 union all select 'unknown', count(*) from vault",
)
def placeholder_tokens(spark, sf_dir):
    """Entity token of placeholders; anything else is unknown."""
    v = D.derived(spark, sf_dir, "vault").select("placeholder")
    both = v.unionByName(v.select(F.lower("placeholder").alias("placeholder")))
    token = F.expr(compliance.placeholder_token(PACK, "placeholder")).alias("token")
    return both.groupBy(token).agg(F.count(F.lit(1)).alias("n"))


@query("fingerprints", D.with_tables("vault")
       + " select id, substr(sha256(real_value), 1, 16) as value_hash from vault")
def fingerprints(spark, sf_dir):
    v = D.derived(spark, sf_dir, "vault")
    return v.selectExpr("id", f"{fingerprint('real_value')} as value_hash")


def _alpha_check(n: str) -> str:
    offsets = [1, 27, 703, 18279, 475255, 12356631]
    cases = []
    for length, off in enumerate(offsets, 1):
        letters = " || ".join(
            f"substr('{LETTERS}', cast(({n} - {off}) // {26 ** k} % 26 + 1 as int), 1)"
            for k in range(length - 1, -1, -1)
        )
        cases.append(f"when {n} < {off + 26 ** length} then {letters}")
    return f"case {' '.join(cases)} end"


@query("alpha_ids", f"select o_orderkey, {_alpha_check('(o_orderkey + 1)')} as alpha from orders")
def alpha_ids(spark, sf_dir):
    """Letters-only numbers."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{alpha_id('(o_orderkey + 1)')} as alpha"
    )


@query(
    "card_filter",
    "select o_orderkey, card, length(card) = 11 and card like '1%' as phone_like, "
    f"{luhn('card')} as luhn from (select o_orderkey, case when o_orderkey % 4 = 0 "
    "then cast(13000000000 + o_orderkey as string) else cast(62220000000000000 + o_orderkey as "
    "string) end as card from orders) q",
)
def card_filter(spark, sf_dir):
    """Check digit and phone-like filter of card numbers."""
    cards = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 4 = 0 then cast(13000000000 + o_orderkey as string) "
        "else cast(62220000000000000 + o_orderkey as string) end as card",
    )
    return cards.selectExpr(
        "o_orderkey", "card", "length(card) = 11 and startswith(card, '1') as phone_like",
        f"{luhn_ok('card')} as luhn",
    )


@query(
    "session_keys",
    "select event_id, concat('sess_', cast(epoch_us(ts) // 1000 as varchar), '_', "
    "substr(sha256(cast(user_id as varchar)), 1, 8)) as session_id from events",
)
def session_keys(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.selectExpr("event_id", f"{session_key('ts', 'user_id')} as session_id")


# -- conversations and requests ---------------------------------------------------------
_chat_text = "concat(text, ' 手机', cast(13000000000 + conv_id * 1000 + turn as string))"
_chat_shape = "concat(text, ' 手机[PHONE]')"


@query(
    "mask_conversations",
    f"select conv_id, turn, {_chat_shape} as masked_shape, cast(1 as bigint) as n, "
    "cast(turn * 16777216 + 1 as bigint) as seq from conversations",
)
def mask_conversations(spark, sf_dir):
    """Messages of a session, each with its own range of placeholder numbers."""
    chat = spread(table(spark, sf_dir, "conversations")).withColumn("text", F.expr(_chat_text))
    masked = mask(chat, message_no="turn")
    return masked.selectExpr(
        "conv_id", "turn", f"{shape('masked')} as masked_shape",
        "cast(size(mappings) as bigint) as n", "mappings[0].seq as seq",
    )


@query(
    "session_stats",
    "select conv_id, 'phone' as entity_type, count(*) as n from conversations group by 1",
)
def session_stats(spark, sf_dir):
    """Counters of the texts of a session added up."""
    chat = spread(table(spark, sf_dir, "conversations")).withColumn("text", F.expr(_chat_text))
    counted = count_spans(detect(chat))
    return (
        counted.select("conv_id", F.explode("stats").alias("entity_type", "n"))
        .groupBy("conv_id", "entity_type").agg(F.sum("n").alias("n"))
    )


# One request per message, plain or as blocks, with fields that masking must leave alone, half of a
# surrogate pair, keys that repeat and deep nesting.
_DEEP = '{"d":[' * 60 + '"13900000004"' + "]}" * 60
_REQUESTS = (
    '{"model":"m","temperature":0.70,"x":' + _DEEP + ',"messages":[{"role":"user","name":"n 13900000000","content":null,"content":@T@},'
    '{"role":"tool","tool_call_id":"call 13900000001","content":"\\ud800 ip 10.0.0.1"},{"role":"assistant","content":null,'
    '"tool_calls":[{"id":"c","arguments":"{\\"tel\\":13900000002}"}]}],'
    '"tools":[{"type":"function","function":{"name":"f","strict":true}}], "stream":false}',
    '{"messages":"none","messages":[{"content":[{"type":"text","text":@T@,"cache_control":{"type":"ephemeral"}},'
    '{"type":"text","text":"half \\uDC00 a pair"},'
    '{"type":"image","source":{"data":"13900000000","n":1e2}},{"text":"ip 10.0.0.1","type":"text"}],"role":"user"}],'
    '"stream":true,"model":"m","max_tokens":64}',
)


def _request_sql(text: str, ip: str) -> str:
    """The request in Spark, or what masking makes of it for the checking engine: a text that changes has ? for the half pair."""
    plain, blocks = (lit(r.replace("10.0.0.1", ip)) if ip.startswith("1") else
                     "'" + r.replace("\\ud800 ip 10.0.0.1", "? ip " + ip).replace("10.0.0.1", ip).replace("'", "''") + "'"
                     for r in _REQUESTS)
    return f"replace(case when turn % 2 = 0 then {plain} else {blocks} end, '@T@', {text})"


def _requests(spark, sf_dir):
    """One request per message: plain content, or blocks with a non-text one between."""
    chat = spread(table(spark, sf_dir, "conversations")).withColumn("t", F.expr(_chat_text))
    literal = "substr(to_json(array(t)), 2, length(to_json(array(t))) - 2)"
    return chat.selectExpr("conv_id", "turn", f"{_request_sql(literal, '10.0.0.1')} as body")


_masked_request = _request_sql(f"cast(to_json({_chat_shape}) as varchar)", "[IP]")


@query(
    "mask_chat_requests",
    f"select conv_id, turn, {_masked_request} as masked_shape, true as hashed, cast(2 as bigint) as n_used, "
    "cast(1 as bigint) as n_phone, cast(1 as bigint) as n_ip from conversations",
)
def mask_chat_requests(spark, sf_dir):
    """Whole chat requests: only texts change, in the form they had; all other fields stay."""
    masked = nested.mask_chat(_requests(spark, sf_dir), ["conv_id", "turn"])
    return masked.selectExpr(
        "conv_id", "turn", f"{shape('masked_body')} as masked_shape", "content_hash = sha2(masked_body, 256) as hashed",
        "cast(size(used) as bigint) as n_used", "stats['phone'] as n_phone", "stats['ip'] as n_ip",
    )


@query(
    "mask_chat_dry_run",
    "select conv_id, turn, true as unchanged, cast(0 as bigint) as n_mappings, cast(1 as bigint) as n_phone, "
    "cast(1 as bigint) as n_ip from conversations",
)
def mask_chat_dry_run(spark, sf_dir):
    """A dry run counts what masking would find, and leaves the request alone."""
    requests = _requests(spark, sf_dir)
    masked = nested.mask_chat(requests.withColumn("sent", F.col("body")), ["conv_id", "turn", "sent"], dry_run=True)
    return masked.selectExpr(
        "conv_id", "turn", "masked_body = sent as unchanged", "cast(size(mappings) as bigint) as n_mappings",
        "stats['phone'] as n_phone", "stats['ip'] as n_ip",
    )


_json = (
    "concat(chr(123), '\"mail\":\"u', cast(event_id as string), '@example.com\",\"list\":[\"ip 10.0.0.1\",',"
    " cast(event_id as string), ',null],\"13800000000\":', props, chr(125))"
)
_json_shape = (
    "concat(chr(123), '\"mail\":\"[EMAIL]\",\"list\":[\"ip [IP]\",', cast(event_id as string), "
    "',null],\"13800000000\":', props, chr(125))"
)


@query(
    "json_masked",
    f"select event_id, case when event_id % 7 <> 0 then {_json_shape} end as masked_shape, "
    "case when event_id % 7 <> 0 then cast(2 as bigint) else 0 end as n from events "
    f"union all select 1 as event_id, {_json_shape} as masked_shape, cast(2 as bigint) as n from events where event_id % 5 = 1",
)
def json_masked(spark, sf_dir):
    """String values of JSON are masked; keys, numbers and nulls stay.

    Some documents are null, and some share their key with others.
    """
    events = spread(table(spark, sf_dir, "events").select("event_id", "props"))
    docs = events.selectExpr(f"""inline(if(event_id % 5 = 1,
        array(struct(event_id as k, event_id % 7 <> 0 as there), struct(1L as k, true as there)),
        array(struct(event_id as k, event_id % 7 <> 0 as there))))""", "event_id", "props")
    docs = docs.selectExpr("k", f"if(there, {_json}, null) as body")
    masked = nested.mask_json(docs, ["k"], "body")
    return masked.selectExpr(
        "k as event_id", f"{shape('masked')} as masked_shape", "cast(size(coalesce(mappings, array())) as bigint) as n"
    )


# -- restoring ------------------------------------------------------------------------------
@query(
    "restore_roundtrip",
    D.with_tables("pii_text") + ", t as (select text from documents union all "
    "select text from pii_text) select count(*) as n, cast(0 as bigint) as n_different from t",
)
def restore_roundtrip(spark, sf_dir):
    """Mask and restore gives every text back."""
    docs = spread(table(spark, sf_dir, "documents").select("text")).unionByName(
        D.derived(spark, sf_dir, "pii_text").select("text")
    )
    # without the fence the optimizer would repeat the whole chain of patterns for each side of the union
    return quality.round_trip(restore(mask(fence(docs, "text"))))


@query("vault_path", "select count(*) as n, cast(0 as bigint) as n_different, true as hidden from documents")
def vault_path(spark, sf_dir):
    """Mask, store the encrypted mappings, load them and restore every text from there."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    masked = mask(docs).selectExpr("doc_id", "concat('sess_', doc_id) as session_id", "text", "masked", "mappings")
    # masked texts are stored, as they are read three times: for the vault, for what is needed of it, and to be restored
    written = shared_folder(spark, "masked")
    masked.write.parquet(written)
    masked = spark.read.schema(masked.schema).parquet(written)
    rows = vault.mapping_rows(masked, created_at="timestamp '2024-01-01 00:00:00'")
    path = shared_folder(spark, "vault")
    store.save_mappings(vault.encrypt_values(rows, "correct horse"), path)
    stored = store.load(spark, path)
    back = restore_from_vault(masked, vault.decrypt_values(stored, "correct horse"), ["doc_id"])
    hidden = stored.agg((F.count_if(F.expr("real_value rlike '[@.]'")) == 0).alias("hidden")).withColumn("one", F.lit(1))
    return quality.round_trip(back).withColumn("one", F.lit(1)).join(hidden, "one").drop("one")


@query("leak_check", "select count(*) as n, cast(0 as bigint) as n_leaks from documents")
def leak_check(spark, sf_dir):
    """No masked value can be read in the masked text."""
    masked = mask(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    leaking = "exists(mappings, m -> contains(masked, m.value))"
    return masked.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr(f"if({leaking}, 1L, 0L)")).alias("n_leaks"),
    )


def _replies(spark, sf_dir):
    return D.derived(spark, sf_dir, "vault").selectExpr(
        "id as reply_id", "session_id",
        "concat('see ', placeholder, ' and [PII_IP_ZZZ], again ', placeholder) as masked",
    )


@query(
    "restore_vault",
    D.with_tables("vault") + " select id as reply_id, concat('see ', real_value, "
    "' and [PII_IP_ZZZ], again ', real_value) as restored from vault",
)
def restore_vault(spark, sf_dir):
    """Replies restored by joining their placeholders with the mapping table."""
    v = D.derived(spark, sf_dir, "vault")
    return restore_from_vault(_replies(spark, sf_dir), v, ["reply_id"]).select("reply_id", "restored")


@query(
    "restore_used_only",
    D.with_tables("vault") + ", r as (select id, placeholder, case when id % 2 = 0 then real_value "
    "else placeholder end as v from vault) select id as reply_id, concat('see ', v, "
    "' and [PII_IP_ZZZ], again ', v) as restored from r",
)
def restore_used_only(spark, sf_dir):
    """Only placeholders that were used in the request may be restored."""
    v = D.derived(spark, sf_dir, "vault")
    allowed = v.filter("id % 2 = 0")
    out = restore_from_vault(_replies(spark, sf_dir), v, ["reply_id"], allowed=allowed)
    return out.select("reply_id", "restored")


_REPLY = (
    '{"id":"r","object":"chat.completion","created":1.50,"choices":0,"choices":[{"index":0,"logprobs":{"content":["@P@"]},'
    '"message":{"role":"assistant","content":"@P@","content":"tel @V@","tool_calls":[{"id":"@P@"}]},"finish_reason":"stop"},'
    '{"message":{"content":"@H@ @V@"}},{"message":{"content":"@S@"}},{"message":{"content":null}}],"usage":{"total_tokens":7}, "x":"@P@",'
    '"deep":' + _DEEP + "}"
)
# half of a surrogate pair, as sent; a text that changes gets a question mark for it
_SENT = _REPLY.replace("@H@", r"\\ud800").replace("@S@", r"\\udc00")
_BACK = _REPLY.replace("@H@", "?").replace("@S@", r"\udc00")


@query(
    "restore_reply",
    D.with_tables("vault") + f" select id as reply_id, case when id % 2 = 0 then replace(replace('{_BACK}', "
    "'@P@', placeholder), '@V@', real_value) else concat('not json ', placeholder) end as restored from vault",
)
def restore_reply(spark, sf_dir):
    """Reply JSON is restored in its content fields only; all other text passes."""
    v = spread(D.derived(spark, sf_dir, "vault"))
    replies = v.selectExpr(
        "id as reply_id", "map(placeholder, real_value) as m",
        f"if(id % 2 = 0, replace(replace('{_SENT}', '@P@', placeholder), '@V@', placeholder), "
        "concat('not json ', placeholder)) as body",
    )
    return nested.restore_reply(replies, "body", "m").select("reply_id", "restored")


@query(
    "restore_encrypted_vault",
    D.with_tables("vault") + " select id as reply_id, concat('see ', real_value, "
    "' and [PII_IP_ZZZ], again ', real_value) as restored from vault",
)
def restore_encrypted_vault(spark, sf_dir):
    """Restore through a function that looks the needed pairs up among encrypted rows and decrypts only those."""
    v = vault.encrypt_values(D.derived(spark, sf_dir, "vault"), "correct horse")

    def lookup(needed):
        found = v.join(needed, ["session_id", "placeholder"]).groupBy("session_id", "placeholder").agg(
            F.min_by("real_value", "id").alias("real_value"))
        return vault.decrypt_values(found, "correct horse")

    return restore_from_vault(_replies(spark, sf_dir), lookup, ["reply_id"]).select("reply_id", "restored")


# -- grades and cryptography ------------------------------------------------------------------
@query(
    "compliance_by_session",
    D.with_tables("vault") + " select session_id, case when max(case data_type "
    "when 'credit_code' then 2 else 1 end) = 2 then 'important_data' else 'personal_info' end "
    "as compliance_tag from vault group by 1",
)
def compliance_by_session(spark, sf_dir):
    v = D.derived(spark, sf_dir, "vault")
    counts = v.groupBy("session_id", F.col("data_type").alias("entity_type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return compliance.dominant_tag(PACK, counts, ["session_id"])


@query(
    "crypto_roundtrip",
    D.with_tables("vault") + " select data_type, count(*) as n, count(*) as n_back, "
    "count(*) as n_hidden, count(*) as n_plain_kept, cast(0 as bigint) as n_wrong_key, "
    "cast(sum(28 + length(real_value)) as bigint) as cipher_bytes from vault group by 1",
)
def crypto_roundtrip(spark, sf_dir):
    """Encrypt and decrypt the mapping table; stored plain text and wrong keys are told apart."""
    v = D.derived(spark, sf_dir, "vault").select("data_type", "real_value")
    enc = vault.encrypt_values(v.withColumn("plain", F.col("real_value")), "correct horse")
    enc = enc.withColumnRenamed("real_value", "cipher")
    return enc.select(
        "data_type", "plain", "cipher",
        F.coalesce(vault.decrypted(enc, "cipher", "correct horse"), "cipher").alias("back"),
        F.coalesce(vault.decrypted(enc, "plain", "correct horse"), "plain").alias("kept"),
        vault.decrypted(enc, "cipher", "another key").alias("wrong"),
        F.octet_length(F.unbase64("cipher")).alias("size"),
    ).groupBy("data_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.expr("back = plain")).alias("n_back"),
        F.count_if(F.expr("cipher <> plain and not contains(cipher, plain)")).alias("n_hidden"),
        F.count_if(F.expr("kept = plain")).alias("n_plain_kept"),
        F.count("wrong").alias("n_wrong_key"),
        F.sum(F.col("size").cast("long")).alias("cipher_bytes"),
    )


@query(
    "transparency",
    f"with v as (select doc_id, len({VALUES['email']}) as email, "
    f"len({where(DIGITS, 'length(x) in (16, 19)')}) as bankcard, len({VALUES['ip']}) as ip, "
    f"len({VALUES['postcode']}) as postcode from documents) "
    "select doc_id, cast(email + bankcard + ip + postcode as bigint) as total, "
    "array_to_string([x for x in [case when bankcard > 0 then 'bankcard' end, "
    "case when email > 0 then 'email' end, case when ip > 0 then 'ip' end, "
    "case when postcode > 0 then 'postcode' end] if x is not null], ',') "
    "as types from v",
)
def transparency(spark, sf_dir):
    """What a client is told: how much was masked and which types."""
    counted = count_spans(detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    total, types = stats.transparency("stats")
    return counted.selectExpr("doc_id", f"{total} as total", f"{types} as types")


@query(
    "text_limits",
    "select doc_id, case when t = '' then 'empty' when length(t) > 102400 then 'too long' end as reason "
    "from (select doc_id, case doc_id % 50 when 0 then '' when 1 then repeat(text, 60) else text end "
    "as t from documents) q",
)
def text_limits(spark, sf_dir):
    """Texts that the service would refuse, and why."""
    docs = spread(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "case doc_id % 50 when 0 then '' when 1 then repeat(text, 60) else text end as t"
    )
    return docs.selectExpr("doc_id", f"{quality.text_reject_reason('t')} as reason")


@query(
    "row_keywords",
    "select event_id, case when event_id % 3 = 0 then concat('say [CUSTOM] to ', event_type, 'x') "
    "else concat('say ', event_type, '+ to ', event_type, 'x') end as masked_shape from events",
)
def row_keywords(spark, sf_dir):
    """Keywords that hold for one request only."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "event_type")).selectExpr(
        "event_id", "concat('say ', event_type, '+ to ', event_type, 'x') as text",
        "if(event_id % 3 = 0, array(concat(' ', event_type, '+ ')), array(' ')) as kw",
    )
    return mask(ev, row_keywords="kw").selectExpr("event_id", f"{shape('masked')} as masked_shape")
