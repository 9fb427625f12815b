"""Operational tables derived from the given ones.

Each recipe is SQL that means the same in Spark and in the checking engine.
Names in braces are input tables; ``sha256(x)`` is spelt for each engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from veilspark.sources.tables import spread, table

AUDIT = """
select event_id as id, concat('sess_', cast(user_id as string)) as session_id,
       event_type as action,
       concat(chr(123), '"team_id": "team_', cast(user_id % 5 as string), '", "props": ', props,
              chr(125)) as detail_json,
       concat('team_', cast(user_id % 5 as string)) as team_id,
       cast(date_trunc('second', ts) as string) as created_at
from {events}
"""

VAULT = """
select o_orderkey as id,
       concat('sess_', cast(o_custkey % 200 as string)) as session_id,
       concat('[PII_', upper(case o_orderkey % 3 when 0 then 'phone' when 1 then 'email'
                             else 'credit_code' end), '_',
              translate(cast(o_orderkey as string), '0123456789', 'ABCDEFGHIJ'), ']') as placeholder,
       case o_orderkey % 3 when 0 then cast(13000000000 + o_orderkey as string)
            when 1 then concat('user', cast(o_orderkey as string), '@example.com')
            else concat('91310000', lpad(cast(o_orderkey as string), 10, '0')) end as real_value,
       case o_orderkey % 3 when 0 then 'phone' when 1 then 'email' else 'credit_code' end as data_type,
       concat('team_', cast(o_custkey % 200 % 5 as string)) as team_id,
       o_orderdate as created_at
from {orders}
"""

API_KEYS = """
select c_custkey as id, c_name as raw_key, sha256(c_name) as key_hash,
       concat('team_', cast(c_custkey % 7 as string)) as team_id,
       case when c_custkey % 11 = 0 then 'enterprise'
            when c_custkey % 7 % 3 = 0 then 'free'
            when c_custkey % 7 % 3 = 1 then 'team' else 'enterprise' end as tier,
       c_mktsegment as label, 1700000000 + c_custkey * 60 as created_at,
       c_custkey % 10 <> 0 as is_active
from {customer}
"""

REQUESTS = """
select event_id as id, ts, concat('/v1/', event_type) as endpoint,
       case when event_id % 4 = 0 then 'GET' else 'POST' end as method,
       case when event_type = 'error' then 500 else 200 end as status,
       case when event_type = 'error' then concat('type_', cast(event_id % 3 as string)) end as error_type,
       value / 10 as latency,
       concat('model-', cast(event_id % 4 as string)) as model,
       concat('Customer#', lpad(cast(user_id as string), 9, '0')) as api_key
from {events}
"""

OUTCOMES = """
select event_id as id, cast(user_id as string) as node, ts, event_type = 'error' as failed
from {events} where event_type in ('error', 'signup')
"""

STAT_UPDATES = """
select event_id as update_id, cast(cast(ts as date) as string) as date,
       concat('team_', cast(user_id % 5 as string)) as team_id,
       case event_type when 'error' then 'organization' when 'signup' then 'phone'
            when 'click' then 'email' when 'view' then 'ip' else 'mystery' end as entity_type,
       1 + event_id % 3 as n
from {events}
union all
select event_id as update_id, cast(cast(ts as date) as string) as date,
       concat('team_', cast(user_id % 5 as string)) as team_id, 'url' as entity_type,
       event_id % 2 as n
from {events}
"""

# the same updates as one row each, for Spark alone
STAT_MAPS = """
select cast(cast(ts as date) as string) as date, concat('team_', cast(user_id % 5 as string)) as team_id,
       map(case event_type when 'error' then 'organization' when 'signup' then 'phone'
           when 'click' then 'email' when 'view' then 'ip' else 'mystery' end, 1 + event_id % 3,
           'url', event_id % 2) as stats
from {events}
"""

# (key, expression of the value, text between this value and the next) -- one of each entity
PII_PARTS = [
    ("phone", "cast(13000000000 + o_orderkey % 1000000000 as string)", "手机", " "),
    ("email", "concat('u', cast(o_custkey as string), '@example.com')", "邮箱 ", " "),
    ("idcard", "concat('110101', cast(1950 + o_orderkey % 60 as string), '01', "
               "lpad(cast(10 + o_orderkey % 19 as string), 2, '0'), "
               "lpad(cast(o_orderkey % 1000 as string), 3, '0'), 'X')", "身份证", " "),
    ("bankcard", "cast(6222000000000000 + o_orderkey as string)", "卡", " "),
    ("plate", "concat('京A', lpad(cast(o_orderkey % 100000 as string), 5, '0'))", "", " "),
    ("coordinates", "concat('116.', lpad(cast(o_orderkey % 10000 as string), 4, '0'), ', 39.', "
                    "lpad(cast(o_custkey % 10000 as string), 4, '0'))", "坐标", " "),
    ("ip", "concat('10.1.', cast(o_custkey % 256 as string), '.', cast(o_orderkey % 256 as string))",
     "IP ", " "),
    ("url", "concat('https://example.com/o/', cast(o_orderkey as string))", "访问 ", " "),
    ("date", "concat('2024-0', cast(1 + o_orderkey % 9 as string), '-1')", "日期 ", " "),
    ("amount", "concat('¥', cast(1 + o_orderkey % 900 as string), '.50')", "金额", " "),
    ("postcode", "cast(100000 + o_orderkey % 800000 as string)", "邮编", " "),
    ("passport", "concat('E', lpad(cast(o_orderkey % 100000000 as string), 8, '0'))", "护照 ", " "),
    ("ssn", "concat('123-45-', lpad(cast(o_orderkey % 10000 as string), 4, '0'))", "SSN ", " "),
    ("credit_code", "concat('91310000', lpad(cast(o_orderkey as string), 9, '0'), 'U')", "代码 ", " "),
    ("mac", "concat('00:1A:2B:3C:4D:', lpad(cast(o_orderkey % 100 as string), 2, '0'))", "MAC ", " "),
    ("api_key", "concat('sk-abcdefghij', lpad(cast(o_orderkey as string), 9, '0'))", "密钥 ", " "),
    ("hkmo_pass", "concat('C', lpad(cast(o_orderkey % 100000000 as string), 8, '0'))", "通行 ", " "),
    ("taiwan_pass", "concat('L', lpad(cast(o_orderkey % 100000000 as string), 8, '0'))", "台胞 ", " "),
    ("taiwan_id", "concat('A1', lpad(cast(o_orderkey % 100000000 as string), 8, '0'))", "证号 ", " "),
    ("org_code", "concat(lpad(cast(o_orderkey % 100000000 as string), 8, '0'), '-9')", "机构 ", " "),
    ("hkmo_resident", "concat('81', lpad(cast(o_orderkey as string), 16, '0'))", "居住 ", " "),
    ("military_id", "concat('军字第', lpad(cast(o_orderkey % 10000000 as string), 7, '0'), '号')", "", " "),
]
# written without the two entities that are switched off
GOLD_KEYS = [k for k, *_ in PII_PARTS if k not in ("hkmo_resident", "military_id")]
_PARTS_SQL = ", ".join(f"'{lead}', {value}, '{gap}'" for _, value, lead, gap in PII_PARTS)
PII_TEXT = f"select o_orderkey as doc_id, concat({_PARTS_SQL}) as text from {{orders}}"
_ON = [p for p in PII_PARTS if p[0] in GOLD_KEYS]
PII_TEXT_ON = (
    "select o_orderkey as doc_id, o_custkey, concat("
    + ", ".join(f"'{lead}', {value}, '{gap}'" for _, value, lead, gap in _ON)
    + ") as text from {orders}"
)

NAMES_TEXT = """
select o_orderkey as doc_id,
       concat(substr('赵钱孙李周吴郑王冯陈', 1 + cast(o_custkey % 10 as int), 1),
              substr('伟芳娜敏静丽强磊', 1 + cast(o_orderkey % 8 as int), 1),
              '，', case o_orderkey % 3 when 0 then '欧阳锋' when 1 then '司马光远' else '诸葛亮' end,
              '，在', case o_orderkey % 4 when 0 then '北京市' when 1 then '上海' when 2 then '西藏路'
                      else '河北省' end,
              '，', case o_orderkey % 5 when 0 then '联想有限公司' when 1 then '东南中心'
                     when 2 then '清华大学' when 3 then '华为技术有限公司' else '安全信息' end,
              '，编号', cast(o_orderkey as string)) as text
from {orders}
"""

ALL = {
    "audit": AUDIT, "vault": VAULT, "api_keys": API_KEYS, "requests": REQUESTS,
    "outcomes": OUTCOMES, "stat_updates": STAT_UPDATES, "stat_maps": STAT_MAPS, "pii_text": PII_TEXT,
    "pii_text_on": PII_TEXT_ON, "names_text": NAMES_TEXT,
}
_INPUT = re.compile(r"\{(\w+)\}")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"sha256\((\w+)\)", r"sha2(\1, 256)", ALL[name])
    inputs = {n: table(spark, sf_dir, n) for n in _INPUT.findall(sql)}
    if name.endswith("text") or name.endswith("text_on"):
        # texts are made of a few numbers of an order
        inputs = {n: spread(df, narrow=True) for n, df in inputs.items()}
    return spark.sql(sql, **inputs)


def check_sql(name: str) -> str:
    """The recipe for the checking engine."""
    return _INPUT.sub(r"\1", ALL[name])


def with_tables(*names: str) -> str:
    """``with a as (...), b as (...)`` for the checking engine."""
    return "with " + ", ".join(f"{n} as ({check_sql(n)})" for n in names)
