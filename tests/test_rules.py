"""Example texts per rule, and the interplay of rules."""

import re

import random

import pytest

from veilspark import CustomRule, RulePack, mask, restore
from veilspark.functions import rulepack

PHONE = "13812345678"
# (text, {entity: value that must be masked})
EXAMPLES = [
    ("我的手机号是13812345678，请联系我", [("phone", PHONE)]),
    ("邮箱test@example.com", [("email", "test@example.com")]),
    ("身份证号110101199001011234", [("idcard", "110101199001011234")]),
    ("银行卡4111111111111111", [("bankcard", "4111111111111111")]),
    ("卡号13812345678", [("phone", PHONE)]),
    ("车牌号是京A12345", [("plate", "京A12345")]),
    ("IP是192.168.1.1", [("ip", "192.168.1.1")]),
    ("256.1.1.1", [("ip", "56.1.1.1")]),
    ("访问 https://example.com/page 查看", [("url", "https://example.com/page")]),
    ("日期是2024-01-15", [("date", "2024-01-1")]),
    ("金额¥1,234.56元", [("amount", "¥1,234.56")]),
    ("$1234", [("amount", "$123")]),
    ("邮编100081", [("postcode", "100081")]),
    ("护照E12345678", [("passport", "E12345678")]),
    ("SSN123-45-6789", [("ssn", "123-45-6789")]),
    ("信用代码91310000306245892U", [("credit_code", "91310000306245892U")]),
    ("MAC00:1A:2B:3C:4D:5E", []),
    ("MAC 00:1a:2B:3C:4D:5E", [("mac", "00:1a:2B:3C:4D:5E")]),
    ("坐标116.4074, 39.9042", [("coordinates", "116.4074, 39.9042")]),
    ("sk-abcdefghijklmnop1", [("api_key", "sk-abcdefghijklmnop1")]),
    ("C12345678 L12345678 A123456789 12345678-9",
     [("hkmo_pass", "C12345678"), ("taiwan_pass", "L12345678"), ("taiwan_id", "A123456789"),
      ("org_code", "12345678-9")]),
    ("军字第123456号", [("postcode", "123456")]),
    ("张三和李四一起去了北京", []),
    ("这是一段普通文本没有敏感信息", []),
    ("12345678901234567", []),  # 17 digits that fail the check digit
    ("１３８１２３４５６７８ is not", []),
    ("北京A12345X", [("plate", "京A12345X")]),
    ("a@b.cc_x@y.zz", [("email", "a@b.cc"), ("email", "_x@y.zz")]),
    ("", []),
]


@pytest.fixture(scope="module")
def masked(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXAMPLES)], "id int, text string")
    return {r.id: r for r in restore(mask(df)).collect()}


@pytest.mark.parametrize("i", range(len(EXAMPLES)))
def test_example(masked, i):
    text, want = EXAMPLES[i]
    row = masked[i]
    got = [(m.entity_type, m.value) for m in row.mappings]
    assert got == want
    assert row.restored == text
    for key, value in want:
        assert value not in row.masked
    assert sum(row.stats.values()) == len(want)


def one(spark, text, pack=RulePack(), **kw):
    return mask(spark.createDataFrame([(text,)], "text string"), "text", pack, **kw).first()


def test_keywords_longest_wins(spark):
    pack = RulePack().with_keywords(["app", "apple", "application"])
    assert one(spark, "I have an application", pack).masked == "I have an [PII_CUSTOM_A]"


def test_keyword_inside_url_is_covered_by_it(spark):
    pack = RulePack().with_keywords(["example"])
    row = one(spark, "see https://example.com/x now", pack)
    assert row.masked == "see [PII_URL_A] now"
    assert row.mappings[0].value == "https://example.com/x"


def test_private_use_characters_survive(spark):
    text = "a 13812345678  https://x.y/z "
    df = restore(mask(spark.createDataFrame([(text,)], "text string")))
    row = df.first()
    assert row.restored == text
    assert [m.value for m in row.mappings] == ["13812345678", "https://x.y/z"]


def test_custom_rule_and_switches(spark):
    rule = CustomRule("card", r"\d{4}-\d{4}-\d{4}-\d{4}", "bankcard")
    pack = RulePack().with_rules([rule])
    text = "My card: 4111-1111-1111-1111"
    assert one(spark, text, pack).masked == "My card: [PII_BANKCARD_A]"
    assert one(spark, text, pack.toggle_rule("card", False)).masked == text
    assert one(spark, text, pack.without_rules(["card"])).masked == text
    assert pack.with_rules([rule]).rules == pack.rules
    for bad in (CustomRule("x", "(", "phone"), CustomRule("y", "a", "nothing")):
        with pytest.raises(ValueError):
            pack.with_rules([bad])


def test_strict_cards(spark):
    text = "6222000000000001"
    assert one(spark, text).stats == {"bankcard": 1}
    assert one(spark, text, RulePack(card_luhn="strict")).stats == {}


def test_names_when_enabled(spark):
    pack = RulePack().enable("person", "location", "organization")
    row = one(spark, "张三，清华大学", pack)
    assert [(m.entity_type, m.value) for m in row.mappings][0] == ("person", "张三")
    assert "清华大学" not in row.masked


def test_many_repeats(spark):
    row = one(spark, "手机13812345678，" * 500)
    assert row.stats == {"phone": 500}
    assert "138" not in row.masked


def test_disabled_entity_stays(spark):
    assert one(spark, "IP 1.2.3.4", RulePack().disable("ip")).masked == "IP 1.2.3.4"


def test_row_keywords(spark):
    df = spark.createDataFrame([("a+b c", [" a+b ", ""]), ("a+b c", None)], "text string, kw array<string>")
    assert [r.masked for r in mask(df, row_keywords="kw").collect()] == ["[PII_CUSTOM_A] c", "a+b c"]


def test_row_keywords_like_an_alternation(spark):
    """Keywords of a row, overlapping themselves and each other, against one pattern per row."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("aabx中.") for _ in range(rng.randrange(n)))
    rows = [(i, say(40), [say(4) for _ in range(rng.randrange(5))]) for i in range(300)]
    df = mask(spark.createDataFrame(rows, "id int, text string, kw array<string>"), pack=RulePack(entity_stage=False).only(), row_keywords="kw")
    assert "RegExpReplace" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        words = sorted({k for k in r.kw if k}, key=lambda k: (-len(k), k))
        want = [m.span() for m in re.finditer("|".join(map(re.escape, words)), r.text)] if words else []
        assert [(m.start, m.end) for m in r.mappings] == want


def test_same_rows_however_split(spark):
    df = spark.range(200).selectExpr(
        "id", "concat('tel ', 13000000000 + id, ' ip 10.0.0.', id % 256) as text"
    )
    a = sorted(map(tuple, mask(df.repartition(1)).select("id", "masked").collect()))
    b = sorted(map(tuple, mask(df.repartition(8)).select("id", "masked").collect()))
    assert a == b


def test_filter_on_result_does_not_explode_plan(spark):
    df = mask(spark.createDataFrame([("x 13812345678",), ("y",)], "text string"))
    assert df.filter("size(mappings) > 0 and masked like 'x%'").count() == 1


def test_patterns_are_judged_by_the_jvm(spark):
    cases = {"(?P<a>x)(?P=a)": True, "(?P<a>x)(?P=b)": False, "(": False, "a+": True, "(a)?(?(1)b|c)": False,
             r"\d{3}(?<!x)": True, "[": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.ok for r in df.selectExpr("p", rulepack.compiles_sql("p") + " as ok").collect()}
    assert got == cases == {p: rulepack.compiles(p) for p in cases}
