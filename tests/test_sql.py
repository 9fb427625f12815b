from veilspark.functions.sql import register
from veilspark.operators.detect import closed


def test_sql_functions(spark):
    names = register(spark)
    assert "pii_find_phone" in names
    row = spark.sql("""
        select pii_restore('a [PII_PHONE_A] [PII_IP_B]', map('[PII_PHONE_A]', '1')) as r,
               pii_find_phone(t) as f, pii_find_bankcard(t) as b, pii_token('[PII_BANKCARD_A]') as k,
               pii_alpha_id(id + 27) as a, pii_compliance('credit_code') as c
        from (select id, concat('tel ', 13812345678 + id, ' card 4111111111111111 4111111111111112') as t
              from range(1))""").first()
    assert row.r == "a 1 [PII_IP_B]" and row.f == ["13812345678"] and row.b == ["4111111111111111"]
    assert (row.k, row.a, row.c) == ("PII_BANK", "AA", "important_data")


def test_deep_bindings_stay_cheap(spark):
    """A row costs the same for every level of binding, and does not double with each."""
    steps = [{f"__v{i}": f"__v{i - 1} + 1L" if i else "id"} for i in range(40)]
    got = spark.range(1000).selectExpr(f"{closed(steps, '__v39', 'bigint')} as v").agg({"v": "sum"})
    assert got.first()[0] == sum(i + 39 for i in range(1000))
