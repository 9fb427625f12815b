"""Replies: how the work is dealt out, and texts at other depths."""

from veilspark.operators import nested
from veilspark.plans.registry import QUERIES


def test_replies_use_all_cores(spark, sf_dir):
    assert QUERIES["restore_reply"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_reply_below_the_depth_of_texts(spark):
    deep = '{"choices":[{"message":{"x":{"content":"[PII_P_A]"},"content":"[PII_P_A]","y":[["]",{"content":"[PII_P_A]"}]]}}]}'
    df = spark.createDataFrame([(deep, {"[PII_P_A]": "v"})], "body string, m map<string,string>")
    assert nested.restore_reply(df, "body", "m").first().restored == deep.replace(
        '},"content":"[PII_P_A]"', '},"content":"v"')
