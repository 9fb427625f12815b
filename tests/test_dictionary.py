"""Dictionaries joined in place, shuffled, and through masking."""

from collections import Counter

import pytest

from veilspark.functions.rulepack import RulePack
from veilspark.operators import keywords
from veilspark.operators.mask import mask

WORDS = ["ab", "abc", "abcdefgh", "token", "tokenabc", "the", "there", "x", "aa", "aaaa", "价格表格", "end"]
# blocks are 8,192 characters and parts 64: words lie across both, and a longer keyword is cut off by the end
LONG = "".join(f"the{i} " for i in range(1700)) + "-" * 21 + "tokenabc aaaaa 价格表格 😀there" + "abcdefgh" * 20 + " token"
ROWS = [(1, LONG), (1, LONG), (1, "there is another"), (None, "the end"), (2, ""), (3, None), (4, "y" * 8190 + "token" + "y" * 62 + "abcdefgh")]


def places(rows, words):
    return Counter((k, w, i, i + len(w)) for k, t in rows for w in words for i in range(len(t or "")) if t.startswith(w, i))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "id int, text string")


def dictionary(spark, words):
    return spark.createDataFrame([(w,) for w in words], "keyword string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [200_000, 0])
def test_both_ways_find_every_place(spark, texts, monkeypatch, small):
    monkeypatch.setattr(keywords, "SMALL_WORDS", small)
    found = keywords.keyword_matches(texts, ["id"], dictionary(spark, WORDS))
    assert Counter(map(tuple, found.collect())) == places(ROWS, WORDS)


def test_small_dictionary_is_looked_up_without_a_shuffle(spark, texts):
    found = plan(keywords.keyword_matches(texts, ["id"], dictionary(spark, WORDS)))
    assert found.count("Generate explode(sequence") == 1
    assert "SortMergeJoin" not in found and "flatten" not in found and "collect_set(struct" not in found


def test_masking_takes_the_places_and_searches_no_text(spark, texts):
    pack = RulePack().with_keywords(["another"])
    masked = keywords.mask_with_dictionary(texts, ["id"], dictionary(spark, WORDS), pack=pack)
    assert "replace(" not in plan(masked).replace("regexp_replace(", "")
    own = texts.selectExpr("*", "array(" + ", ".join(f"'{w}'" for w in WORDS) + ") as kw")
    expected = mask(own, pack=pack, row_keywords="kw").drop("kw")
    assert masked.columns == expected.columns
    rows = [sorted(map(str, df.selectExpr("id", "text", "masked", "mappings").collect())) for df in (masked, expected)]
    assert rows[0] == rows[1]


def test_words_with_blanks_around_count_without_them(spark):
    df = spark.createDataFrame([(1, "a word and words"), (2, "words")], "id int, text string")
    masked = keywords.mask_with_dictionary(df, ["id"], dictionary(spark, [" word "])).orderBy("id")
    assert [len(r.mappings) for r in masked.collect()] == [2, 0]


def test_large_dictionary_looks_its_beginnings_up_in_place(spark, texts, monkeypatch):
    """More words than may be broadcast, but not more beginnings: no place of a text is shuffled."""
    monkeypatch.setattr(keywords, "SMALL_WORDS", 11)
    found = keywords.keyword_matches(texts, ["id"], dictionary(spark, WORDS))
    assert "flatten" not in plan(found) and "collect_set(struct" not in plan(found)
    assert Counter(map(tuple, found.collect())) == places(ROWS, WORDS)
