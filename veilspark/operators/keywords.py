"""Keyword dictionaries: every occurrence, or the longest ones only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.matchers import Matcher, trie_pattern
from veilspark.functions.rulepack import RulePack
from veilspark.functions.spans import scan_text
from veilspark.functions.text import lit
from veilspark.operators.detect import matches
from veilspark.operators.mask import mask
from veilspark.sources.tables import shared_folder

# Characters of a keyword that are looked up first, and of a text that are cut at once.
ANCHOR, CUT = 4, 256
# The same for a dictionary that is joined in place: a long text is cut in blocks and these in parts.
BLOCK, STEP = 8192, 64
# Up to this size, in words and in characters, a dictionary is joined in place.
SMALL_WORDS, SMALL_CHARS = 200_000, 4_000_000
# Characters that the beginnings of a larger dictionary may have, as many as leave no more than SMALL_WORDS of them.
LONGEST_ANCHOR = 12


def _stored(keywords: DataFrame) -> DataFrame:
    """The words of a dictionary, each once, written so that Spark knows their size."""
    path = shared_folder(keywords.sparkSession, "keywords")
    keywords.select("keyword").filter("length(keyword) > 0").distinct().selectExpr(
        "keyword", f"substr(keyword, 1, {ANCHOR}) as anchor", "length(keyword) as n").write.parquet(path)
    return keywords.sparkSession.read.parquet(path)


def keyword_matches(
    df: DataFrame, keys: list[str], keywords: DataFrame, text: str = "text",
) -> DataFrame:
    """All occurrences of all keywords, overlapping ones too: keys, keyword, start, end.

    The dictionary is written first, so its size is known.  Places of a text are
    looked up among the beginnings of the keywords (ANCHOR characters at most), the
    places left give strings in the lengths that keywords with that beginning have,
    and these are joined with the keywords.  A small dictionary is looked up where
    the text is, without a shuffle.  Of a larger one only the beginnings are, as long as few
    enough differ, and the strings left are shuffled; see ``_shuffled`` for one with more beginnings or long words.
    """
    words = _stored(keywords)
    longest, lengths, count, chars = words.selectExpr(
        "max(n)", "collect_set(length(anchor))", "count(*)", "sum(n)").first()
    if not longest:
        return df.select(*keys, F.lit("").alias("keyword"), F.lit(0).cast("long").alias("start"),
                         F.lit(0).cast("long").alias("end")).filter("false")
    texts = df.select(*keys, F.col(text).alias("__t")).filter("length(__t) > 0")
    if count <= SMALL_WORDS and chars <= SMALL_CHARS:
        found = _in_place(texts, keys, words, F.broadcast(words), longest, sorted(lengths))
    elif longest <= STEP and (begun := _begun(words)):
        found = _in_place(texts, keys, begun[0], words, longest, begun[1])
    else:
        found = _shuffled(texts, keys, words, longest, sorted(lengths))
    return found.selectExpr(
        *keys, "keyword", "cast(__at as bigint) as start", "cast(__at + n as bigint) as end")


def _begun(words: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """The words with the longest beginnings of which no more than SMALL_WORDS differ, and the lengths of these.

    The longer they are, the fewer strings of a text have to be compared with the words.
    """
    sizes = range(ANCHOR, LONGEST_ANCHOR + 1)
    few = words.agg(*[F.count_distinct(F.xxhash64(F.substring("keyword", 1, n))) for n in sizes]).first()
    fitting = [n for n, count in zip(sizes, few) if count <= SMALL_WORDS]
    if not fitting:
        return None
    begun = words.withColumn("anchor", F.substring("keyword", 1, max(fitting)))
    return begun, sorted(begun.selectExpr("collect_set(length(anchor))").first()[0])


def _in_place(
    texts: DataFrame, keys: list[str], words: DataFrame, looked_up: DataFrame, longest: int, lengths: list[int],
) -> DataFrame:
    """Places are rows only until their beginnings are looked up in the same task; no lambda runs once per place.

    Beginnings are looked up by a hash; the join with the keywords drops what it lets through.  ``looked_up`` are
    the keywords of that join, broadcast or not.
    """
    blocks = texts.select(*keys, F.expr(f"""inline(transform(
        sequence(0, (length(__t) - 1) div {BLOCK}),
        k -> named_struct('__block', k * {BLOCK}, '__b', substr(__t, k * {BLOCK} + 1, {BLOCK + longest - 1}))))"""))
    # with what a keyword that begins in a part may need beyond
    parts = blocks.select(*keys, "__block", F.expr(f"""inline(transform(
        sequence(0, (least({BLOCK}, length(__b)) - 1) div {STEP}),
        k -> named_struct('__from', k * {STEP}, '__part', substr(__b, k * {STEP} + 1, {STEP + longest - 1}))))"""))
    places = parts.select(
        *keys, "__block", "__from", "__part", F.expr(f"explode(sequence(1, least({STEP}, length(__part))))").alias("__i"))
    if len(lengths) > 1:
        places = places.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("__n"))
    else:
        places = places.withColumn("__n", F.lit(lengths[0]))
    begins = words.groupBy(F.xxhash64("anchor", F.length("anchor")).alias("__begin")).agg(F.collect_set("n").alias("__lengths"))
    hits = places.join(
        F.broadcast(begins), F.xxhash64(F.expr("substr(__part, __i, __n)"), F.col("__n")) == F.col("__begin"))
    strings = hits.select(
        *keys, F.expr("__block + __from + __i - 1").alias("__at"), "__part", "__i", F.explode("__lengths").alias("__n")
    ).select(*keys, "__at", "__n", F.expr("substr(__part, __i, __n)").alias("__word"))
    return strings.join(
        looked_up.select("keyword", "n"), (F.col("__word") == F.col("keyword")) & (F.col("__n") == F.col("n")))


def _shuffled(texts: DataFrame, keys: list[str], words: DataFrame, longest: int, lengths: list[int]) -> DataFrame:
    """For a dictionary of any size.

    Every place of a text is joined with the beginnings of the keywords, as numbers
    and those few characters alone.  The places that are left, by part of a text,
    pick what follows out of the text.  So no join carries a text along but the
    second, and that one each text once; Spark broadcasts the dictionary if its size
    allows, else both sides are shuffled.
    """
    # a hash tells parts of different texts under the same keys apart
    parts = texts.select(*keys, F.expr(f"""inline(transform(
        sequence(0, (length(__t) - 1) div {CUT}),
        k -> named_struct('__from', k * {CUT}, '__part', substr(__t, k * {CUT} + 1, {CUT + longest - 1}))))""")).withColumn(
        "__hash", F.xxhash64("__part"))
    part = [*keys, "__from", "__hash"]
    sizes = f"array({', '.join(map(str, lengths))})"
    places = parts.select(*part, F.expr(f"""inline(flatten(transform(sequence(1, least({CUT}, length(__part))),
        i -> transform(filter({sizes}, n -> i + n - 1 <= length(__part)),
                       n -> named_struct('__i', i, '__anchor', substr(__part, i, n))))))"""))
    begins = words.groupBy("anchor").agg(F.collect_set("n").alias("__lengths"))
    hits = places.join(begins, F.col("__anchor") == F.col("anchor")).groupBy(*part).agg(
        F.collect_set(F.struct("__i", "__lengths")).alias("__places"))
    hits = hits.select([F.col(c).alias(f"__of_{c}") for c in part] + ["__places"])
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in part]
    strings = parts.join(hits, on).select(*part, "__part", F.explode("__places").alias("__p")).select(
        *keys, F.expr("__from + __p.__i - 1").alias("__at"), "__part", "__p").select(
        *keys, "__at", F.expr("""explode(transform(filter(__p.__lengths, n -> __p.__i + n - 1 <= length(__part)),
            n -> substr(__part, __p.__i, n)))""").alias("__word"))
    return strings.join(words.select("keyword", "n"), F.col("__word") == F.col("keyword"))


def mask_with_dictionary(
    df: DataFrame, keys: list[str], keywords: DataFrame, text: str = "text", pack: RulePack = RulePack(),
) -> DataFrame:
    """``mask`` with a keyword table of any size; ``keys`` identify a text.

    Each text gets the places at which keywords occur in it, so no text is searched
    word by word; a hash tells texts under the same keys apart.  Only a dictionary
    with blanks around its words, which count without them, gives each text words
    to search for.
    """
    words = _stored(keywords).select("keyword")
    if not words.filter("keyword <> trim(keyword)").isEmpty():
        found = keyword_matches(df, keys, words, text).groupBy(*keys).agg(F.collect_set("keyword").alias("__own"))
        on = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys]
        joined = df.alias("__l").join(found.alias("__r"), on, "left").select("__l.*", "__r.__own")
        return mask(joined, text, pack, row_keywords="__own").drop("__own")
    if pack.keywords:
        words = words.unionByName(df.sparkSession.createDataFrame([(w,) for w in pack.keywords], "keyword string"))
    by = [*keys, "__text_hash"]
    known = df.withColumn("__text_hash", F.xxhash64(text))
    scanned = known.select(*by, F.expr(scan_text(text)).alias("__scanned"))
    found = keyword_matches(scanned, by, words, "__scanned").groupBy(*by).agg(
        F.collect_set(F.struct("start", "keyword")).alias("__own"))
    on = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in by]
    joined = known.alias("__l").join(found.alias("__r"), on, "left").select("__l.*", "__r.__own").drop("__text_hash")
    return mask(joined, text, pack, row_places="__own").drop("__own")


def longest_keywords(df: DataFrame, keys: list[str], words: list[str], text: str = "text") -> DataFrame:
    """Leftmost, longest occurrences that do not overlap."""
    return matches(df, keys, text, Matcher("custom", lit(trie_pattern(words)), 0, 0)).select(
        *keys, F.col("value").alias("keyword"), "start", "end"
    )


def ranked_matches(found: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of a text in one array, longest first, then by position."""
    entry = F.struct((-F.length("keyword")).alias("n"), "start", "keyword")
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("m")).select(
        *keys, F.expr("transform(m, x -> named_struct('start', x.start, 'keyword', x.keyword))")
        .alias("matches"),
    )
