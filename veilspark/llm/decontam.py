"""Benchmark decontamination by winnowed fingerprints; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import bind
from veilspark.llm.common import staged

#: Words that must agree in a row.
SPAN = 13
#: Words of a fingerprinted gram.  Of every WINDOW = SPAN + 1 - GRAM grams in a row the
#: smallest hash is kept, so each shared span of SPAN words keeps a shared gram.
GRAM = 6
WINDOW = SPAN + 1 - GRAM
#: Words of a long text that are handled together.
PART = 1 << 16
#: Fixed values of the contract: what stands between words, once A-Z are lower-cased, and what words are made of (upper case too).
NOT_WORD, A_WORD = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
#: A document is contaminated if this share of its words or more is hit.
SHARE = 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _words(text: str) -> str:
    """The array of words of a text, as SQL."""
    cut = f"split({text}, '{NOT_WORD}+')"
    # only the first and the last can be empty
    return bind(cut, "c", "slice(c, if(c[0] = '', 2, 1), greatest(0, size(c) - if(c[0] = '', 1, 0) - if(element_at(c, -1) = '', 1, 0)))")


def _parts(text: str) -> str:
    """A text in parts of PART words each, but for the last; a short one is a single part."""
    pattern = f"\\\\G{NOT_WORD}*+(?:{A_WORD}++{NOT_WORD}*+){{1,{PART}}}+"
    return f"if(octet_length({text}) < {2 * PART}, array({text}), regexp_extract_all({text}, '{pattern}', 0))"


def with_words(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows of keys, ``__part``, ``__own`` (words that begin in the part), and ``__words``.

    A part holds the first SPAN - 1 words of the next one as well, so every run of
    SPAN words lies whole in the part where it begins.  Null has one part without words.
    """
    head = f"regexp_extract(__parts[p + 1], '^{NOT_WORD}*+(?:{A_WORD}++{NOT_WORD}*+){{1,{SPAN - 1}}}+', 0)"
    cut = df.selectExpr(*keys, f"coalesce({text}, '') as __text").selectExpr(*keys, f"{_parts('__text')} as __parts")
    cut = cut.selectExpr(*keys, f"""posexplode(if(size(__parts) < 2, __parts, transform(__parts, (x, p) ->
        if(p = size(__parts) - 1, x, concat(x, ' ', {head}))))) as (__part, __piece)""")
    cut = cut.withColumn("__piece", lowered(F.col("__piece"))).withColumn("__words", F.expr(_words("__piece")))
    # only a last part may hold fewer words than begin in it
    return cut.withColumn("__own", F.expr(f"least(size(__words), {PART})")).drop("__piece")


def _winnowed(df: DataFrame) -> DataFrame:
    """From ``__h`` (word hashes) to ``__kept``: hash bits and position of each selected gram.

    Grams of 2, 4 and 6 words and minima over 2, 4 and 8 grams are built by
    pairing an array with itself shifted.  The position in the low bits makes
    the leftmost of equal hashes the smallest, on either side alike.
    """
    n = "size(__h)"
    steps = {
        "__g2": "zip_with(__h, slice(__h, 2, greatest(size(__h) - 1, 0)), (a, b) -> xxhash64(a, b))",
        "__g4": "zip_with(__g2, slice(__g2, 3, greatest(size(__g2) - 2, 0)), (a, b) -> xxhash64(a, b))",
        "__g6": "zip_with(__g4, slice(__g2, 5, greatest(size(__g2) - 4, 0)), (a, b) -> xxhash64(a, b))",
        "__v": f"transform(slice(__g6, 1, greatest({n} - {GRAM - 1}, 0)),"
               " (g, i) -> shiftleft(g, 31) | cast(i as bigint))",
        "__m2": "zip_with(__v, slice(__v, 2, size(__v)), (a, b) -> least(a, b))",
        "__m4": "zip_with(__m2, slice(__m2, 3, size(__v)), (a, b) -> least(a, b))",
        "__m8": "zip_with(__m4, slice(__m4, 5, size(__v)), (a, b) -> least(a, b))",
    }
    for name, step in steps.items():
        df = df.withColumn(name, F.expr(step))
    whole = f"slice(__m8, 1, greatest({n} - {SPAN - 1}, 0))"
    return df.withColumn("__kept", F.expr(f"array_distinct({whole})")).drop(*steps)


def _prints(df: DataFrame, short: list[int]) -> DataFrame:
    """From ``__words`` to ``__prints``: selected grams with the word hashes around them, from ``lo`` on.

    ``kind`` is SPAN for winnowed grams.  An item of fewer words is found by its
    first two (``kind`` 2, or 1 if it is a single word), and ``around`` holds the
    words from there on.
    """
    df = _winnowed(df.withColumn("__h", F.expr("transform(__words, w -> xxhash64(w))")))
    pos = "cast(v & 2147483647L as int)"
    lists = [
        f"""transform(__kept, v -> named_struct('kind', {SPAN}, 'fp', shiftright(v, 31), 'pos', {pos},
              'lo', greatest({pos} - {WINDOW - 1}, 0),
              'around', slice(__h, greatest({pos} - {WINDOW - 1}, 0) + 1, {pos} + {SPAN} - greatest({pos} - {WINDOW - 1}, 0))))"""
    ] + [
        f"""transform(if(size(__h) >= {m}, sequence(0, size(__h) - {m}), array()),
              i -> named_struct('kind', {m}, 'fp', xxhash64(slice(__h, i + 1, {m})), 'pos', i, 'lo', i,
                                'around', slice(__h, i + 1, {min(max(short), SPAN - 1)})))"""
        for m in sorted({min(m, 2) for m in short})
    ]
    return df.withColumn("__prints", F.expr(f"concat({', '.join(lists)})")).drop("__h", "__kept")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in 13 words in a row that occur in an item (or in
    the whole of a shorter item).  Selected grams of documents are joined with
    those of the items; each match is extended to all spans through it by
    comparing the words around it.  Documents are read once and not shuffled:
    per document only matches and count rows leave the scan.  The item side
    is a written table, so Spark broadcasts it if its size allows and joins by
    a shuffle beyond that.

    Texts are handled in parts of PART words, so a text may be of any length.
    Null and empty texts have no words, are not contaminated and stay in the
    result; items without words match nothing; null item ids mark words but are
    not counted as items.  Repeated rows give a result row each; rows that share
    an id but not a text are told apart by a hash of the text.
    """
    return _judged(docs, benchmark, id, text, item, item_text).drop("__key")


def _judged(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``contamination`` with ``__key``, the hash of the text."""
    items = benchmark.select(F.col(item).alias("__item"), F.col(item_text).alias("__t"))
    items = staged(with_words(items, "__t", ["__item"]).where("size(__words) > 0"), "items")
    sizes = items.where("__part = 0").groupBy(F.size("__words").alias("n")).count().where(f"n < {SPAN}")
    short = sorted(r.n for r in sizes.collect())  # at most SPAN - 1 rows
    marks = _prints(items, short).selectExpr("__item", "__part", "size(__words) n", "inline(__prints)").where(
        f"kind = {SPAN} or __part = 0 and n < {SPAN} and pos = 0 and kind = least(n, 2)").selectExpr(
        "__item", f"if(kind = {SPAN}, {SPAN}, n) size", "kind ikind", "fp ifp", "pos ipos", "lo ilo",
        f"if(kind = {SPAN}, around, slice(around, 1, n)) iaround")
    marks = staged(marks, "marks")

    cut = docs.select(F.col(id).alias("__id"), F.col(text).alias("__t"), F.xxhash64(text).alias("__key"))
    # one row more per part carries its word count; its kind is 0, which joins nothing
    rows = _prints(with_words(cut, "__t", ["__id", "__key"]), short).selectExpr(
        "__id", "__key", "__part",
        "inline(concat(array(named_struct('kind', 0, 'fp', xxhash64(__id, __key, __part), 'pos', __own, 'lo', 0,"
        " 'around', cast(array() as array<bigint>))), __prints))")
    joined = rows.join(marks, (F.col("kind") == F.col("ikind")) & (F.col("fp") == F.col("ifp")), "left")
    # starts of the spans through the gram that agree, relative to it: always neighbours
    agree = f"""case when ikind = {SPAN} then filter(
        sequence(greatest(lo - pos, ilo - ipos), 0),
        o -> size(slice(around, pos + o - lo + 1, {SPAN})) = {SPAN}
             and slice(around, pos + o - lo + 1, {SPAN}) = slice(iaround, ipos + o - ilo + 1, {SPAN}))
      when ikind is not null and slice(around, 1, size) = iaround then array(0) end"""
    hits = joined.where("kind = 0 or ikind is not null").select("*", F.expr(agree).alias("__o")).where(
        "kind = 0 or size(__o) > 0").selectExpr(
        "__id", "__key", "if(kind = 0, pos, null) words", "kind = 0 and __part = 0 as whole", "__item",
        f"""if(kind = 0, null, struct(__part * {PART}L + pos + array_min(__o) as a,
            __part * {PART}L + pos + array_max(__o) + size as b)) span""")
    found = hits.groupBy("__id", "__key").agg(
        F.sum("words").alias("words"), F.count_if("whole").alias("copies"),
        F.collect_set("span").alias("spans"), F.collect_set("__item").alias("items"))
    covered = """aggregate(array_sort(spans), struct(0L as upto, 0L as n),
        (s, x) -> struct(greatest(s.upto, x.b) as upto,
                         s.n + greatest(0L, x.b - greatest(s.upto, x.a)) as n), s -> s.n)"""
    return found.selectExpr(
        f"__id as {id}", "__key", "words div copies as n_words", f"{covered} as n_hit",
        "cast(size(items) as bigint) as n_items",
        "sha2(array_join(array_sort(transform(items, x -> cast(x as string))), ','), 256) as items_sha256",
        "explode(array_repeat(0, cast(copies as int))) as __copy",
    ).drop("__copy").withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop contaminated documents; everything else stays as it is.

    A document is known by its id and the hash of its text, nulls included: a
    clean text that shares its id with a contaminated one stays, and a
    contaminated text without an id goes.
    """
    bad = _judged(docs, benchmark, id, text).where("contaminated")
    bad = staged(bad.select(F.col(id).alias("__bad"), F.col("__key").alias("__badkey")).distinct(), "bad")
    same = docs[id].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text]) == bad["__badkey"])
    return docs.join(bad, same, "left_anti")
