"""License texts in documents by voting of word-gram matches along diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged
from veilspark.llm.octets import LOWER, WORD, Rolling, joined, mixed, pieces, text_buffers, word_spans

#: Words of a gram.
GRAM = 2
#: Diagonals at most so far apart belong to one span: words put in or left out.
GAP = 2
#: Grams in order that a span must have, as a share of the grams of the template or of the span, whichever has more.
COVER = 0.75

# The phrases whose exact places are counted, with their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Longer passages that the method finds also with small changes.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties"
     " of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
     " software", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
     " basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
     " as published by the free software foundation", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty"
     " of merchantability or fitness for a particular purpose", "gpl"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
     " derived from this software without specific prior written permission", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
     " disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
]

_BREAKS = ~WORD[LOWER]


def _words(octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word."""
    return mixed(Rolling(octets)(start, end) + (end - start).astype(np.uint64))


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each gram."""
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]).view(np.int64)


def template_rows(phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> list[tuple]:
    """(hash, template, position, grams, base, label) of every gram of every template."""
    rows = []
    for number, (text, label) in enumerate(phrases + templates):
        octets = LOWER[np.frombuffer(text.encode() + b" ", np.uint8)]
        grams = _pairs(_words(octets, *word_spans(octets))).tolist()
        if not grams:
            raise ValueError("a template has 2 words at least")
        rows += [(g, number, i, len(grams), number < len(phrases), label) for i, g in enumerate(grams)]
    return rows


def grams(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rolling gram hashes of each text, or of about 1 MB of it, as one row.

    ``__key`` is a hash of the text, ``__begins`` tells the first part of a text,
    ``__upto`` counts its words so far, ``__first`` is the number of the first
    gram.  Each list ends with one element that is no gram.
    """
    docs = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__key"))
    schema = (f"__id {docs.schema['__id'].dataType.simpleString()}, __key long, __begins int, __upto long,"
              " __first long, __grams array<long>")
    names = ["__id", "__key", "__begins", "__upto", "__first", "__grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(1))
            before, count, tail = -1, 0, np.zeros(0, np.uint64)
            for held in pieces(data, ends, _BREAKS):
                octets, at = joined(data, held)
                octets = LOWER[octets]
                start, end = word_spans(octets)
                words = _words(octets, start, end)
                cut = np.searchsorted(start, at)
                rows, begins, upto, first, lists = [], [], [], [], []
                for n, (row, _, _) in enumerate(held):
                    begins.append(int(row != before))
                    if row != before:
                        before, count, tail = row, 0, tail[:0]
                    own = np.concatenate([tail, words[cut[n]:cut[n + 1]]])
                    rows.append(row)
                    first.append(count - len(tail))
                    count += len(own) - len(tail)
                    upto.append(count)
                    lists.append(np.append(_pairs(own), 0))
                    tail = own[len(own) - min(len(own), GRAM - 1):].copy()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(begins, pa.int32()),
                     pa.array(upto, pa.int64()), pa.array(first, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))], names=names)

    return docs.mapInArrow(run, schema)


def scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All gram hashes of all documents are joined with the template positions, a
    written table of a few hundred rows.  Matches vote for their diagonal,
    document position minus template position.  A phrase is found where one
    diagonal has all its grams.  For a longer template the votes of diagonals at
    most GAP to either side are put together, and the span is verified: the longest
    run of matches in which both positions rise must make up COVER of the grams of
    the template, and of the span from its first to its last.  Scans are not
    shuffled, only votes are.

    ``score`` is the best such share of any template that counts, 0 if none does.
    Null texts are empty.  Repeated rows give a result row each; rows that share
    an id but not a text are told apart by a hash of the text.
    """
    spark = docs.sparkSession
    values = ", ".join(
        f"({h}L, {t}, {i}, {n}, {str(b).lower()}, '{label}')" for h, t, i, n, b, label in template_rows(phrases, templates))
    positions = staged(spark.sql(f"select * from values {values} as t(h, template, place, size, base, label)"), "templates")
    rows = grams(docs, id, text).selectExpr(
        "__id", "__key", "__begins", "__upto", "__first", "size(__grams) - 1 as __n", "posexplode(__grams) as (__p, __h)")
    hit = rows.join(positions, (F.col("__h") == F.col("h")) & (F.col("__p") < F.col("__n")), "left").where(
        "__p = __n or template is not null")
    key = ["__id", "__key"]
    votes = hit.groupBy(*key, "template", "size", "base", "label", F.expr(
        "if(template is null, null, __first + __p - place)").alias("diagonal")).agg(
        F.collect_set("place").alias("places"),
        F.max(F.expr("if(template is null, __upto, null)")).alias("words"),
        F.sum(F.expr("if(template is null, __begins, 0)")).alias("copies"))
    votes = votes.withColumn("near", F.expr(
        f"""collect_list(struct(diagonal, places)) over (partition by __id, __key, template order by diagonal
            range between {GAP} preceding and {GAP} following)"""))
    pairs = """array_sort(flatten(transform(near, x -> transform(x.places, p -> struct(x.diagonal + p as pos, p as place)))))"""
    votes = votes.withColumn("pairs", F.expr(f"if(base or template is null, null, {pairs})"))
    # for every match the longest rising run that ends there, and the latest place where such a run begins
    longest = """coalesce(array_max(transform(filter(acc, y -> y.pos < x.pos and y.place < x.place),
        y -> struct(y.n as n, y.first as first))), struct(0 as n, x.pos as first))"""
    runs = f"""aggregate(pairs, cast(array() as array<struct<pos:bigint,place:int,n:int,first:bigint>>),
        (acc, x) -> concat(acc, transform(array({longest}), b -> struct(x.pos as pos, x.place as place, b.n + 1 as n, b.first as first))))"""
    best = f"""array_max(transform({runs}, y -> struct(y.n / greatest(size, y.pos - y.first + 1) as cover, y.first as start)))"""
    found = votes.withColumn("best", F.expr(f"""case when base then struct(size(places) / size as cover, diagonal as start)
        when size(pairs) >= {COVER} * size then {best} end""")).selectExpr(
        *key, "template", "base", "label", "words", "copies", "best.cover", "best.start").where(
        f"template is null or cover >= if(base, 1.0, {COVER})")
    of_base = F.expr("if(base, start, null)")
    out = found.groupBy(*key).agg(
        F.max("words").alias("n_words"), F.count(of_base).alias("n_base"), F.min(of_base).alias("first_word"),
        F.max(of_base).alias("last_word"), F.collect_set(F.expr("if(base, label, null)")).alias("b"),
        F.collect_set("label").alias("l"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.expr("if(template is null, null, struct(start, template, cover))"))).alias("spans"),
        F.max("copies").alias("copies"))
    return out.selectExpr(
        f"__id as {id}", "n_words", "n_base", "first_word", "last_word", "array_join(array_sort(b), ',') as base_labels",
        "array_join(array_sort(l), ',') as labels", "score", "spans", "explode(array_repeat(0, cast(copies as int))) as __copy",
    ).drop("__copy")
