"""Repeated word runs against all windows of all documents."""

import hashlib
import random
import re

import numpy as np
import pytest
from data import documents

from veilspark.llm import queries, substrings


def plain(rows):
    """Every 13-word window of every document, by brute force."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for s in range(len(words) - 12):
            if i is not None:
                key = tuple(words[s:s + 13])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - 12):
            if i is not None and least[tuple(words[s:s + 13])] < i:
                gone |= set(range(s, s + 13))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_cover_holds_every_difference():
    for shift in range(substrings.PERIOD):
        assert any((i + shift) % substrings.PERIOD in substrings.COVER for i in substrings.COVER)
    assert substrings.PERIOD + substrings.ANCHOR - 1 == substrings.SPAN


@pytest.mark.parametrize("shift", range(15))
def test_every_alignment_is_found(spark, shift):
    """Exactly 13 shared words, shifted against each other in every way."""
    run = " ".join(f"r{i}" for i in range(13))
    rows = [(1, " ".join(f"a{i}" for i in range(20)) + " " + run + " tail"),
            (2, " ".join(f"b{i}" for i in range(shift)) + " " + run + " end of it"),
            (3, " ".join(f"c{i}" for i in range(shift)) + " " + " ".join(run.split()[:12]) + " no")]
    got = result(substrings.repeats(documents(spark, rows)))
    assert got == plain(rows) and [r[2] for r in got] == [0, 13, 0]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op11_substrings(spark, sf_dir)) == plain(rows)


def rows_of_chance(seed, n):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(10, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(5)):
            words.append(rnd.choice([rnd.choice(passages), " ".join(rnd.choice("xyzé") for _ in range(rnd.randrange(30))), "one two"]))
        rows.append((rnd.choice([i, i, i, i // 2, None, -i]), rnd.choice([" ", "\n", "\t \x0b"]).join(words)))
    return rows + [(500, None), (501, ""), (502, " \t\n "), (503, "word " * 5000), (504, "word " * 13), (505, " x " * 20)]


@pytest.mark.parametrize("size", [200, 8 << 20])
def test_odd_rows(spark, monkeypatch, size):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; many chunks and buckets, or one."""
    monkeypatch.setattr(substrings, "CHUNK", size)
    monkeypatch.setattr(substrings, "BUCKET", max(size, 3000))
    rows = rows_of_chance(1, 120)
    rows += rows[:30]
    df = documents(spark, rows, clash=True)
    found = substrings.repeats(df.repartition(3))
    assert result(found) == plain(rows)
    spans = {(r.doc_id, r.n_removed): r.removed for r in found.where("n_removed > 0").collect()}
    assert spans and all(sum(s.end - s.start for s in v) == n for (_, n), v in spans.items())


def test_texts_without_repeats(spark):
    rows = [(i, t) for i, (_, t) in enumerate(rows_of_chance(2, 60))]
    df = documents(spark, rows, clash=True)
    back = {r.doc_id: r.text for r in substrings.without_repeats(df).collect()}
    want = {r[0]: r[2:] for r in plain(rows)}
    for i, text in rows:
        words = " ".join(re.findall(r"[^\x20\x09-\x0D]+", back[i] or ""))
        assert hashlib.sha256(words.encode()).hexdigest() == want[i][1]
        assert want[i][0] or back[i] == text
    assert substrings.without_repeats(df).columns == df.columns


def test_one_long_text(spark, monkeypatch):
    """A text of many parts that repeats another from its middle on."""
    rnd = np.random.default_rng(5)
    words = [f"w{x}" for x in rnd.integers(0, 1 << 40, 60_000)]
    rows = [(1, " ".join(words)), (2, "new " + " ".join(words[30_000:]) + " new"), (3, " ".join(words[100:112]))]
    assert result(substrings.repeats(documents(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert substrings.repeats(documents(spark, [(1, "x")]).where("false")).collect() == []
