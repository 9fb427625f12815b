"""Toxicity, quality and language on invented text."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from data import documents
from veilspark.llm import langid, quality, toxicity
from veilspark.llm.octets import text_buffers

SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "sol", "ben", "dar"]


def say(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def toxic_sample(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        w = say(rng, 60).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumf", "zwick" + rng.choice(SYLLABLES)]))
        out.append((" ".join(w), int(i % 3 == 0)))
    return out


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "!!"), (904, "ka"), (904, "ka"), (None, "ka lo"), (905, "é" * 50)]


def test_forward_backward_like_all_paths():
    rng = np.random.default_rng(3)
    t, start = np.exp(rng.normal(size=(2, 2))), 0.3
    unary = np.exp(rng.normal(size=(6, 4)))
    lengths = [6, 5, 1, 3]
    valid = np.arange(6)[:, None] < np.array(lengths)
    ahead, back = toxicity.marginals(unary, valid, t, start)
    for c, n in enumerate(lengths):
        mass = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = start if path[0] else 1.0
            for i, y in enumerate(path):
                w *= (unary[i, c] if y else 1.0) * (t[path[i - 1], y] if i else 1.0)
            for i, y in enumerate(path):
                mass[i, y] += w
        assert np.allclose((ahead * back)[:n, c], mass[:, 1] / mass[:, 0])


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.fit(toxic_sample(450, 1))


def test_toxicity(spark, toxic_model):
    fresh = toxic_sample(150, 2)
    rows = [(i, t) for i, (t, _) in enumerate(fresh)]
    long = say(random.Random(4), 3_000)  # in parts
    rows += EDGES + [(950, long), (951, long + " grumf " + long[:40])]
    df = documents(spark, rows, True)
    out = toxicity.score(df, toxic_model)
    assert out.columns == [c for c in df.columns if c != "toxic_score"] + ["toxic_score", "toxic_spans"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.toxic_score <= 1 for r in got)
    score = {r.doc_id: r.toxic_score for r in got}
    assert [score[i] >= toxicity.THRESHOLD for i in range(150)] == [bool(y) for _, y in fresh]
    assert score[950] < toxicity.THRESHOLD <= score[951]
    marked = next(r for r in got if r.doc_id == 951)
    raw = marked.text.encode()
    assert [raw[s.start:s.end] for s in marked.toxic_spans] == [b"grumf"]
    assert all(score[i] < toxicity.THRESHOLD for i in (900, 901, 902, 903, 904, None))
    kept = toxicity.accepted(df, toxic_model)
    assert kept.columns == df.columns and kept.where("doc_id = 904").count() == 2


def test_copies_do_not_teach_words():
    """A passage that many toxic documents share must not become toxic itself."""
    sample = toxic_sample(450, 1)
    shared = "solben rentu darka lomi benbensol karen"
    sample = [(t + " " + shared, y) if y else (t, y) for t, y in sample]
    model = toxicity.fit(sample)
    data, ends = text_buffers(pa.array([say(random.Random(6), 40) + " " + shared]))
    (_, top, _, _), = toxicity._tagged(model, data, [(0, 0, int(ends[1]))])
    assert top < 0


def quality_sample(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        w = say(rng, rng.randrange(40, 200)).split()
        if i % 2:
            out.append((" ".join(w), 1))
        elif i % 4:
            out.append((" ".join(x for x in w[:20] for _ in range(6)), 0))
        else:
            out.append((" | ".join(w), 0))
    return out


def test_quality(spark):
    model = quality.fit(quality_sample(400, 1))
    fresh = quality_sample(100, 2)
    tail = say(random.Random(8), 3_000)
    rows = [(i, t) for i, (t, _) in enumerate(fresh)] + EDGES + [(950, tail + " " + " ".join(["karen"] * 400)), (951, tail)]
    df = documents(spark, rows, True)
    out = quality.score(df, model)
    assert out.columns == [c for c in df.columns if c != "quality_score"] + ["quality_score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    score = {r.doc_id: r.quality_score for r in got}
    right = [(score[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(fresh)]
    assert sum(right) >= 95
    assert score[900] == score[901]
    assert score[950] < score[951]  # what is wrong stands behind the first thousands of words


def test_windows_cover_every_byte():
    """The strongest response is found wherever the pattern stands, also across chunks and parts."""
    model = {"embedding": np.zeros((256, quality.CHANNELS), np.float32), "bias": np.zeros(quality.FILTERS, np.float32),
             "filters": np.zeros((quality.WIDTH * quality.CHANNELS, quality.FILTERS), np.float32)}
    model["embedding"][ord("z"), 0] = 1
    model["filters"][:quality.CHANNELS * 2:quality.CHANNELS, 0] = 1
    for at in range(1099):
        text = np.full(1100, ord("a"), np.uint8)
        text[at:at + 2] = ord("z")
        view, echo, piece = quality.chunks(text, [(0, 0, len(text))])
        _, response, _ = quality.convolve(model, view, echo)
        assert quality.pooled(response, piece, 1)[0][0, 0] == 2


def plain_lengths(texts, text):
    """Bits of a text by escape method C with exclusion, context by context."""
    fold = langid.FOLD
    used = sorted({int(x) for ts in texts.values() for t in ts for x in fold[np.frombuffer(t.encode(), np.uint8)]} | {0x20})
    size = len(used) + 1
    sym = lambda s: [used.index(int(x)) + 1 if int(x) in used else 0 for x in fold[np.frombuffer(s, np.uint8)]]
    out = {}
    for name, ts in texts.items():
        stream = sym(b"   " + " ".join(ts).encode() + b" ")
        counts = {}
        for i in range(3, len(stream)):
            for k in range(4):
                c = counts.setdefault(tuple(stream[i - k:i]), {})
                c[stream[i]] = c.get(stream[i], 0) + 1

        def prob(ctx, s):
            c = counts.get(ctx)
            lower = (lambda x: prob(ctx[1:], x)) if ctx else (lambda x: 1 / size)
            if not c:
                return lower(s)
            total, kinds = sum(c.values()), len(c)
            if kinds == size:
                return c[s] / total
            if s in c:
                return c[s] / (total + kinds)
            return kinds / (total + kinds) * lower(s) / sum(lower(x) for x in range(size) if x not in c)

        sent = [1 + used.index(0x20)] * 3 + sym(text.encode())
        out[name] = sum(-np.log2(prob(tuple(sent[i - 3:i]), sent[i])) for i in range(3, len(sent)))
    return out


TONGUES = {"xa": ["balo kitu mane ro", "kitu balo sane"], "xb": ["schrum dachs plotz", "plotz é schrum 12"]}


def test_code_lengths_like_context_trees():
    model = langid.fit(TONGUES)
    for text in ("balo plotz", "Schrum Q 9 é!", "a"):
        bits = np.zeros((1, 2))
        data, ends = text_buffers(pa.array([text]))
        langid._add(model, data, ends, [(0, 0, int(ends[1]))], bits)
        cut = np.zeros((1, 2))
        langid._add(model, data, ends, [(0, 0, 1)], cut)
        langid._add(model, data, ends, [(0, 1, int(ends[1]))], cut)
        want = plain_lengths(TONGUES, text)
        assert np.allclose(bits[0], [want["xa"], want["xb"]], rtol=1e-5) and np.allclose(bits, cut)


def test_language(spark):
    model = langid.fit(TONGUES)
    rows = [(1, "balo mane"), (2, "SCHRUM, dachs!"), (3, None), (4, ""), (5, "123 !?"), (6, "schrum " * 2_000), (1, "balo mane"), (None, "plotz")]
    df = documents(spark, rows, True)
    out = langid.score(df, model)
    assert out.columns == [c for c in df.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    got = sorted(((r.doc_id or 0), r.lang_pred, r.lang_score) for r in out.collect())
    assert [g[:2] for g in got] == [(0, "xb"), (1, "xa"), (1, "xa"), (2, "xb"), (3, "und"), (4, "und"), (5, "und"), (6, "xb")]
    assert all(0 <= g[2] <= 1 for g in got) and all(g[2] == 0 for g in got if g[1] == "und")
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "6", "None"]


def test_without_training_rows(spark):
    docs, empty = documents(spark, [(1, "ka"), (2, None)]), documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.trained(empty, labels)
    assert model is None and [r.toxic_score for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert quality.trained(docs, labels) is None
    assert [r.quality_score for r in quality.score(docs, None).collect()] == [0.5, 0.5]
    assert langid.trained(docs) is None and [r.lang_pred for r in langid.score(docs, None).collect()] == ["und", "und"]
    for f in (toxicity, quality, langid):
        assert f.score(empty, None).count() == 0


def test_training_leaves_held_out_rows_alone(spark):
    """The result does not change with the labels or languages of held-out rows."""
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(toxic_sample(120, 5))])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.trained(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r.toxic_score for r in a] == [r.toxic_score for r in b]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = docs.withColumn("lang", F.when(held, "xz").otherwise(F.when(F.col("doc_id") % 2 == 0, "xa").otherwise("xb")))
    assert langid.trained(known)["names"] == ["xa", "xb"]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    """More languages than any list held, with few texts each, also beside a large one."""
    names = [f"y{a}{b}" for a in "abcdefghij" for b in "abcdefgh"]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("kstmn") + rng.choice("ui") for _ in range(20)), "big") for i in range(400)]
    rows += [(1000 + 10 * k + i, f"{n} {n}{n} {n}x {n}", n) for k, n in enumerate(names) for i in range(6)]
    model = langid.trained(labelled(spark, rows))
    assert model["names"] == sorted(names + ["big"])
    got = langid.score(labelled(spark, [(i, f"{n} {n}{n} {n}x {n}", None) for i, n in enumerate(names)]), model).collect()
    assert [r.lang_pred for r in sorted(got)] == names


def test_long_texts_teach_too(spark):
    rows = [(i, "balo kitu mane " * 20, "xa") for i in range(9)]
    rows += [(20 + i, "12 " * 5_000 + "schrum plotz dachs " * 3_000, "xb") for i in range(9)]
    rows += [(40 + i, None if i < 3_000 else "vy vyx yvyx", "xc") for i in range(3_006)]
    rows += [(7, "orra orr", "xd")] * 2_000
    model = langid.trained(labelled(spark, rows))
    assert model["names"] == ["xa", "xb", "xc", "xd"]
    got = langid.score(labelled(spark, [(1, "plotz dachs", None), (2, "vyx vy", None), (3, "mane balo", None), (4, "orr", None)]), model)
    assert [r.lang_pred for r in sorted(got.collect())] == ["xb", "xc", "xa", "xd"]


def test_tables_in_parts_are_the_same(monkeypatch):
    texts = TONGUES | {"xc": ["kitu plotz 12 é"], "xd": ["sane sane"]}
    data, ends = text_buffers(pa.array(["balo plotz 9 schrum"]))
    found = []
    for n in (8, 3, 1):
        monkeypatch.setattr(langid, "TOGETHER", n)
        bits = np.zeros((1, 4))
        langid._add(langid.fit(texts), data, ends, [(0, 0, int(ends[1]))], bits)
        found.append(bits)
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[2])
