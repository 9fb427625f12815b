import hashlib
import random

import pytest

from data import documents, words
from veilspark.llm import decontam


def plain(docs, items):
    spans = {}
    for item, text in items:
        w = words(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1) if w else ():
            spans.setdefault(tuple(w[i:i + m]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(s) for s in spans}:
            for i in range(len(w) - m + 1):
                got = spans.get(tuple(w[i:i + m]))
                if got is not None:
                    hit.update(range(i, i + m))
                    found |= got
        found = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def data():
    rng = random.Random(9)
    say = lambda n, k=30: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, say(rng.choice([13, 14, 20, 40]))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "Short one here"), (53, "solo"), (None, say(15)), (54, items[0][1]), (55, "a " * 30)]
    docs = []
    for i in range(60):
        text = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(w)))
            text += " " + " - ".join(w[a:a + rng.choice([5, 12, 13, 14, 30])]).upper() + ". " + say(rng.randrange(20))
        docs.append((i, text))
    docs += [(70, None), (71, ""), (72, "!?"), (73, "a " * 40), (74, "short ONE here"), (75, "É short one hereé solo"),
             (3, docs[3][1]), (3, "another text under the same number"), (None, items[1][1]), (76, say(9000) + " " + items[2][1] + " " + say(9000, 5))]
    return docs, items


@pytest.mark.parametrize("clash", [False, True])
def test_like_brute_force(spark, clash):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.contamination(documents(spark, docs, clash), bench).collect()]
    want = plain(docs, items)
    assert sorted(got, key=lambda r: (r[0] is not None, r)) == want
    assert any(r[5] for r in want) and any(r[2] and not r[5] for r in want)


def test_clean_keeps_the_rest(spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, docs, True)
    assert decontam.clean(df, bench).columns == df.columns
    docs += [(80, docs[6][1]), (81, items[3][1]), (81, "a clean text"), (None, "another clean text")]
    out = decontam.clean(documents(spark, docs, True), bench)
    kept = [d for d in docs if not plain([d], items)[0][5]]
    assert len(kept) < len(docs) and (81, "a clean text") in kept and (None, items[1][1]) not in kept
    assert sorted(map(str, kept)) == sorted(str((r.doc_id, r.text)) for r in out.collect())


@pytest.mark.parametrize("part", [20, 64])
def test_long_texts_in_parts(spark, monkeypatch, part):
    """Hits at every place across the cuts between parts."""
    monkeypatch.setattr(decontam, "PART", part)
    items = [(1, " ".join(f"q{i}" for i in range(15))), (2, "short one"), (3, "solo"), (4, " ".join(f"p{i}" for i in range(12)))]
    docs = []
    for shift in range(2 * part):
        filler = [f"x{i}" for i in range(shift)]
        for k, (_, text) in enumerate(items):
            docs.append((10 * shift + k, " - ".join(filler + words(text.upper()) + ["tail"] * 7 + words(text) + filler)))
    docs += [(9000, "y " * (3 * part)), (9001, "... " + "q0 " * part), (9002, None), (9000, "y " * (3 * part))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.contamination(documents(spark, docs), bench).collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r)) == plain(docs, items)


def test_empty(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contamination(documents(spark, []), bench).count() == 0
    row = decontam.contamination(documents(spark, [(1, "a b c")]), bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)


def test_no_python_in_the_plan(spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = decontam.contamination(documents(spark, docs), bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
