import random

from data import documents, words
from veilspark.llm import licenses


def plain(text):
    w = words(text)
    hits = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()]
            for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def rows():
    rng = random.Random(3)
    pool = "mit license apache general public gnu the of under licensed version".split()
    out = [(i, " ".join(rng.choice(pool) + rng.choice(["", "", ".", "-", "é"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    return out + [
        (100, None), (101, ""), (102, "MIT"), (103, "MIT  --\nLicense"), (104, "mité license"), (105, "(GNU) General Public\tLicense, v3"),
        (106, "x " * 9_000 + "Apache License" + " y" * 10), (107, "mit license " * 50), (4, out[4][1]), (4, "apache license"),
        (None, "mit license"), (108, "mit general public license mit license")]


def test_base_like_brute_force(spark):
    data = rows()
    for clash in (False, True):
        got = licenses.scan(documents(spark, data, clash)).collect()
        want = [(d, *plain(t)) for d, t in data]
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_changed_passages(spark):
    passage = dict((label, text) for text, label in licenses.TEMPLATES)["bsd"].split()
    changed = passage[:5] + ["any"] + passage[5:9] + passage[10:]  # one word more, one less
    data = [(1, "a b " + " ".join(passage) + " c"), (2, " ".join(changed)), (3, " ".join(passage[:5])), (4, " ".join(reversed(passage)))]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, data)).collect()}
    assert got[1].labels == got[2].labels == "bsd" and got[1].score == 1 and 0.75 <= got[2].score < 1
    assert got[3].labels == got[4].labels == "" and got[3].score == 0 and got[1].spans[0].start == 2


def plain_method(text):
    """(labels, score): every template against every neighbourhood of diagonals, chains by search."""
    w = words(text)
    labels, best = set(plain(text)[4].split(",")) - {""}, 0.0
    for template, label in licenses.PHRASES + licenses.TEMPLATES:
        t = template.split()
        size, base = len(t) - 1, (template, label) in licenses.PHRASES
        hits = sorted((p, q) for p in range(len(w) - 1) for q in range(size) if w[p:p + 2] == t[q:q + 2])
        for d in {p - q for p, q in hits}:
            near = [(p, q) for p, q in hits if abs(p - q - d) <= (0 if base else licenses.GAP)]
            chains = {}  # by last match: the longest rising chain, then the one that begins last
            for p, q in near:
                n, first = max((chains[x] for x in chains if x[0] < p and x[1] < q), default=(0, p))
                chains[p, q] = n + 1, first
            share = max(n / max(size, p - first + 1) for (p, _), (n, first) in chains.items())
            if len(near) >= licenses.COVER * size and share >= (1 if base else licenses.COVER):
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def test_labels_and_scores_like_brute_force(spark):
    rng = random.Random(8)
    data = rows()
    for i in range(150):
        text, _ = rng.choice(licenses.TEMPLATES)
        w = text.split()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randrange(2)] = rng.choice([[], ["any"], ["the"], ["rights", "x"], w[:3]])
        data.append((200 + i, " ".join(["so"] * rng.randrange(3) + w * rng.choice([1, 1, 2]))))
    data += [(500, "all rights x rights reserved"), (501, "all rights reserved"), (502, "reserved rights all"),
             (503, "all rights all rights all rights reserved reserved rights reserved")]
    got = licenses.scan(documents(spark, data)).collect()
    want = sorted((str(d), *plain_method(t)) for d, t in data)
    assert [(a, b, round(c, 9)) for a, b, c in sorted((str(r.doc_id), r.labels, r.score) for r in got)] == [
        (a, b, round(c, 9)) for a, b, c in want]
    named = {r.doc_id: (r.labels, r.score) for r in got}
    assert named[500] == named[502] == ("", 0) and named[501] == ("all-rights-reserved", 1)


def test_license_bodies(spark):
    body = ("The Software is provided \"AS IS\", without warranty of any kind, express or implied, including but not limited to the "
            "warranties of merchantability, fitness for a particular purpose and noninfringement.")
    row = licenses.scan(documents(spark, [(1, "intro " + body + " rest")])).first()
    assert (row.labels, row.score, row.base_labels) == ("mit", 1, "")


def test_empty(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
