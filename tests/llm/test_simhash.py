import random

import xxhash

from data import documents, lower
from veilspark.llm import simhash

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(1_500))  # is cut into parts
HUGE = LONG + "\n" + LONG.upper()


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def rows():
    rng = random.Random(5)
    base = [" ".join(f"wort{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        for k in range(6):
            w[rng.randrange(len(w))] = f"x{k}"
            out.append((100 + 10 * i + k, " ".join(w)))
    return out + [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one\vTWO"), (505, "É é x y z"),
                  (7, base[7]), (None, base[3]), (None, "nobody else says this at all today"), (600, HUGE), (601, HUGE)]


def expected(rows):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, prints[i], least.get(find(i))) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_like_brute_force(spark):
    data = rows()
    for clash in (False, True):
        got = [(r[0], r[1] % 2**64, r[2]) for r in simhash.near_duplicates(documents(spark, data, clash)).collect()]
        assert order(got) == order(expected(data))
        if not clash:
            assert len({r[2] for r in got}) < len(got) - 6


def test_first_of_each(spark):
    data = rows()
    df = documents(spark, data, True)
    out = simhash.first_of_each(df)
    assert out.columns == df.columns
    want = {c for d, _, c in expected(data) if c is not None}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 1  # the nameless text that nobody else has


def test_first_of_each_by_id_and_text(spark):
    """Different texts under one id both stay, copies and near copies go, also without an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(2, a), (2, b), (3, a), (2, a), (2, a), (None, c), (None, c), (None, b), (5, None), (6, ""), (1, "one"), (1, "one")]
    got = simhash.first_of_each(documents(spark, data, True))
    want = [(2, a), (2, b), (None, c), (5, None), (1, "one")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))


def test_pairs_around_anchors():
    import numpy as np

    anchors = simhash.Anchors()
    rng = np.random.default_rng(1)
    f = rng.integers(-2**63, 2**63 - 1, 300, dtype=np.int64)
    for bits in (0, 1, 2):
        g = f.copy()
        for b in range(bits):
            g ^= np.left_shift(np.int64(1), (rng.integers(0, 32, 300) + 32 * b).astype(np.int64))
        at, near = anchors.near(g)
        found = set(zip(at.tolist(), near.tolist()))
        assert all((i, h) in found for i, h in enumerate(anchors.home(f).tolist()))
    assert [len(s[1]) / 2048 for s in anchors.steps][0] == 1


def test_visitors_are_not_broadcast(spark, tmp_path):
    """A small file makes 62 times as many rows, which no size limit of a broadcast sees."""
    prints = [7, 6, 4, 3 << 40, (3 << 40) + 1, -1, -4, None]
    spark.createDataFrame([(f,) for f in prints], "fingerprint long").write.parquet(f"{tmp_path}/prints")
    pairs = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in pairs.collect()} == {
        (a, b) for a in prints[:-1] for b in prints[:-1] if a < b and ((a ^ b) % 2**64).bit_count() <= 2}


def test_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    got = {r[0]: r[1] for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.first_of_each(documents(spark, [])).count() == 0
