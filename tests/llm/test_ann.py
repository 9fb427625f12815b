import numpy as np

from veilspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, id string, dim int"


def brute(rows, k=20):
    """Like the operator, by comparing everything."""
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = {}
    for q, v in best.items():
        if q % 20 == 0:
            near = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), i)
                          for i, w in best.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def data(n=1500):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, 24))
    x *= rng.uniform(0.5, 2, (n, 1))
    x[100:400] = x[100] + 0.01 * rng.normal(size=(300, 24))  # many near copies
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    same = rows[40][1]
    rows += [(2000 + i, same) for i in range(60)]  # equal vectors: ties to the smaller id
    rows += [(3000, None), (3020, []), (3040, [0.0] * 24), (3060, [float("nan")] + [1.0] * 23), (3080, [float("inf")] + [1.0] * 23),
             (3100, [None] + [1.0] * 23), (None, same), (3120, [1.0, 2.0]), (3121, [2.0, 1.0]), (20, rows[20][1]), (60, [9.0] * 24)]
    return rows


def run(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", 40)
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_order_and_odd_vectors(spark, monkeypatch):
    rows = data()
    want = brute(rows)
    got = run(spark, rows, 500, monkeypatch)
    assert got.keys() == {q for q, near in want.items() if near}
    hits = total = 0
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in near]
        assert len(near) == len(want[q])
        total += len(want[q])
        hits += len({i for i, _ in near} & {i for i, _ in want[q]})
    assert hits / total >= 0.95
    assert [i for i, _ in got[3120]] == [3121]


def test_few_vectors_are_found_exactly(spark, monkeypatch):
    rows = data()[:90]
    want, got = brute(rows), run(spark, rows, 8_192, monkeypatch)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items()}
    assert all(np.isclose(a[1], b[1], rtol=1e-12) for q in got for a, b in zip(got[q], want[q]))


def test_every_node_can_be_reached():
    rng = np.random.default_rng(4)
    points = np.unique(np.concatenate([rng.normal(size=(600, 8)), 5 + 1e-3 * rng.normal(size=(400, 8))]), axis=0)
    g = ann.Graph(points)
    g.build()
    seen, front = {g.entry}, [g.entry]
    while front:
        front = [x for x in {int(e) for n in front for e in g.edges[n]} if x >= 0 and x not in seen]
        seen |= set(front)
    assert len(seen) == len(points)
    kept = g.edges[:, :ann.DEGREE]
    assert (kept >= 0).any(axis=1).all()


def test_empty(spark, monkeypatch):
    assert run(spark, [], 10, monkeypatch) == {}
    assert run(spark, [(20, [1.0])], 10, monkeypatch) == {}
