import collections
import random

import pytest

from data import documents
from veilspark.llm import mixing


def brute_edf(share):
    """Slot by slot over all sources."""
    q, done, out = sum(share), [0] * len(share), []
    for t in range(q):
        ready = [(-(-(d + 1) * q // a), j) for j, (a, d) in enumerate(zip(share, done)) if d < a and d * q // a <= t]
        j = min(ready)[1]
        done[j] += 1
        out.append(j)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_period_meets_every_deadline(seed):
    rng = random.Random(seed)
    share = [rng.choice([0, 1, 2, 3, 5, 40, 200]) for _ in range(rng.randrange(1, 25))] + [1]
    slots = mixing.period(share)
    assert slots == brute_edf(share)
    q, done = len(slots), collections.Counter()
    for t, j in enumerate(slots, 1):
        done[j] += 1
        assert all(abs(done[s] - t * a / q) < 1 for s, a in enumerate(share))


@pytest.mark.parametrize("seed", range(10))
def test_phases_use_every_block(seed):
    rng = random.Random(seed)
    blocks = [rng.choice([0, 1, 7, 300, 5000]) for _ in range(12)]
    plan = mixing.phases(blocks, [rng.uniform(0.01, 1) for _ in blocks], 100)
    total = [0] * len(blocks)
    for share, slots, before, length in plan:
        assert before == total
        for t in range(length):
            total[slots[t % len(slots)]] += 1
    assert total == blocks and len(plan) <= 12


def mixed(spark, rows, clash=False, **options):
    df = documents(spark, rows, clash)
    out = mixing.mix(df, **options)
    assert out.columns == [c for c in df.columns if c not in ("mix_slot", "mix_pos")] + ["mix_slot", "mix_pos"]
    return out.collect()


def test_deviation_stays_below_one_block(spark):
    rows = [(i, "x", "big" if i % 3 == 0 else f"s{i % 7}") for i in range(1500)]
    weights = {"big": 0.5, "s0": 0.05, "s1": 0.1, "s2": 0.1, "s3": 0.05, "s4": 0.1, "s5": 0.05, "s6": 0.05}
    got = sorted(mixed(spark, rows, True, weights=weights, block=4), key=lambda r: r.mix_pos)
    assert sorted(r.doc_id for r in got) == list(range(1500))
    assert len({r.mix_pos for r in got}) == 1500
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r.mix_slot, r.source) == r.source
    assert sorted(by_slot) == list(range(len(by_slot)))
    size = {s: -(-n // 4) for s, n in collections.Counter(r[2] for r in rows).items()}
    done = collections.Counter()
    for t in range(len(by_slot)):
        if done[by_slot[t]] == size[by_slot[t]] or any(done[s] == size[s] for s in size):
            break
        done[by_slot[t]] += 1
        assert all(abs(done[s] - (t + 1) * w) < 1 for s, w in weights.items())
    assert sum(done.values()) > 200


def test_numbering_groups_do_not_matter(spark, monkeypatch):
    rows = [(i, "x", "ab"[i % 5 == 0]) for i in range(800)]
    one = {(r.doc_id, r.mix_pos) for r in mixed(spark, rows)}
    monkeypatch.setattr(mixing, "GROUP", 20)
    assert {(r.doc_id, r.mix_pos) for r in mixed(spark, rows)} == one


def test_odd_rows(spark):
    rows = [(1, "x", None), (1, "x", None), (None, "y", "it's"), (None, "y", "it's"), (2, None, ""), (3, "", "a\\b"), (4, "z", None)]
    got = mixed(spark, rows, True, block=2)
    assert len(got) == 7 and len({r.mix_pos for r in got}) == 7
    late = mixed(spark, rows, weights={"it's": 1.0}, block=2)
    assert min(late, key=lambda r: r.mix_pos).source == "it's" and len(late) == 7
    assert mixed(spark, []) == []


def test_output_is_in_order_and_native(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 64)
    rows = [(i, "x", f"s{i % 3}" if i % 2 else "big") for i in range(2000)]
    docs = documents(spark, rows)
    out = mixing.mix(docs, {"big": 3.0, "s0": 1.0, "s1": 1.0, "s2": 1.0}, block=4, in_order=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    parts = [[r.mix_pos for r in p] for p in out.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 2000
    flat = [x for p in parts if p for x in p]
    place = {x: i for i, x in enumerate(sorted(flat))}
    assert max(abs(place[x] - i) for i, x in enumerate(flat)) < 400  # only neighbours change places
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixing.mix(
        docs, {"big": 3.0, "s0": 1.0, "s1": 1.0, "s2": 1.0}, block=4).collect()}


@pytest.mark.parametrize("total", [3_000, 60_000])
def test_deviation_does_not_grow_with_the_run(total):
    blocks = [total // 3] + [total * 2 * (19 + i) // (3 * 19 * 28) for i in range(19)]
    weights = [n ** mixing.TEMPER for n in blocks]
    _, slots, _, length = mixing.phases(blocks, weights)[0]
    done, whole = [0] * len(blocks), sum(weights)
    for t in range(length):
        done[slots[t % len(slots)]] += 1
        if t % 97 == 0 or t > length - 200:
            assert all(abs(n - (t + 1) * w / whole) < 1 for n, w in zip(done, weights))
    assert length > total / 4


def test_small_weights_stay_small():
    blocks, weights = [6_000] + [4] * 2_000, [0.5] + [0.00025] * 2_000
    _, slots, _, length = mixing.phases(blocks, weights)[0]
    done = sum(slots[t % len(slots)] == 0 for t in range(4_000))
    assert length >= 4_000 and abs(done - 2_000) < 1


def test_slots_are_handed_over_in_parts(spark, monkeypatch):
    rows = [(i, "x", None if i % 7 == 0 else "ab"[i % 5 == 0]) for i in range(800)]
    one = {(r.doc_id, r.mix_slot, r.mix_pos) for r in mixed(spark, rows, block=4)}
    monkeypatch.setattr(mixing, "SLOTS", 33)
    assert {(r.doc_id, r.mix_slot, r.mix_pos) for r in mixed(spark, rows, block=4)} == one
