"""Conversation repair against a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

from veilspark.llm import queries, repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    """Rows of (conv, turn, role, text) after damage, per conversation in order of turns."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        mine += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = BLANK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, letters, roles and texts) by keeping the best history per state, forward; no vectors, no blocks."""
    best = {"": (0, "", ())}  # by what the role initials so far mean

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    def inserts(best):
        for _ in range(4):
            for state, (cost, letters, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step(state, role[0])
                    if to:
                        new = (cost + 5, letters + "I", lines + ((role, ""),))
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        after = {}
        for state, (cost, letters, lines) in inserts(dict(best)).items():
            ways = [(state, cost + 2, "D", ())]
            if fault in (None, "truncated"):
                cut = 5 if fault else 0
                ways += [(step(state, role[:1]), cost + cut, "K", ((role, text),))]
                ways += [(step(state, r[0]), cost + cut + 1, "R", ((r, text),)) for r in ("user", "assistant")]
            for to, price, letter, more in ways:
                new = (price, letters + letter, lines + more)
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        best = after
    return min((w for s, w in inserts(dict(best)).items() if s in ("", "a")), key=lambda w: w[:2])


def plain(rows):
    out = []
    for conv, mine in plain_damage(rows).items():
        turns = [t for t, _, _ in mine if t is not None]
        faults = plain_faults(mine)
        pairs = zip(mine, mine[1:])
        cost, letters, lines = plain_repair(mine)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, letters,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_letters_against_all_edits():
    """The programme against every string of edits, on all short conversations."""

    def outcome(codes, letters):
        state, cost, i = 0, 0, 0
        for letter in letters:
            if letter == "I":
                state, cost = repair.NEXT[state], cost + 5
                continue
            if i == len(codes):
                return None
            code, i = codes[i], i + 1
            if letter == "D":
                cost += 2
                continue
            if code & (repair.REPEATED | repair.BLANK):
                return None
            cost += 5 * bool(code & repair.TRUNCATED) + (letter == "R")
            state = repair.NEXT[state] if letter == "R" else repair.kept(state, code & 3)
            if state is None:
                return None
        return (cost, letters) if i == len(codes) and not repair.FINAL[state] else None

    every = ["".join(x) for n in range(6) for x in itertools.product("DIKR", repeat=n)]
    for codes in itertools.chain(*(itertools.product((0, 1, 2, 3, 5, 6, 9), repeat=n) for n in range(4))):
        best = min(filter(None, (outcome(codes, x) for x in every)))
        times = [1] * len(codes)
        edits = "".join(repair.walk(list(codes), times, repair.FINAL, 0))
        v = repair.FINAL
        for code in reversed(codes):
            v = repair.before(v, code, 1)
        costs = repair.matrix(list(codes), times)
        assert v[0] == best[0] == min(costs[e] + repair.FINAL[e] for e in range(4))
        assert best[1].startswith(edits) and set(best[1][len(edits):]) <= {"I"}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_repair(spark, sf_dir)) == plain(rows)


def rows_of_chance(seed, n):
    rnd = random.Random(seed)
    texts = [None, "", " \t", "Yes.", "Yes", "No!", "cut off", "why? ", "é…", "a.b"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rnd.randrange(12)):
            rows.append((conv, rnd.choice([t, t, t, t * 3, None, -t]), rnd.choice(roles), rnd.choice(texts)))
    return rows


def test_odd_rows_across_blocks(spark, monkeypatch):
    """Nulls, empty texts, ties, repeated rows and clashing columns; blocks of four turns."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = rows_of_chance(3, 150)
    rows += rows[:40] + [(999, i, "user" if i % 2 else "assistant", f"w{i % 300}" + "." * (i % 3)) for i in range(1500)]
    rows += [(1000, None, "user", "again.")] * 200 + [(1001, 1, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as cost", "'x' as audit", "'y' as at", "2 as code", "3 as n", "'z' as conv")
    assert result(repair.digests(repair.repaired(repair.damaged(df.drop("conv"))))) == plain(rows)


def test_turns_of_the_repair(spark):
    """The repaired turns themselves: legal roles, and the letters spell their history."""
    rows = rows_of_chance(5, 60)
    done = repair.repaired(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for part in done.toPandas().groupby("conv", dropna=False):
        kept = part[1][part[1].edit.isin(["K", "R", "I"])]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in kept.role))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = repair.digests(repair.repaired(repair.damaged(df)))
    assert done.collect() == [] and done.columns[0] == "conv_id"
