import hashlib
import random

import pytest

from veilspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, w long, at long, loss string, own boolean"
BAD = [None, "", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a\nb", "é<|", "<|im_end|>\n", "$1 \\1", "<", "|>", "\\"]


def rows():
    rng = random.Random(1)
    out = []
    for c in range(30):
        turns = []
        if c % 3 == 0:
            turns.append(("system", rng.choice(BAD)))
        for i in range(rng.randrange(1, 30)):
            turns.append((("user", "assistant")[i % 2], rng.choice(BAD) if rng.random() < 0.5 else "word " * rng.randrange(200)))
        out += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    hot = [(100, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (i % 90)) for i in range(1500)]
    odd = [(200, None, "assistant", "first"), (200, 3, None, "b"), (200, 3, "assistant", "same"), (200, 3, "assistant", "same"),
           (None, 0, "assistant", "nobody"), (300, 5, "assistant\nx\\n", "odd role"), (301, 0, "assistant", "z" * 20_000), (301, 1, "user", "q")]
    return out + hot + odd


def expected(rows):
    convs = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append(((n is not None, n), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
                  len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", True) for r in rows], SCHEMA)


@pytest.mark.parametrize("stride,history", [(768, 256), (40, 40), (100, 0)])
def test_round_trip(spark, monkeypatch, stride, history):
    monkeypatch.setattr(chat, "TURNS", 64)
    windows = chat.windows(frame(spark, rows()), stride=stride, history=history)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    assert got == expected(rows())


def test_windows(spark):
    data = rows()
    got = chat.windows(frame(spark, data), stride=100, history=60).collect()
    tokens = lambda t: 4 + -(-len((t or "").encode()) // 4)
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for c, ws in by.items():
        if c == 200:
            continue
        turns = [t for t in data if t[0] == c]
        at, starts = 0, []
        for t in turns:
            starts.append(at)
            at += tokens(t[3])
        for w in ws:
            own = [i for i, s in enumerate(starts) if s // 100 == w.window]
            before = [i for i, s in enumerate(starts) if w.window * 100 - 60 <= s < w.window * 100]
            head = w.window > 0 and turns[0][2] == "system"
            if head:
                before = [0] + [i for i in before if i]
            assert own and w.n_turns == len(own) + len(before) and w.n_repeated == len(before)
            text, loss = "", []
            for i in before + own:
                _, _, role, said = turns[i]
                body = __import__("re").sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", said or "")
                text += "<|im_start|>" + (role or "").replace("\\", "\\\\").replace("\n", "\\n") + "\n"
                if role == "assistant" and i in own:
                    loss.append((len(text), len(body)))
                text += body + "<|im_end|>\n"
            assert w.formatted == text and [tuple(x) for x in w.loss] == loss
            assert text.count("<|im_start|>") == text.count("<|im_end|>") == w.n_turns
    assert len(by[100]) > 50  # the large conversation is spread over windows


def test_empty(spark):
    assert chat.digests(chat.windows(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        chat.windows(frame(spark, []), stride=10, history=11)
