"""Token alignment against a plain reading of the rules."""

import hashlib
import os
from collections import Counter

import pytest
import sentencepiece
from data import documents
from tokenizers import Tokenizer

from veilspark.llm import alignment, queries

pytestmark = pytest.mark.skipif(not os.path.exists(alignment.BYTE_BPE), reason="no vocabularies")


@pytest.fixture(scope="module")
def engines():
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def plain(rows, engines):
    """Whole texts through the two libraries, groups and links in loops."""
    a, b = engines
    alphabet = alignment.byte_alphabet()
    docs = []
    for i, text in rows:
        groups = []
        if text:
            spaced = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            left = [bytes(alphabet[c] for c in t) for t in x.tokens]
            pieces = [b.id_to_piece(j) for j in y]
            right = [bytes([int(p[3:5], 16)]) if b.is_byte(j) else p.replace("▁", " ").encode() for j, p in zip(y, pieces)]
            if b"".join(left) == b"".join(right) == spaced:
                p = q = 0
                while p < len(left):
                    start, seen, other = (p, q), b"", b""
                    while not seen or seen != other:
                        if len(seen) <= len(other):
                            seen, p = seen + left[p], p + 1
                        else:
                            other, q = other + right[q], q + 1
                    groups.append((x.ids[start[0]:p], y[start[1]:q]))
        docs.append((i, groups))
    links = [Counter((p, q) for left, right in groups for p in left for q in right) for _, groups in docs]
    count = Counter(pair for found in links for pair in found)
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    out = []
    for (i, groups), found in zip(docs, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(found.values()),
            sum(n for pair, n in found.items() if count[pair] == best[pair[0]]), sum(n * count[pair] for pair, n in found.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), count


def result(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_whole_table(spark, sf_dir, engines):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, count = plain(rows, engines)
    assert result(queries.op12_alignment(spark, sf_dir)) == want
    pairs = alignment.align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)


ODD = ["a", " a", "a ", "  two  blanks  ", "tab\tline\nend", "", None, "<|endoftext|> <s> </s> <unk>", "▁ literal", "naïve Élan 日本語 😀",
       "don't we'll I'm", "x" * 300, "- " * 40 + "----------------------------", "  odd\u0085", "12345 67.89", "a\x00b", "é" * 50, "\n\n\n",
       "é zero​width", "مرحبا بالعالم", "a  b   c    d"]


@pytest.mark.parametrize("chunk", [50, 4 << 20])
def test_odd_rows(spark, monkeypatch, engines, chunk):
    """Nulls, empty texts, ties, repeated rows, clashing columns; many chunks, buckets and parts, or one."""
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    if chunk == 50:
        monkeypatch.setattr(alignment, "PAIRS", 16)
        monkeypatch.setattr(alignment, "ENTRIES", 16)
        monkeypatch.setattr(alignment, "PART", 20)
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(3, "again and again and again")] * 3 + [(90, "the cat " * 30)]
    found, pairs = alignment.align(documents(spark, rows, clash=True).repartition(4))
    want, count = plain(rows, engines)
    assert result(found) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)


def test_parts_are_whole_encodings(engines, spark, sf_dir, monkeypatch):
    """A text in parts has the tokens that both libraries give the whole text."""
    monkeypatch.setattr(alignment, "PART", 300)
    a, b = alignment.Bytewise(alignment.BYTE_BPE), alignment.Pieces(alignment.PIECE_BPE)
    assert a.fast is not None
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    n = 0
    for text in filter(None, texts):
        parts = alignment.cut(" " + text)
        n += len(parts) > 1
        assert "".join(parts) == " " + text
        assert sum(a.encode(parts), []) == engines[0].encode(" " + text, add_special_tokens=False).ids
        assert sum(b.encode(parts), []) == engines[1].encode(text)
    assert n > 50


def test_no_piece_crosses_into_a_blank(engines):
    """What cutting relies on: no piece goes from a character on to a blank."""
    for i in range(engines[1].get_piece_size()):
        piece = engines[1].id_to_piece(i)
        assert "▁" not in piece.lstrip("▁")


def test_empty_table(spark):
    found, pairs = alignment.align(documents(spark, [(1, "x")]).where("false"))
    assert found.collect() == [] and pairs.collect() == []
