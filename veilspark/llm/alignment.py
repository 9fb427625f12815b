"""Alignment of two tokenizers over a corpus: which ids of A stand for which ids of B.

Most tokens of A have a token of B with the same bytes.  An array maps such an id
of A to that of B; groups of just these two are counted in a vector as long as the
vocabulary.  Only the other groups make pairs, and only pairs are shuffled.

Documents are handled in chunks.  Entries of a chunk are sorted by pair, so it
sends each pair once with the documents that hold it, as arrays.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm.common import staged

#: Where the vocabularies lie on every executor.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes and documents of a chunk, characters after which a long text is cut.
CHUNK, DOCUMENTS, PART = 4 << 20, 1 << 16, 1 << 16
#: Entries of documents that a task of the second pass reads, and pairs that it looks them up among.
ENTRIES, PAIRS = 16 << 20, 1 << 20

#: No token of either side crosses from a character into a single blank before another one.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary spells bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bytewise:
    """Tokenizer A: a byte-level BPE from its JSON file; special strings in texts are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        known = {bytes(alphabet[c] for c in k): i for k, i in vocab.items() if i not in special}
        self.size = 1 + max([*vocab.values(), *special])
        self.octets = [b""] * self.size
        for octets, i in known.items():
            self.octets[i] = octets
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # the fast engine merges in order of ids: it fits if merges make ascending ids
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        usual = spec["pre_tokenizer"] and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["normalizer"]
        self.fast = None
        if usual and made == sorted(made) and len(known) == 256 + len(made):
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, parts: list[str]) -> list[list[int]]:
        out = []
        for part in parts:
            # a part without any place to cut is left to the other engine, which has no limits there
            if self.fast is not None and len(part) <= 4 * PART:
                out.append(self.fast.encode_ordinary(part))
            else:
                out.append(self.whole.encode(part, add_special_tokens=False).ids)
        return out


class Pieces:
    """Tokenizer B: a sentence-piece model, which puts a blank in front by itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.octets = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.octets.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.octets.append(b"")
            else:
                self.octets.append(piece.replace("▁", " ").encode())

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in parts], num_threads=1)


def cut(spaced: str) -> list[str]:
    """A text in parts of about PART characters, each of which both tokenizers take by itself."""
    out, start = [], 0
    while len(spaced) - start > PART and (found := _CUT.search(spaced, start + PART)):
        out.append(spaced[start:found.start()])
        start = found.start()
    return out + [spaced[start:]]


def same_bytes(a: Bytewise, b: Pieces) -> np.ndarray:
    """For each id of A the id of B with the same bytes, or -1; pieces go before single bytes."""
    at = {}
    for i in sorted(range(b.size), key=b.model.is_byte):
        if b.octets[i]:
            at.setdefault(b.octets[i], i)
    return np.array([at.get(x, -1) if x else -1 for x in a.octets], np.int64)


def _tokens(text: str | None, a: Bytewise, b: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides; none unless both spell the blank and the text."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    left, right, parts = [], [], cut(" " + text)
    for part, x, y in zip(parts, a.encode(parts), b.encode(parts)):
        spelt = part.encode()
        if b"".join(map(a.octets.__getitem__, x)) != spelt or b"".join(map(b.octets.__getitem__, y)) != spelt:
            return none, none
        left.append(np.array(x, np.int64))
        right.append(np.array(y, np.int64))
    return np.concatenate(left), np.concatenate(right)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their number or sum of weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _products(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, na: int, nb: int):
    """(group, pair, number) for all pairs of distinct ids inside the groups."""
    left, ca = _counted(ga * na + a)
    right, cb = _counted(gb * nb + b)
    gl, al, gr = left // na, left % na, right // nb
    first, last = np.searchsorted(gr, gl), np.searchsorted(gr, gl, side="right")
    times = last - first
    row = np.repeat(np.arange(len(gl)), times)
    column = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return gl[row], al[row] * nb + right[column] % nb, ca[row] * cb[column]


class Chunk:
    """The groups of some documents, worked out together."""

    def __init__(self, tokens: list[tuple[np.ndarray, np.ndarray]], a: Bytewise, b: Pieces, same: np.ndarray,
                 lengths: tuple[np.ndarray, np.ndarray], words: list[str]):
        n = len(tokens)
        self.n_a = np.array([len(x) for x, _ in tokens], np.int64)
        self.n_b = np.array([len(y) for _, y in tokens], np.int64)
        ids = np.concatenate([x for x, _ in tokens] or [np.zeros(0, np.int64)])
        other = np.concatenate([y for _, y in tokens] or [np.zeros(0, np.int64)])
        ends, ends_b = np.cumsum(lengths[0][ids]), np.cumsum(lengths[1][other])
        # the documents lie one behind the other, so the end of each is an end on both sides
        mark = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.uint8)
        mark[ends] = 1
        mark[ends_b] += 2
        before = np.cumsum(mark == 3)
        g, h = before[ends - 1], before[ends_b - 1]
        groups = int(before[-1])
        in_a, in_b = np.bincount(g, minlength=groups), np.bincount(h, minlength=groups)
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        doc = np.repeat(np.arange(n), self.n_a)[start_a] if groups else np.zeros(0, np.int64)
        self.n_groups = np.bincount(doc, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, doc, in_a * in_b)
        self.digests = self._digests(ids, other, g, h, in_a, start_a, start_b, a.size, words)

        exact = (in_a == 1) & (in_b == 1)
        exact[exact] = same[ids[start_a[exact]]] == other[start_b[exact]]
        key, self.same_times = _counted(ids[start_a[exact]] * n + doc[exact])
        self.same_codes, self.same_docs = key // max(n, 1), key % max(n, 1)
        rest_a, rest_b = ~exact[g], ~exact[h]
        group, pair, times = _products(g[rest_a], ids[rest_a], h[rest_b], other[rest_b], a.size, b.size)
        both, self.pair_times = _counted(pair * n + doc[group], times)
        self.pair_codes, self.pair_docs = both // max(n, 1), both % max(n, 1)
        # a document counts once for a pair, also if it holds it in both ways
        left = self.pair_codes // b.size
        twice = same[left] == self.pair_codes % b.size
        twice[twice] = np.isin(left[twice] * n + self.pair_docs[twice], key, assume_unique=True)
        self.new = ~twice

    def _digests(self, ids, other, g, h, in_a, start_a, start_b, size, words) -> list[str]:
        """SHA-256 of the groups of each document, spelt out."""
        spelt = np.zeros(len(ids) + len(other), np.int64)
        more = np.concatenate([g[1:] == g[:-1], [False]]) if len(g) else np.zeros(0, bool)
        spelt[np.arange(len(ids)) + start_b[g]] = ids * 2 + ~more
        more = np.concatenate([h[1:] == h[:-1], [False]]) if len(h) else np.zeros(0, bool)
        spelt[np.arange(len(other)) + start_a[h] + in_a[h]] = (size + other) * 2 + ~more
        ends, out, start = np.cumsum(self.n_a + self.n_b).tolist(), [], 0
        for end in ends:
            digest = hashlib.sha256()
            for at in range(start, end, 1 << 20):
                text = "".join(map(words.__getitem__, spelt[at:min(end, at + (1 << 20))].tolist()))
                digest.update((text if at + (1 << 20) < end else text[:-1]).encode())
            out.append(digest.hexdigest() if end > start else "")
            start = end
        return out

    def arrays(self) -> Iterator[tuple]:
        """(kind, entries, codes, sizes, new, docs, times) of the exact groups and of the pairs."""
        for kind, codes, docs, times, new in (
                (1, self.same_codes, self.same_docs, self.same_times, np.ones(len(self.same_codes), bool)),
                (2, self.pair_codes, self.pair_docs, self.pair_times, self.new)):
            if len(codes):
                first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                small = np.uint8 if times.max() < 256 else np.int64
                yield (kind, len(codes), codes[first].tobytes(),
                       np.diff(np.concatenate([first, [len(codes)]])).astype(np.uint32).tobytes(),
                       np.add.reduceat(new.astype(np.uint32), first).astype(np.uint32).tobytes(),
                       docs.astype(np.uint16).tobytes(), times.astype(small).tobytes())


_PARTS = ("chunk long, kind int, idx int, doc long, n_a long, n_b long, n_groups long, n_links long, digest string, "
          "entries long, codes binary, sizes binary, new binary, docs binary, times binary")


def _entries(sizes: bytes, docs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = np.frombuffer(docs, np.uint16).astype(np.int64)
    wide = np.int64 if len(times) == 8 * len(docs) else np.uint8
    return np.frombuffer(sizes, np.uint32).astype(np.int64), docs, np.frombuffer(times, wide).astype(np.int64)


def _encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document, and per chunk the entries of its exact groups and of its pairs."""
    names = [x.split()[0] for x in _PARTS.split(", ")]
    binary = [pa.binary()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Bytewise(path_a), Pieces(path_b)
        same = same_bytes(a, b)
        lengths = tuple(np.array([len(x) for x in t.octets], np.int64) for t in (a, b))
        words = [f"{i}{c}" for n, marks in ((a.size, ",|"), (b.size, ",;")) for i in range(n) for c in marks]
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            chunk = Chunk([t for _, t in held], a, b, same, lengths, words)
            n, rows = len(held), list(chunk.arrays())
            m = len(rows)
            columns = [
                pa.array([number] * (n + m)), pa.array([0] * n + [r[0] for r in rows], pa.int32()),
                pa.array([*range(n)] + [None] * m, pa.int32()), pa.array([i for i, _ in held] + [None] * m, pa.int64()),
                *(pa.array(c.tolist() + [None] * m, pa.int64()) for c in (chunk.n_a, chunk.n_b, chunk.n_groups, chunk.n_links)),
                pa.array(chunk.digests + [None] * m, pa.string()), pa.array([None] * n + [r[1] for r in rows], pa.int64()),
                *(pa.array([None] * n + [r[j] for r in rows], t) for j, t in zip(range(2, 7), binary))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                held.append((one, _tokens(text, a, b)))
                size += len(text or "")
                if size >= CHUNK or len(held) == DOCUMENTS:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _PARTS)


def _pair_counts(parts: DataFrame, same: np.ndarray, nb: int) -> DataFrame:
    """(pair, own, n): in how many documents a pair is linked; ``own`` if its sides have the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, codes, new in zip(*(c.to_pylist() for c in batch.columns)):
                codes, new = np.frombuffer(codes, np.int64), np.frombuffer(new, np.uint32).astype(np.int64)
                pair = codes * nb + same[codes] if kind == 1 else codes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair), pa.array(same[pair // nb] == pair % nb), pa.array(new)], names=["pair", "own", "n"])

    rows = parts.where("kind > 0").select("kind", "codes", "new").mapInArrow(run, "pair long, own boolean, n long")
    return rows.groupBy("pair", "own").agg(F.sum("n").alias("n"))


_SUMS = "chunk long, idx int, n_best long, count_sum long"


def _sums(chunk: int, counts: np.ndarray, best: np.ndarray, sizes: np.ndarray, docs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """What the entries of a chunk add up to, by document."""
    n = int(docs.max()) + 1
    total, high, there = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    np.add.at(total, docs, np.repeat(counts, sizes) * times)
    np.add.at(high, docs, np.repeat(best, sizes) * times)
    there[docs] = True
    idx = np.flatnonzero(there)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(idx), chunk)), pa.array(idx.astype(np.int32)), pa.array(high[idx]), pa.array(total[idx])],
        names=["chunk", "idx", "n_best", "count_sum"])


def _exact_sums(parts: DataFrame, own: np.ndarray, best: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.frombuffer(codes, np.int64)
                yield _sums(chunk, own[codes], (own[codes] == best[codes]).astype(np.int64), *_entries(*rest))

    return parts.where("kind = 1").select("chunk", "codes", "sizes", "docs", "times").mapInArrow(run, _SUMS)


def _pair_sums(parts: DataFrame, counts: DataFrame, best: np.ndarray, nb: int) -> DataFrame:
    """Pairs and their counts meet by (bucket of the pair, part of the chunks).

    A pair of many documents is spread over the parts, and its count goes to
    each.  Buckets follow the number of pairs and parts that of the entries, so a
    task has about ENTRIES entries and PAIRS counts, whatever the size.
    """
    entries = parts.where("kind = 2").agg(F.sum("entries")).first()[0] or 0
    buckets = max(1, -(-counts.count() // PAIRS))
    salts = max(1, -(-entries // (ENTRIES * buckets)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                codes, (sizes, docs, times) = np.frombuffer(codes, np.int64), _entries(*rest)
                bucket, rows = codes % buckets, []
                small = np.uint8 if times.max() < 256 else np.int64
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    inside = np.repeat(mine, sizes)
                    rows.append((b, chunk, codes[mine].tobytes(), sizes[mine].astype(np.uint32).tobytes(),
                                 docs[inside].astype(np.uint16).tobytes(), times[inside].astype(small).tobytes()))
                columns = [pa.array(list(c), t) for c, t in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "codes", "sizes", "docs", "times"])

    sent = parts.where("kind = 2").select("chunk", "codes", "sizes", "docs", "times").mapInArrow(
        send, "bucket int, chunk long, codes binary, sizes binary, docs binary, times binary")
    sent = sent.selectExpr("bucket", f"cast(pmod(xxhash64(chunk), {salts}) as int) as salt", "1 as kind", "chunk",
                           "codes", "sizes", "docs", "times")
    known = counts.selectExpr(
        f"cast(pair % {buckets} as int) as bucket", f"explode(sequence(0, {salts - 1})) as salt", "0 as kind", "pair", "n")
    both = sent.unionByName(known, allowMissingColumns=True).select(
        "bucket", "salt", "kind", "pair", "n", "chunk", "codes", "sizes", "docs", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, ns = None, [], []
        for batch in batches:
            bucket, salt, kind, pair, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            key = bucket.astype(np.int64) << 32 | salt
            # runs of one kind and key
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])) if len(key) else []
            for start, stop in zip(edge, [*edge[1:], len(key)]):
                if now != key[start]:
                    now, pairs, ns = key[start], [], []
                if kind[start] == 0:
                    pairs.append(pair[start:stop].astype(np.int64))
                    ns.append(n[start:stop].astype(np.int64))
                    continue
                if len(pairs) > 1:
                    pairs, ns = [np.concatenate(pairs)], [np.concatenate(ns)]
                for i in range(start, stop):
                    chunk, codes, *rest = (batch.column(j)[i].as_py() for j in range(5, 10))
                    codes = np.frombuffer(codes, np.int64)
                    found = ns[0][np.searchsorted(pairs[0], codes)]
                    yield _sums(chunk, found, (found == best[codes // nb]).astype(np.int64), *_entries(*rest))

    dealt = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind", "pair")
    return dealt.mapInArrow(run, _SUMS)


def align(
    docs: DataFrame, id: str = "doc_id", text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE,
) -> tuple[DataFrame, DataFrame]:
    """Align the tokens of A and B of all texts.

    Gives two tables.  Per row: id, n_a, n_b (tokens), n_groups, n_links, n_best,
    count_sum, groups_sha256.  Per pair: a, b and n, the number of documents in
    which the two ids are linked.

    A blank goes in front of each text.  Places where a token of A and one of B
    end cut the text into groups; all tokens of A in a group are linked with all
    of B.  ``n_best`` are the links with the highest count of their id of A,
    ``count_sum`` adds up the counts of all links.  Null and empty texts, and
    texts that the tokens of a side do not spell byte for byte, have no tokens: zeros
    and an empty digest.  Every row is a document, also repeated rows and rows
    without an id (ids are read as long); other columns are ignored.

    The vocabularies bound what the driver gets: two counts per id of A.
    """
    a, b = Bytewise(path_a), Pieces(path_b)
    same, na, nb = same_bytes(a, b), a.size, b.size
    parts = staged(_encoded(docs.select(F.col(id).cast("long"), F.col(text)), path_a, path_b), "tokens")
    counts = staged(_pair_counts(parts, same, nb), "pairs")
    best, own = np.zeros(na, np.int64), np.zeros(na, np.int64)
    for i, high, mine in counts.groupBy(F.expr(f"pair div {nb}").alias("a")).agg(
            F.max("n"), F.max(F.when(F.col("own"), F.col("n")))).collect():
        best[i], own[i] = high, mine or 0
    sums = _exact_sums(parts, own, best).unionByName(_pair_sums(parts, counts.select("pair", "n"), best, nb))
    rows = parts.where("kind = 0").select("chunk", "idx", "doc", "n_a", "n_b", "n_groups", "n_links", "digest")
    done = rows.unionByName(sums, allowMissingColumns=True).groupBy("chunk", "idx").agg(
        F.max("doc").alias(id), *(F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")), F.max("digest").alias("groups_sha256"))
    return done.drop("chunk", "idx"), counts.selectExpr(f"cast(pair div {nb} as int) as a", f"cast(pair % {nb} as int) as b", "n")
