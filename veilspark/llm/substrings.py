"""Removal of repeated word runs, found by windows at positions of a difference cover.

Positions 0, 1 and 3 modulo 7 cover all differences: however two equal runs are
shifted against each other, among any 7 places in a row there is one that lies on
a covered position in both.  So two equal runs of 13 words share a window of 7
words that both sides hash.  Hashes that two documents share are the anchors; all
13-word windows through an anchor are compared in a second exchange, and nothing
else is.

Texts travel as compressed chunks, hashes as sorted arrays per chunk and bucket:
a hash counts once in a chunk, so copies and common passages send little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged
from veilspark.llm.octets import Rolling, joined, pieces, text_buffers

#: Words that must agree in a row.
SPAN = 13
#: A perfect difference set, and the words of an anchor: PERIOD + ANCHOR - 1 = SPAN.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = SPAN + 1 - PERIOD
#: Bytes of text and documents in a chunk (a longer text is a chunk by itself), bytes of text for each bucket of hashes.
CHUNK, DOCUMENTS, BUCKET = 8 << 20, 1 << 16, 64 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


def normal(text: np.ndarray) -> bytes:
    """Words joined by single blanks."""
    return b" ".join(text.tobytes().split())


def word_hashes(text: np.ndarray) -> np.ndarray:
    """One hash per word of a normalised text, worked out in parts of about 1 MB."""
    out = []
    ends = np.array([0, len(text)], np.int64)
    for held in pieces(text, ends, _BLANK):
        octets, _ = joined(text, held)
        flag = np.concatenate([[False], ~_BLANK[octets]])
        edge = np.flatnonzero(flag[1:] != flag[:-1])
        out.append(Rolling(octets)(edge[0::2], edge[1::2]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words."""
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * _STEP + words[j:n + j]
    total ^= total >> np.uint64(31)
    return total * _STEP


class Chunk:
    """Documents of one chunk in order of id; those without an id come last and take no part."""

    def __init__(self, ids: list, packed: bytes, sizes: bytes):
        self.ids = ids
        self.known = np.array([i for i in ids if i is not None], np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])

    def of(self, i: int) -> np.ndarray:
        return self.text[self.ends[i]:self.ends[i + 1]]

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(index, word hashes) of the documents that may share something."""
        for i in range(len(self.known)):
            if self.ends[i + 1] - self.ends[i] >= 2 * SPAN - 1:
                words = word_hashes(self.of(i))
                if len(words) >= SPAN:
                    yield i, words


def pack(docs: list[tuple[object, bytes]]) -> tuple[list, bytes, bytes]:
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    sizes = np.array([len(t) for _, t in docs], np.int64).tobytes()
    return [i for i, _ in docs], zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in docs)), sizes


def _covered(n: int) -> np.ndarray:
    """Covered positions below n."""
    at = np.arange(0, n, PERIOD)[:, None] + np.array(COVER)
    at = at.ravel()
    return at[at < n]


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = run_hashes(words, ANCHOR)
    at = _covered(len(hashes))
    return at, hashes[at]


def _edges(codes: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Where each bucket lies in sorted codes; the top bits of a code name its bucket."""
    bucket = ((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(codes) else []
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(first, [*first[1:], len(codes)])]


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8))[:n].astype(bool)


def _repeated(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, their smallest and their largest owner."""
    order = np.lexsort((owners, codes))
    codes, owners = codes[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(codes)]]).astype(np.int64) - 1
    return codes[first], owners[first], owners[last]


_CHUNKS = "chunk long, ids array<long>, packed binary, sizes binary"


def chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Texts with blanks normalised, in compressed chunks with a number of their own.

    Write the result before using it twice: the numbers depend on how the input was split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            ids, packed, sizes = pack(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([packed], pa.binary()),
                 pa.array([sizes], pa.binary())], names=["chunk", "ids", "packed", "sizes"])

        for batch in batches:
            data, ends = text_buffers(batch.column(1))
            for i, one in enumerate(batch.column(0).to_pylist()):
                words = normal(data[ends[i]:ends[i + 1]])
                held.append((one, words))
                size += len(words) + 16
                if size >= CHUNK or len(held) == DOCUMENTS:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, _CHUNKS)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            number, ids, packed, sizes = (batch.column(j)[i].as_py() for j in range(4))
            yield number, Chunk(ids, packed, sizes)


def _anchor_codes(found: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of the documents of a chunk in order, with the first and last document that has each."""
    codes = [_anchors(words)[1] for _, words in found]
    return _repeated(np.concatenate(codes), np.repeat([i for i, _ in found], [len(c) for c in codes]))


def anchors(parts: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, shared): one bit per distinct anchor of the chunk, in order: another document has it.

    Inside a bucket 32 bits tell hashes apart; a chance agreement only costs a comparison.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _opened(batches):
            found = list(chunk.runs())
            if not found:
                continue
            codes, least, most = _anchor_codes(found)
            twice, edges = chunk.known[least] != chunk.known[most], _edges(codes, buckets)
            yield pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in edges], pa.int32()), pa.array([number] * len(edges), pa.int64()),
                pa.array([codes[x].astype(np.uint32).tobytes() for _, x in edges], pa.binary()),
                pa.array([np.packbits(twice[x]).tobytes() for _, x in edges], pa.binary())],
                names=["bucket", "chunk", "codes", "twice"])

    def answer(part: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c.as_py(), np.uint32) for c in part.column("codes")]
        own = [c[_bits(t.as_py(), len(c))] for c, t in zip(codes, part.column("twice"))]
        every = np.sort(np.concatenate(codes + own))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        return pa.table([part.column("chunk"), part.column("bucket"),
                         pa.array([np.packbits(_within(c, shared)).tobytes() for c in codes], pa.binary())],
                        names=["chunk", "bucket", "shared"])

    sent = parts.mapInArrow(send, "bucket int, chunk long, codes binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, shared binary")


def _within(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def _through(words: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which 13-word windows of a document contain a shared anchor."""
    at, codes = _anchors(words)
    hit = _within(codes, shared)
    windows = len(words) - SPAN + 1
    edge = np.zeros(windows + 1, np.int64)
    np.add.at(edge, np.maximum(0, at[hit] - PERIOD + 1), 1)
    np.add.at(edge, np.minimum(windows, at[hit] + 1), -1)
    return np.cumsum(edge)[:windows] > 0


def _results(rows: list[tuple]) -> list[pa.Array]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)]


_NAMES = ["id", "n_words", "n_removed", "kept_sha256", "removed"]
_RESULT = "id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _untouched(id: int | None, text: np.ndarray) -> tuple:
    n = int(np.count_nonzero(text == 32)) + 1 if len(text) else 0
    return id, n, 0, hashlib.sha256(text.tobytes()).hexdigest(), []


def _suspects(parts: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Results of documents without an anchor, and chunks of those with one.

    Chunks and their anchors meet by number, sorted so that anchors come first.
    """
    both = shared.selectExpr("chunk", "0 as kind", "bucket", "shared").unionByName(
        parts.selectExpr("chunk", "1 as kind", "ids", "packed", "sizes"), allowMissingColumns=True).select(
        "chunk", "kind", "bucket", "shared", "ids", "packed", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, kind, bucket, bits, ids, packed, sizes = (c[i].as_py() for c in batch.columns)
                if number != now:
                    now, known = number, {}
                if kind == 0:
                    known[bucket] = bits
                    continue
                chunk, held, marks = Chunk(ids, packed, sizes), [], {}
                found = list(chunk.runs())
                codes = _anchor_codes(found)[0] if found else np.zeros(0, np.uint64)
                common = [codes[x][_bits(known[b], x.stop - x.start)] for b, x in _edges(codes, buckets)]
                common = np.concatenate(common) if common else codes
                for k, words in found:
                    through = _through(words, common)
                    if through.any():
                        marks[k] = np.packbits(through).tobytes()
                        held.append((ids[k], chunk.of(k).tobytes()))
                rows = [_untouched(ids[k], chunk.of(k)) for k in range(len(ids)) if k not in marks]
                # the chosen documents are in order already, so their windows stay beside them
                again = pack(held) if held else (None, None, None)
                n = len(rows) + bool(held)
                blank = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * n, pa.int64()), *_results(rows + [(None,) * 5] * bool(held)),
                    pa.array(blank + [again[0]] * bool(held), pa.list_(pa.int64())),
                    pa.array(blank + [again[1]] * bool(held), pa.binary()), pa.array(blank + [again[2]] * bool(held), pa.binary()),
                    pa.array(blank + [[marks[k] for k in sorted(marks)]] * bool(held), pa.list_(pa.binary()))],
                    names=["chunk", *_NAMES, "ids", "packed", "sizes", "marks"])

    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(run, f"chunk long, {_RESULT}, ids array<long>, packed binary, sizes binary, marks array<binary>")


def _windows(chunk: Chunk, marks: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(index, words, positions, hashes) of the windows in question."""
    for k, bits in enumerate(marks):
        words = word_hashes(chunk.of(k))
        hashes = run_hashes(words, SPAN)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:len(hashes)])
        yield k, len(words), at, hashes[at]


def _window_codes(chunk: Chunk, marks: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The windows in question, their distinct hashes in order and the first document of the chunk that has each."""
    found = list(_windows(chunk, marks))
    codes, least, _ = _repeated(
        np.concatenate([w[3] for w in found]), np.repeat([w[0] for w in found], [len(w[3]) for w in found]))
    return found, codes, least


def _first_owners(suspects: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, earlier, first): of the windows of a chunk, in order, which occur under a smaller id elsewhere, and that id."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, packed, sizes, marks = (c[i].as_py() for c in batch.columns)
                chunk = Chunk(ids, packed, sizes)
                _, codes, least = _window_codes(chunk, marks)
                rows = []
                for b, x in _edges(codes, buckets):
                    used, owner = np.unique(least[x], return_inverse=True)
                    rows.append((b, number, codes[x].tobytes(), owner.astype(np.uint16).tobytes(), chunk.known[used].tobytes()))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "chunk", "codes", "owner", "ids"])

    def answer(part: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c.as_py(), np.uint64) for c in part.column("codes")]
        owners = [np.frombuffer(i.as_py(), np.int64)[np.frombuffer(o.as_py(), np.uint16)]
                  for o, i in zip(part.column("owner"), part.column("ids"))]
        known, first, _ = _repeated(np.concatenate(codes), np.concatenate(owners))
        back = []
        for c, own in zip(codes, owners):
            smallest = first[np.searchsorted(known, c)]
            earlier = smallest < own
            back.append((np.packbits(earlier).tobytes(), smallest[earlier].tobytes()))
        return pa.table([part.column("chunk"), part.column("bucket"), pa.array([b[0] for b in back], pa.binary()),
                         pa.array([b[1] for b in back], pa.binary())], names=["chunk", "bucket", "earlier", "first"])

    sent = suspects.select("chunk", "ids", "packed", "sizes", "marks").mapInArrow(
        send, "bucket int, chunk long, codes binary, owner binary, ids binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, earlier binary, first binary")


def _removed(suspects: DataFrame, owners: DataFrame, buckets: int) -> DataFrame:
    both = owners.selectExpr("chunk", "0 as kind", "bucket", "earlier", "first").unionByName(
        suspects.selectExpr("chunk", "1 as kind", "ids", "packed", "sizes", "marks"), allowMissingColumns=True).select(
        "chunk", "kind", "bucket", "earlier", "first", "ids", "packed", "sizes", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, kind, bucket, earlier, first, ids, packed, sizes, marks = (x[i].as_py() for x in batch.columns)
                if number != now:
                    now, known = number, {}
                if kind == 0:
                    known[bucket] = earlier, first
                    continue
                chunk, rows = Chunk(ids, packed, sizes), []
                found, codes, least = _window_codes(chunk, marks)
                smallest = chunk.known[least]
                for b, x in _edges(codes, buckets):
                    there = x.start + np.flatnonzero(_bits(known[b][0], x.stop - x.start))
                    smallest[there] = np.frombuffer(known[b][1], np.int64)
                for k, n, at, hashes in found:
                    at = at[smallest[np.searchsorted(codes, hashes)] < ids[k]]
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + SPAN, -1)
                    rows.append(_without(ids[k], chunk.of(k), np.cumsum(gone[:n]) > 0))
                yield pa.RecordBatch.from_arrays(_results(rows), names=_NAMES)

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, _RESULT)


def _without(id: int, text: np.ndarray, gone: np.ndarray) -> tuple:
    """The result for a text without some of its words; runs of these are listed as spans."""
    if not gone.any():
        return _untouched(id, text)
    ends = np.concatenate([np.flatnonzero(text == 32), [len(text)]])
    lengths = np.diff(ends, prepend=-1)
    lengths[-1] -= 1  # no blank after the last word
    rest = text[np.repeat(~gone, lengths)].tobytes().rstrip(b" ")
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    spans = [{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
    return id, len(gone), int(gone.sum()), hashlib.sha256(rest).hexdigest(), spans


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and ``removed``, the spans of words (end excluded) that go.

    Words are runs without blanks.  A word goes if it lies in 13 words in a row
    that also occur in a document with a smaller id; windows are judged on the
    input.  Null and empty texts have no words.  A row with a null id keeps all
    words and takes none from others.  Rows that share an id take nothing from each
    other; each gives a row.  Other columns are ignored, ids are read as long.

    Two exchanges of hashes and one of compressed texts; memory follows a chunk
    or a bucket.  Windows are compared by 64-bit hashes.
    """
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    parts = staged(chunks(docs, id, text), "chunks")
    suspects = staged(_suspects(parts, staged(anchors(parts, buckets), "anchors"), buckets), "suspects")
    held = suspects.where("ids is not null")
    done = suspects.where("ids is null").select(*_NAMES).unionByName(_removed(held, _first_owners(held, buckets), buckets))
    return done.withColumnRenamed("id", id)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated words taken out of their texts; ``id`` must be unique.

    Texts that lose nothing stay as they are; of the others the kept words are joined by one blank.
    """
    found = staged(repeats(docs, id, text).where("n_removed > 0").selectExpr(f"{id} as __id", "removed as __removed"), "removed")
    both = docs.join(found, docs[id] == found["__id"], "left").select(*docs.columns, "__removed")
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    words, kept, last = one.encode().split(), [], 0
                    for span in [*spans, {"start": len(words), "end": 0}]:
                        kept += words[last:span["start"]]
                        last = span["end"]
                    one = b" ".join(kept).decode()
                out.append(one)
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
