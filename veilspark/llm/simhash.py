"""Near duplicates by SimHash fingerprints, matched around anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import extended, staged, unused
from veilspark.llm.octets import pieces, text_buffers

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
THRESHOLD = 2
#: The binary Golay code: 23 bits, 12 of them free, every point within 3 bits of one code word.
GOLAY_BITS, GOLAY_FREE, GOLAY_RADIUS, GOLAY_POLYNOMIAL = 23, 12, 3, 0xC75

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _add_bits(words: list[bytes], width: int, ones: np.ndarray) -> int:
    """Add the bits of all shingles to the 64 counts; gives the number of shingles."""
    n = len(words) - width + 1
    if n < 1:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())])
    ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return n


def fingerprint(parts: Iterator[bytes]) -> int:
    """The signed 64-bit fingerprint of a text given in parts that end between words."""
    ones, total, words = np.zeros(64, np.int64), 0, []
    for part in parts:
        words += part.lower().split()
        total += (n := _add_bits(words, SHINGLE, ones))
        words = words[n:]  # the last two stay for the next part
    if not total and words:
        total = _add_bits(words, len(words), ones)
    bits = np.packbits(2 * ones > total)
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of the whole text as a long; null and empty texts give zero.

    A column of the output's name is replaced.  One pass, no shuffle; a text is
    handled in parts of about 1 MB.
    """
    schema = extended(docs.schema, T.StructField(out, T.LongType()))
    kept = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(batch.schema.get_field_index(text)))
            found = np.zeros(batch.num_rows, np.int64)
            parts: list[bytes] = []
            last = 0
            for held in pieces(data, ends, _BLANK):
                for row, start, end in held:
                    if row != last:
                        found[last] = fingerprint(iter(parts))
                        parts, last = [], row
                    parts.append(data[start:end].tobytes())
            if batch.num_rows:
                found[last] = fingerprint(iter(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(found)], names=schema.names)

    return docs.mapInArrow(run, schema)


class Anchors:
    """Which anchors lie near a fingerprint.

    An anchor is a pair of Golay code words, one for bits 0-22 and one for bits
    23-45.  Each half has exactly one code word within 3 bits, the home.  If two
    fingerprints differ in at most 2 bits, the home of one lies within 3 + i and
    3 + j bits of the halves of the other, where i + j is at most 2.
    """

    def __init__(self) -> None:
        words = np.zeros(1 << GOLAY_FREE, np.int64)
        for i in range(GOLAY_FREE):
            words ^= np.where((np.arange(1 << GOLAY_FREE) >> i) & 1, GOLAY_POLYNOMIAL << i, 0)
        self.checks = GOLAY_BITS - GOLAY_FREE
        # column b of the parity check: what is left of x^b after division
        left = [1 << b if b < self.checks else 0 for b in range(GOLAY_BITS)]
        for b in range(self.checks, GOLAY_BITS):
            value = left[b - 1] << 1
            left[b] = value ^ GOLAY_POLYNOMIAL if value >> self.checks & 1 else value
        self.left = left
        leaders = [0]
        for a in range(GOLAY_BITS):
            leaders.append(1 << a)
            for b in range(a):
                leaders.append(1 << a | 1 << b)
                leaders += [1 << a | 1 << b | 1 << c for c in range(b)]
        leaders = np.array(leaders, np.int64)
        self.leader = np.zeros(1 << self.checks, np.int64)
        self.leader[self._syndrome(leaders)] = leaders
        # by syndrome and level: what to add to the home to get the code words at distance 3 + level
        near = np.bitwise_count(self.leader[:, None] ^ words[None, :])
        self.steps = []
        for level in range(THRESHOLD + 1):
            hit = near <= GOLAY_RADIUS if level == 0 else near == GOLAY_RADIUS + level
            rows, columns = np.nonzero(hit)
            first = np.searchsorted(rows, np.arange(len(self.leader) + 1))
            self.steps.append((first, words[columns]))

    def _syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for b in range(GOLAY_BITS):
            out ^= np.where((x >> b) & 1, self.left[b], 0)
        return out

    def _half(self, x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, code word) for all code words at a level."""
        s = self._syndrome(x)
        home = x ^ self.leader[s]
        first, words = self.steps[level]
        counts = first[s + 1] - first[s]
        index = np.repeat(np.arange(len(x)), counts)
        within = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
        return index, home[index] ^ words[first[s][index] + within]

    def home(self, f: np.ndarray) -> np.ndarray:
        a, b = self._split(f)
        return (a ^ self.leader[self._syndrome(a)]) << GOLAY_BITS | (b ^ self.leader[self._syndrome(b)])

    def _split(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.int64((1 << GOLAY_BITS) - 1)
        return f & mask, (f >> np.int64(GOLAY_BITS)) & mask

    def near(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into f, anchor) for all anchors whose home fingerprints could link to f."""
        a, b = self._split(f)
        rows, anchors = [], []
        for i in range(THRESHOLD + 1):
            ia, wa = self._half(a, i)
            for j in range(THRESHOLD + 1 - i):
                ib, wb = self._half(b, j)
                first = np.searchsorted(ib, np.arange(len(f) + 1))
                counts = (first[1:] - first[:-1])[ia]
                left = np.repeat(np.arange(len(ia)), counts)
                within = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows.append(ia[left])
                anchors.append(wa[left] << GOLAY_BITS | wb[first[ia[left]] + within])
        return np.concatenate(rows), np.concatenate(anchors)


def links(classes: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Pairs (src < dst) of distinct fingerprints that differ in one or two bits.

    Every fingerprint goes to its home anchor once, and to the about 61 anchors
    within covering radius plus threshold.  One join by anchor compares homes
    with visitors, and finds each pair once.  A fingerprint has at most 2,080
    possible partners, so no group can yield all its pairs.

    Spark sizes both sides by the table that Python read and knows nothing of the 62 rows per
    fingerprint, so it would send the visitors of a small table to the driver: both are shuffled.
    """
    values = classes.select(F.col(column).alias("f")).where("f is not null").distinct()

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(f), 2048):
                rows, at = anchors.near(f[start:start + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(f[start:start + 2048][rows])], names=["anchor", "dst"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.home(f)), pa.array(f)], names=["anchor", "src"])

    left = values.mapInArrow(homes, "anchor long, src long")
    right = values.mapInArrow(visitors, "anchor long, dst long")
    return left.hint("merge").join(right.hint("merge"), "anchor").where(
        "src < dst and bit_count(src ^ dst) <= " + str(THRESHOLD)).select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Rounds of joining every node's larger, then its smaller neighbours to the
    smallest one, until nothing changes.  Each round is written to the shared
    folder; only counts come to the driver.
    """
    now = staged(edges.selectExpr("greatest(src, dst) u", "least(src, dst) v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v u", "m v").unionByName(least.selectExpr("u", "m v"))
        now = staged(small.distinct(), "edges")
        before, state = state, tuple(now.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").first())
        if state == before:
            return now.selectExpr("u node", "v root")


def _marked(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(__id, __key, __f) of every row: its id, the hash of its text, its fingerprint."""
    keyed = docs.select(F.col(id).alias("__id"), F.xxhash64(text).alias("__key"), F.col(text).alias("__text"))
    return staged(fingerprints(keyed, "__text", "__f").select("__id", "__key", "__f"), "prints")


def _roots(marked: DataFrame) -> DataFrame:
    """(__f, __least, __root) of every fingerprint: its smallest id, and the group that it belongs to."""
    classes = marked.groupBy("__f").agg(F.min("__id").alias("__least"))
    roots = components(links(classes, "__f"))
    named = classes.join(roots, classes["__f"] == roots["node"], "left").select(
        "__f", "__least", F.coalesce("root", "__f").alias("__root"))
    return staged(named, "classes")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    fingerprint: str = "fingerprint", component: str = "component_id",
) -> DataFrame:
    """(id, fingerprint, component) for every row: the smallest id it reaches over links.

    Exact copies collapse into one fingerprint before anything is compared, and
    only distinct fingerprints are replicated.  Null and empty texts have
    fingerprint zero and link like any other.  A row with a null id is labelled
    like the others but never names a component (null if no row has an id).
    Repeated rows stay, each with the same label.
    """
    marked = _marked(docs, id, text)
    named = _roots(marked)
    least = named.groupBy("__root").agg(F.min("__least").alias("__component"))
    labels = named.join(least, "__root").select("__f", "__component")
    return marked.join(labels, "__f").select(
        F.col("__id").alias(id), F.col("__f").alias(fingerprint), F.col("__component").alias(component))


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of each near-duplicate group: the one with the smallest id.

    Rows are told apart by their id and the hash of their text, so texts of
    different groups that share an id stay both.  In a group without any id, and among
    texts of a group that share its smallest id, the smallest hash stays.
    Rows that repeat a kept one go.  Columns and other rows stay as they are.

    Only the rows to be removed, and those that repeat, meet the texts.
    """
    marked = _marked(docs, id, text)
    named = _roots(marked).select("__f", "__root")
    own = marked.groupBy("__f", "__id", "__key").agg(F.count(F.lit(1)).alias("__copies")).join(named, "__f")
    own = staged(own.select("__root", "__id", "__key", "__copies"), "members")
    # nulls last: a row without an id is kept only where no row has one
    first = own.groupBy("__root").agg(F.min(F.struct(F.isnull("__id"), "__id", "__key")).alias("__first")).selectExpr(
        "__root as __of", "__first.__id as __keep", "__first.__key as __keepkey")
    same = (F.col("__root") == F.col("__of")) & F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__key") == F.col("__keepkey"))
    gone = staged(own.join(first, same, "left").where("__of is null or __copies > 1").selectExpr(
        "__id", "__key", "__of is not null as __again"), "gone")

    def among(rows: DataFrame, kind: str) -> DataFrame:
        chosen = rows.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"))
        return docs.join(chosen, docs[id].eqNullSafe(chosen["__i"]) & (F.xxhash64(docs[text]) == chosen["__k"]), kind)

    out = among(gone, "left_anti")
    again = gone.where("__again")
    if not again.isEmpty():
        key = unused(docs, "__key")
        out = out.unionByName(among(again, "left_semi").withColumn(key, F.xxhash64(text)).dropDuplicates([id, key]).drop(key))
    return out
