"""Language of a text by prediction by partial matching: code lengths under byte context trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import extended, remainder, staged, unused
from veilspark.llm.octets import LOWER, pieces, text_buffers

#: Longest context in bytes.
ORDER = 3
#: Training texts of each language at most, and the characters of one that are used.
SAMPLE, SAMPLE_CHARS = 300, 10_000
#: Languages whose tables are in memory at once.
TOGETHER = 8
UNKNOWN = "und"
#: A document is rejected if its language is unknown or its likeliest language scores less.
THRESHOLD = 0.5


def _symbols() -> np.ndarray:
    """Bytes that are told apart: letters in lower case, bytes beyond ASCII, blank; digits and the rest folded."""
    fold = LOWER.copy()
    fold[0x30:0x3A] = 0x30
    other = np.ones(256, bool)
    other[0x61:0x7B] = other[0x80:] = other[0x30] = False
    fold[other[fold]] = 0x20
    return fold


FOLD = _symbols()


def counted(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of a language: runs of four folded bytes as numbers, ascending, and how often they occur."""
    raw = " ".join(texts).encode()
    s = FOLD[np.frombuffer(b" " * ORDER + raw + b" ", np.uint8)].astype(np.uint32)
    runs = s[ORDER:].copy()
    for i in range(1, ORDER + 1):
        runs |= s[ORDER - i:len(s) - i] << np.uint32(8 * i)
    return np.unique(runs, return_counts=True)


def fit(texts: dict[str, list[str]]) -> dict | None:
    """A model from texts of each language."""
    return model_of({k: counted(v) for k, v in texts.items() if any(v)})


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """The statistics of all languages and the symbols that any of them uses."""
    names = sorted(counts)
    if not names:
        return None
    used = np.zeros(256, bool)
    for name in names:
        used[np.unique(counts[name][0].astype("<u4").view(np.uint8))] = True
    used[0x20] = True
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, used.sum() + 1)  # symbol 0: a byte never seen
    return {"names": names, "code": symbol[FOLD], "symbol": symbol, "size": int(used.sum()) + 1,
            "counts": [counts[name] for name in names], "made": {}}


def tables(model: dict, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Frozen statistics of TOGETHER languages, as one table over contexts; the last one made is kept.

    A context tree of order three is kept as an array of rows: one row for each
    context that occurs in any of the languages, found by the last three symbols.  In a
    row a language's code length follows escape method C with exclusion: a
    symbol seen n times in the context has probability n / (total + distinct);
    the escape share goes to the unseen symbols as the shorter context, without
    the seen ones, spreads it.  The shortest context spreads evenly.
    """
    if first in model["made"]:
        return model["made"][first]
    model["made"].clear()
    size, symbol = model["size"], model["symbol"]
    counts = []
    for runs, often in model["counts"][first:first + TOGETHER]:
        number = np.zeros(len(runs), np.int64)
        for i in range(ORDER, -1, -1):
            number = number * size + symbol[(runs >> np.uint32(8 * i)) & np.uint32(0xFF)]
        counts.append((number, often))

    # contexts of each order that occur, and a row for each; row 0 is the empty context
    contexts = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        contexts.append(np.unique(np.concatenate([g % size ** (k + 1) // size for g, _ in counts])))
    base = np.cumsum([0] + [len(c) for c in contexts])
    table = np.zeros((int(base[-1]), size, len(counts)), np.float32)
    for i, (runs, often) in enumerate(counts):
        shorter = np.full((1, size), 1.0 / size)
        for k in range(ORDER + 1):
            if k:  # a context's shorter one drops its first symbol
                shorter = prob[np.searchsorted(contexts[k - 1], contexts[k] % size ** (k - 1))]
            grams = runs % size ** (k + 1)
            at = np.searchsorted(contexts[k], grams // size)
            count = np.bincount(at * size + grams % size, often, minlength=len(contexts[k]) * size).reshape(-1, size)
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            rest = np.where(count > 0, 0, shorter)
            left = rest.sum(1, keepdims=True)
            # with every symbol seen there is nothing to escape to
            escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
            seen = count / np.maximum(np.where(left > 0, total + kinds, total), 1)
            prob = np.where(total > 0, seen + escape * rest / np.where(left > 0, left, 1), shorter)
            table[base[k]:base[k + 1], :, i] = -np.log2(prob)
    # for any three symbols, the row of the longest context known
    row = np.zeros(size ** ORDER, np.int32)
    every = np.arange(size ** ORDER)
    for k in range(1, ORDER + 1):
        tail = every % size ** k
        at = np.minimum(np.searchsorted(contexts[k], tail), len(contexts[k]) - 1)
        row = np.where(contexts[k][at] == tail, base[k] + at, row).astype(np.int32)
    model["made"][first] = row, table.reshape(-1, len(counts))
    return model["made"][first]


def code_lengths(model: dict, first: int, symbols: np.ndarray) -> np.ndarray:
    """Bits of TOGETHER languages for every symbol after the first three, one row per symbol."""
    size = model["size"]
    row, bits = tables(model, first)
    context = (symbols[:-3] * size + symbols[1:-2]) * size + symbols[2:-1]
    return bits[row[context] * size + symbols[3:]]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def score(
    docs: DataFrame, model: dict | None, text: str = "text",
    out: str = "lang_pred", probability: str = "lang_score",
) -> DataFrame:
    """Add the language of the whole text and its probability among the learned ones.

    One pass, no shuffle.  Null texts and texts without a letter are ``und`` with
    score zero, as is everything without a model.  Equal code lengths go to the
    language that sorts first.  Input columns with the output's names are replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(model)  # up to 8 bytes for each run of four bytes that a language has
    lettered = unused(docs, "__letter")
    docs = docs.withColumn(lettered, has_letter(F.col(text)))
    schema = extended(docs.schema, T.StructField(out, T.StringType()), T.StructField(probability, T.DoubleType()))
    kept = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spec.value
        for batch in batches:
            n = batch.num_rows
            letter = batch.column(batch.schema.get_field_index(lettered)).to_numpy(zero_copy_only=False).astype(bool)
            names, value = np.full(n, UNKNOWN, object), np.zeros(n)
            if model and letter.any():
                data, ends = text_buffers(batch.column(batch.schema.get_field_index(text)))
                bits = np.zeros((n, len(model["names"])))
                for first in range(0, len(model["names"]), TOGETHER):
                    for held in pieces(data, ends, None):
                        _add(model, data, ends, held, bits, first)
                best = bits.argmin(axis=1)
                gap = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
                value = np.where(letter, 1 / gap.sum(axis=1), 0.0)
                names = np.where(letter, np.array(model["names"], object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(names, pa.string()), pa.array(value)], names=schema.names)

    return docs.mapInArrow(run, schema).drop(lettered)


def _add(
    model: dict, data: np.ndarray, ends: np.ndarray, held: list[tuple[int, int, int]], bits: np.ndarray,
    first: int | None = None,
) -> None:
    """Add code lengths of pieces to their rows; a later piece of a text knows the three symbols before it.

    Only those of TOGETHER languages if ``first`` is given, the others being left as they are.
    """
    if first is None:
        for first in range(0, len(model["names"]), TOGETHER):
            _add(model, data, ends, held, bits, first)
        return
    blank = model["code"][0x20]
    lengths = np.array([e - s + ORDER for _, s, e in held])
    at = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.full(int(at[-1]), blank)
    for (row, s, e), a in zip(held, at.tolist()):
        symbols[a + ORDER:a + ORDER + e - s] = model["code"][data[s:e]]
        if s > ends[row]:
            before = data[max(int(ends[row]), s - ORDER):s]
            symbols[a + ORDER - len(before):a + ORDER] = model["code"][before]
    if len(symbols) <= ORDER:
        return
    found = code_lengths(model, first, symbols)
    total = np.zeros((len(symbols) + 1, found.shape[1]))
    # bits of the symbol at position i stand at i + 1, so that differences give pieces
    np.cumsum(found, axis=0, dtype=np.float64, out=total[ORDER + 1:])
    for (row, _, _), a, b in zip(held, at.tolist(), at[1:].tolist()):
        bits[row, first:first + TOGETHER] += total[b] - total[a + ORDER]


def trained(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """Learn every language from at most SAMPLE of its texts whose ``crc32(id) mod 3`` is not 1.

    Texts without a letter teach nothing and do not count; of a long text SAMPLE_CHARS
    from its first letter on are used.  Each language is counted in a group of its
    own and the counts are written to a table; only they come to the driver.
    """
    known = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        F.col("l").isNotNull() & (F.col("l") != UNKNOWN) & (F.coalesce(remainder("i", 3), F.lit(0)) != 1)
        & has_letter(F.col("t"))).withColumn("h", F.pmod(F.xxhash64("i"), F.lit(1 << 30)))
    sizes = staged(known.groupBy("l").agg(F.count(F.lit(1)).alias("size"), F.min("h").alias("least")), "languages")
    # thinned to about twice the sample of each language, so no task gathers one; the smallest hash always stays
    part = known.join(sizes, "l").where(f"h <= greatest(least, cast({2 * SAMPLE} / size * {1 << 30} as bigint))")
    part = part.select("l", "i", F.when(F.length("t") <= SAMPLE_CHARS, F.col("t")).otherwise(
        F.expr(rf"substring(t, regexp_instr(t, r'\p{{L}}'), {SAMPLE_CHARS})")).alias("t"))
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", F.xxhash64("t")))).where(
        F.col("n") <= SAMPLE).select("l", "t")

    def count(group: pa.Table) -> pa.Table:
        runs, often = counted(sorted(set(group.column("t").to_pylist())))
        return pa.table({"l": pa.array([group.column("l")[0].as_py()], pa.string()),
                         "runs": pa.array([runs.astype("<u4").tobytes()], pa.binary()),
                         "often": pa.array([often.astype("<u4").tobytes()], pa.binary())})

    made = staged(part.groupBy("l").applyInArrow(count, "l string, runs binary, often binary"), "statistics")
    return model_of({r.l: (np.frombuffer(r.runs, "<u4"), np.frombuffer(r.often, "<u4")) for r in made.collect()})


def accepted(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The documents whose language is known and clear, columns as they were."""
    name, value = unused(docs, "__lang"), unused(docs, "__score")
    return score(docs, model, text, name, value).where(
        (F.col(name) != UNKNOWN) & (F.col(value) >= THRESHOLD)).drop(name, value)
