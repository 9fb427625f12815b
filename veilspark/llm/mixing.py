"""Mixing sources to target weights by Pfair scheduling; rows meet DataFrame functions only."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from array import array
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import staged

#: Rows of a block, the unit that is scheduled.
BLOCK = 32
#: Without given weights, a source weighs as its size to this power.
TEMPER = 0.7
#: Rows of a numbering group, about.
GROUP = 8_192
#: Slots that the driver hands to Spark at once.
SLOTS = 1 << 20


def served(share: list[int]) -> Iterator[int]:
    """The source that each slot serves, without end.

    Block d of a source with share a of q is released at floor(d q / a)
    and due at ceil((d + 1) q / a); each slot takes the released block that
    is due first.  On one server this meets all deadlines, so at any time a source
    is less than one block away from its share.  Shares are whole numbers of any size.
    """
    q, ready = sum(share), []
    coming = [(0, j, 0) for j, a in enumerate(share) if a]
    for t in itertools.count():
        while coming and coming[0][0] <= t:
            _, j, d = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(d + 1) * q // share[j]), j, d))
        _, j, d = heapq.heappop(ready)
        yield j
        heapq.heappush(coming, ((d + 1) * q // share[j], j, d + 1))


def period(share: list[int]) -> list[int]:
    """The slots after which all sources have their share and all begins again."""
    return list(itertools.islice(served(share), sum(share)))


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in the proportion of the weights as they are written, 0.05 being a twentieth."""
    parts = [Fraction(repr(float(w))) for w in weights]
    unit = math.lcm(*[p.denominator for p in parts])
    return [int(p * unit) for p in parts]


def phases(
    blocks: list[int], weights: list[float], parts: int | None = None,
) -> list[tuple[list[int], Sequence[int], list[int], int]]:
    """Cut the whole run into phases: (shares, the source of each slot, blocks used before, slots of the phase).

    A phase lasts until a slot is due to a source that has no block
    left; the others go on by their weights in the next phase.  Shares are the
    weights themselves, or with ``parts`` their rounding to so many parts.
    Works on one number per source and keeps four bytes per slot.
    """
    left, used, out = list(blocks), [0] * len(blocks), []
    while any(left):
        share = exact([w if n else 0 for w, n in zip(weights, left)])
        if parts is not None:
            total = sum(share)
            share = [max(1, round(Fraction(parts * a, total))) if a else 0 for a in share]
        slots, before = array("i"), list(used)
        for j in served(share):
            if not left[j]:
                break
            left[j] -= 1
            used[j] += 1
            slots.append(j)
        out.append((share, slots, before, len(slots)))
    return out


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, id: str = "doc_id", source: str = "source",
    block: int = BLOCK, parts: int | None = None, slot: str = "mix_slot", position: str = "mix_pos",
    in_order: bool = False,
) -> DataFrame:
    """Add the slot of each row's block and its position in the mixture.

    Rows of a source are ordered by the md5 of their id and cut into blocks; a
    block takes one slot, and ``position`` is unique and ascending over the
    mixture.  Every row appears once.  While sources last, each
    one's blocks are less than one block away from its weight, at any point of a
    run of any length; a source that is used up leaves, and the others share by
    their weights (``parts`` rounds the weights to so many parts first).

    Numbers are given in groups of about GROUP rows: the hash of an id tells, but
    for chance, where in the mixture a row will come, and rows with neighbouring
    places form a group.  So a source that holds a third of all rows is spread over
    many tasks, and with ``in_order`` the same single shuffle brings the rows into
    the order of the mixture: partitions follow each other but for neighbours
    at their ends, and rows ascend in each.  Only one count per source comes to
    the driver; sources are a dimension, not data.  The driver deals the slots
    out one by one, keeps four bytes for each, and writes them to a table.

    Sources without a weight (or one that is not positive) run after all others,
    by size.  A null source is a source of its own; null ids order first; rows
    with equal ids follow each other in any order.  Input columns with the
    output's names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(slot, position)
    sizes = sorted(
        ((r[0], r[1]) for r in docs.groupBy(source).count().collect()), key=lambda r: (r[0] is not None, r[0]))
    if not sizes:
        return docs.withColumns({slot: F.lit(0).cast("long"), position: F.lit(0).cast("long")})
    count = [n for _, n in sizes]
    given = [n ** TEMPER for n in count] if weights is None else [float(weights.get(s) or 0) for s, _ in sizes]
    blocks = [-(-n // block) for n in count]
    plan = phases([b if w > 0 else 0 for b, w in zip(blocks, given)], given, parts)
    for share, order, before, length in phases([b if not w > 0 else 0 for b, w in zip(blocks, given)], count, parts):
        # sources with weights are used up by then
        plan.append((share, order, [b if w > 0 else u for b, u, w in zip(blocks, before, given)], length))

    # one row per phase and source, the blocks it serves there: plain values, whose size
    # Spark knows, so that documents need no shuffle to meet them
    serves, at = [], 0
    for k, (share, _, before, length) in enumerate(plan):
        after = plan[k + 1][2] if k + 1 < len(plan) else blocks
        serves += [f"({at}L, {length}L, {before[j]}L, {after[j]}L, {_quoted(sizes[j][0])})"
                   for j, a in enumerate(share) if a and after[j] > before[j]]
        at += length
    ranges = spark.sql(f"select * from values {', '.join(serves)} as s(phase, length, lo, hi, name)")
    slots = _slots(spark, [order for _, order, _, _ in plan], [None if s is None else str(s) for s, _ in sizes])

    # where a row will come, from its place among all hashes alone: its group, without knowing its number
    rows_of = spark.sql("select * from values " + ", ".join(
        f"({_quoted(s)}, {n}L)" for s, n in sizes) + " as c(source_name, rows)")
    keyed = docs.select(
        F.struct("*").alias("doc"), F.col(id).alias("id"), F.col(source).cast("string").alias("source"),
        F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))).alias("md5"))
    keyed = keyed.join(rows_of, F.col("source").eqNullSafe(F.col("source_name"))).withColumn("guess", F.expr(
        f"cast(floor(cast(conv(substr(md5, 1, 8), 16, 10) as double) / 4294967296 * rows) as bigint) div {block}"))
    keyed = keyed.join(ranges, F.col("source").eqNullSafe(F.col("name")) & F.expr("guess >= lo and guess < hi")).selectExpr(
        "doc", "id", "source", "md5",
        f"(phase + cast((guess - lo) * (length / (hi - lo)) as bigint)) div {max(1, GROUP // block)} as part")
    before = keyed.groupBy(F.col("source").alias("s"), F.col("part").alias("g")).agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "s", "g", "n", "coalesce(sum(n) over (partition by s order by g rows between unbounded preceding and 1 preceding), 0) skip")
    # the slots of a group's blocks come with its count: documents meet one small table
    blocks_of = before.selectExpr("s", "g", "skip", f"explode(sequence(skip div {block}, (skip + n - 1) div {block})) as at")
    before = blocks_of.join(slots, F.col("s").eqNullSafe(F.col("name")) & (F.col("at") == F.col("b"))).groupBy(
        "s", "g", "skip").agg(F.sort_array(F.collect_list(F.struct("b", "slot"))).alias("found")).selectExpr(
        "s", "g", "skip", "found.slot as slots")
    before = staged(before, "counts")
    if in_order:
        keyed = keyed.repartitionByRange("part")
    ranked = keyed.withColumn("i", F.expr("row_number() over (partition by source, part order by md5, id) - 1"))
    placed = ranked.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("g"))).selectExpr(
        "doc", "skip + i as i", f"slots[cast((skip + i) div {block} - skip div {block} as int)] as slot").select(
        "doc.*", F.col("slot").alias(slot), F.expr(f"slot * {block} + i % {block}").alias(position))
    return placed.sortWithinPartitions(position) if in_order else placed


def _slots(spark: SparkSession, orders: list[Sequence[int]], names: list[str | None]) -> DataFrame:
    """Written table of (name, b, slot): the slot of each block of each source."""
    done, tables, at = np.zeros(len(names), np.int64), [], 0
    picked = itertools.chain.from_iterable(orders)
    while len(part := np.fromiter(itertools.islice(picked, SLOTS), np.int32)):
        by = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=len(names))
        nth = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        rows = pa.table({
            "name": pa.array(names, pa.string()).take(pa.array(part[by])),
            "b": pa.array(done[part[by]] + nth), "slot": pa.array(at + by.astype(np.int64))})
        tables.append(staged(spark.createDataFrame(rows), "slots"))
        done += count
        at += len(part)
    return functools.reduce(DataFrame.unionByName, tables)


def _quoted(text: object) -> str:
    if text is None:
        return "cast(null as string)"
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"
