"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    Only a local session may leave the setting unset; it then gets a folder here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of a value's text, modulo."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether a row is kept from training; one without an id is not."""
    return F.coalesce(remainder(column, modulus) == rest, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(schema: T.StructType, *added: T.StructField) -> T.StructType:
    """The schema with columns added at its end; one of the same name is replaced."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(added))


def thinned_by(id: str, wanted: int, total: int) -> Column:
    """True for about twice as many rows as wanted, by a hash of the id, so that a limit never gathers many."""
    share = min(1.0, 2 * wanted / max(total, 1))
    return F.pmod(F.xxhash64(id), F.lit(1 << 30)) <= int(share * (1 << 30))


def fitted(
    docs: DataFrame, labels: DataFrame, label: str, wanted: tuple[int, int], max_chars: int,
    fit: Callable[[list[tuple[str, int]]], object], id: str = "doc_id", text: str = "text",
) -> object:
    """Train in one task on at most ``wanted`` texts of label 0 and of label 1.

    Rows are chosen by a hash of the id; those whose ``crc32(id) mod 4`` is 2 are
    held out.  Of a text over ``max_chars`` an excerpt of that length is used, whose
    place a hash of the id chooses, so the sample has a size bound.  Null and empty texts and null labels
    take no part, copies of a text count once.  ``fit`` gets the sorted sample, and also an empty one.
    """
    known = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y")).where(
        F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & (remainder("__id", 4) != 2))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where((F.col("__y") == y) & thinned_by("__id", wanted[y], counts.get(y, 0)))
        part = part.orderBy(F.xxhash64("__id"), "__id").limit(wanted[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).where("length(__text) > 0")
    excerpt = f"""substring(__text, 1 + cast(pmod(xxhash64(__id), greatest(0, length(__text) - {max_chars}) + 1) as int), {max_chars})"""
    sample = texts.join(chosen, "__id").selectExpr(f"{excerpt} as __text", "__y").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows)))], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])
