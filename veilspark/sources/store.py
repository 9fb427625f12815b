"""Versioned parquet tables: append, delete, purge, snapshot, restore.

Every change writes its rows as a version of their own and then a list of the
(version, partition) pairs that count from now on.  A list is in force once it
is complete, which its last file tells, so a reader sees the old state or the new
one, and a run that dies in between leaves the old one.  Rows are read by a
semi join with the list.  ``remove_old`` takes away what no longer counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.tables import exists, names_in, remove, shared_folder

VAULT_PARTITIONS = ["team_id", "dt"]


def save_mappings(rows: DataFrame, path: str, day: str = "created_at") -> None:
    """Append vault rows, partitioned by team and day.

    Rows of a partition are brought together before the write, so that a task
    does not write a file for each team and day it meets; a rebalance by
    Spark splits the large ones, so one busy team does not end up in one task.
    ``day`` may coarsen the partitions, for example to the first of the month
    for a long history.
    """
    spark = rows.sparkSession
    rows = (
        rows.withColumn("team_id", F.coalesce("team_id", F.lit("default")))
        .withColumn("dt", F.expr(f"cast(cast({day} as date) as string)"))
        .hint("rebalance", *VAULT_PARTITIONS)
    )
    added = _write(spark, path, rows, VAULT_PARTITIONS)
    number = _current(spark, path)
    _publish(path, added if number is None else _listed(spark, path, number).unionByName(added), number)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count now."""
    return _rows(spark, path, _current(spark, path)).drop("version")


def _current(spark: SparkSession, path: str) -> int | None:
    """The number of the newest complete list."""
    numbers = sorted((int(n) for n in names_in(spark, f"{path}/lists") if n.isdigit()), reverse=True)
    return next((n for n in numbers if exists(spark, f"{path}/lists/{n}/_SUCCESS")), None)


def _listed(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/lists/{number}")


def _rows(spark: SparkSession, path: str, number: int | None) -> DataFrame:
    """All rows that a list names, with the version that wrote them."""
    if number is None:
        raise ValueError(f"no table at {path}")
    stored = spark.read.parquet(f"{path}/data")
    return _among(stored, _listed(spark, path, number), "left_semi")


def _among(stored: DataFrame, listed: DataFrame, kind: str) -> DataFrame:
    """Join with a list by its columns; a partition value may be null."""
    named = listed.select([F.col(c).alias(f"__{c}") for c in listed.columns])
    on = [stored[c].eqNullSafe(named[f"__{c}"].cast(stored.schema[c].dataType)) for c in listed.columns]
    return stored.join(named, on, kind)


def _write(spark: SparkSession, path: str, rows: DataFrame, partitions: list[str]) -> DataFrame:
    """Write rows as a new version; gives the list of its partitions."""
    version = "v" + uuid.uuid4().hex
    rows.write.partitionBy(*partitions).parquet(f"{path}/data/version={version}")
    if not rows.columns or not exists(spark, f"{path}/data/version={version}/_SUCCESS"):
        raise RuntimeError("the version is not complete")
    written = spark.read.schema(rows.schema).parquet(f"{path}/data/version={version}")
    return written.select(F.lit(version).alias("version"), *[F.col(p).cast("string").alias(p) for p in partitions]).distinct()


def _publish(path: str, listed: DataFrame, number: int | None) -> None:
    """Put the next list in force.  Of two changes at once the second fails, since its list is there already."""
    listed.write.parquet(f"{path}/lists/{(number or 0) + 1}")


def delete_rows(
    spark: SparkSession, path: str, doomed: DataFrame, on: list[str],
    partitions: list[str] = VAULT_PARTITIONS,
) -> int:
    """Delete the rows that match ``doomed`` and return how many they were.

    Only partitions that hold such rows are written again.
    """
    keys = doomed.select(*on).distinct()
    return _without(spark, path, lambda df: df.join(keys, on, "left_semi"), lambda df: df.join(keys, on, "left_anti"), partitions)


def purge_before(
    spark: SparkSession, path: str, cutoff: str, partitions: list[str] = VAULT_PARTITIONS
) -> int:
    """Delete rows created before a time; only days up to the cutoff are read."""
    expired = (F.col("dt") <= F.lit(cutoff[:10])) & (F.col("created_at") < F.lit(cutoff).cast("timestamp"))
    kept = F.coalesce(~expired, F.lit(True))
    return _without(spark, path, lambda df: df.filter(expired), lambda df: df.filter(kept), partitions)


def _without(spark: SparkSession, path: str, hit, kept, partitions: list[str]) -> int:
    """Write the partitions that ``hit`` finds rows in again, as ``kept`` leaves them."""
    number = _current(spark, path)
    stored = _rows(spark, path, number)
    counted = hit(stored).groupBy(*[F.col(p).cast("string").alias(p) for p in partitions]).agg(F.count(F.lit(1)).alias("n"))
    note = shared_folder(spark, "touched")
    counted.write.parquet(note)
    touched = spark.read.schema(counted.schema).parquet(note)
    deleted = touched.agg(F.sum("n")).first()[0] or 0
    if deleted:
        again = kept(_among(stored, touched.select(*partitions), "left_semi")).drop("version")
        added = _write(spark, path, again, partitions)
        still = _among(_listed(spark, path, number), touched.select(*partitions), "left_anti")
        _publish(path, still.unionByName(added), number)
    remove(spark, note)
    return deleted


def remove_old(spark: SparkSession, path: str, partitions: list[str] = VAULT_PARTITIONS) -> int:
    """Remove for good what the list in force does not name; returns the number of versions removed.

    Versions of which some partitions still count are written again first, so
    whole folders go.  Readers that began with an older list lose their files: run
    it when they are done.  It can be repeated if it was cut short.
    """
    number = _current(spark, path)
    listed = _listed(spark, path, number)
    stored = spark.read.parquet(f"{path}/data")
    there = stored.select("version", *[F.col(p).cast("string").alias(p) for p in partitions]).distinct()
    mixed = _among(there, listed, "left_anti").select("version").distinct()
    partly = listed.join(mixed, "version", "left_semi")
    if not partly.isEmpty():
        added = _write(spark, path, _among(stored, partly, "left_semi").drop("version"), partitions)
        _publish(path, listed.join(mixed, "version", "left_anti").unionByName(added), number)
        number += 1
    alive = {"version=" + r.version for r in _listed(spark, path, number).select("version").distinct().collect()}  # one per change
    gone = [n for n in names_in(spark, f"{path}/data") if n.startswith("version=") and n not in alive]
    for name in gone:
        remove(spark, f"{path}/data/{name}")
    for n in names_in(spark, f"{path}/lists"):
        if n.isdigit() and int(n) < number:
            remove(spark, f"{path}/lists/{n}")
    return len(gone)


def clear(spark: SparkSession, path: str) -> None:
    """Empty a table, keeping its schema."""
    number = _current(spark, path)
    _publish(path, _listed(spark, path, number).limit(0), number)


def manifest(df: DataFrame) -> DataFrame:
    """Row count and a checksum that does not depend on the order of rows."""
    cols = sorted(df.columns)
    return df.select(F.xxhash64(*cols).alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).cast("long").alias("checksum"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def backup(spark: SparkSession, path: str, target: str) -> None:
    """Write a snapshot and, last, its manifest; without one a snapshot is not valid."""
    stored = load(spark, path)
    stored.write.partitionBy(*VAULT_PARTITIONS).parquet(f"{target}/data")
    manifest(spark.read.parquet(f"{target}/data")).write.json(f"{target}/manifest")


def restore_backup(spark: SparkSession, source: str, path: str, force: bool = False) -> None:
    """Put a snapshot back; refuses a table with rows unless forced, and verifies before it counts."""
    if not force and not _is_empty(spark, path):
        raise ValueError("target has rows; use force to replace them")
    expected = spark.read.json(f"{source}/manifest").first().asDict()
    number = _current(spark, path)
    added = _write(spark, path, spark.read.parquet(f"{source}/data"), VAULT_PARTITIONS)
    got = manifest(_among(spark.read.parquet(f"{path}/data"), added, "left_semi").drop("version")).first().asDict()
    if got != expected:
        raise ValueError(f"the restored rows differ from their manifest: {got} != {expected}")
    _publish(path, added, number)


def _is_empty(spark: SparkSession, path: str) -> bool:
    return _current(spark, path) is None or load(spark, path).isEmpty()
