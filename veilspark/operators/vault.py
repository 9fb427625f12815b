"""The mapping table: build, look up, protect, expire."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import lit


def mapping_rows(
    masked: DataFrame, session: str = "session_id", team: str | None = None,
    created_at: str = "current_timestamp()", data_type: str = "m.entity_type",
) -> DataFrame:
    """One vault row per placeholder of masked texts.

    The row id is a hash of session and placeholder: the same input gives the
    same ids however the job is split or retried.
    """
    team_sql = f"coalesce({team}, 'default')" if team else "'default'"
    return masked.withColumn("m", F.explode("mappings")).selectExpr(
        f"xxhash64({session}, m.placeholder) as id",
        f"{session} as session_id",
        "m.placeholder as placeholder",
        "m.value as real_value",
        f"{data_type} as data_type",
        f"{team_sql} as team_id",
        f"cast({created_at} as timestamp) as created_at",
    )


def all_mappings(*sources: DataFrame) -> DataFrame:
    """placeholder -> value over several tables; earlier tables and rows win.

    A minimum is combined on the map side, so a placeholder that every session
    uses does not collect in one task.
    """
    tagged = None
    for i, df in enumerate(sources):
        part = df.select("placeholder", "real_value", F.lit(i).alias("src"), "id")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("placeholder").agg(
        F.min_by("real_value", F.struct("src", "id")).alias("real_value")
    )


def lookup(vault: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of a batch of (session_id, placeholder) pairs; null when unknown."""
    on = ["session_id", "placeholder"]
    pairs = wanted.select(*on).distinct()
    known = vault.join(pairs, on, "left_semi").groupBy(*on).agg(
        F.min_by("real_value", "id").alias("real_value")
    )
    return pairs.join(known, on, "left")


def without_sessions(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    return vault.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def vault_key(secret: str) -> bytes:
    """A 32-byte secret is the key itself, any other is hashed to 32 bytes."""
    raw = secret.encode("utf-8")
    return raw if len(raw) == 32 else hashlib.sha256(raw).digest()


def _key(df: DataFrame, secret: str) -> Column:
    """The key as a value read from a one-row table, so that no plan or event log spells it out."""
    rows = df.sparkSession.createDataFrame([(bytearray(vault_key(secret)),)], "k binary")
    return rows.select("k").scalar()


def encrypt_values(df: DataFrame, secret: str, column: str = "real_value") -> DataFrame:
    """base64(nonce, cipher text, tag) by AES-256-GCM, random nonce per value."""
    return df.withColumn(column, F.base64(F.aes_encrypt(F.col(column), _key(df, secret), F.lit("GCM"))))


def decrypt_values(df: DataFrame, secret: str, column: str = "real_value") -> DataFrame:
    """Decrypt; values that are not valid cipher text come back as stored."""
    return df.withColumn(column, F.coalesce(decrypted(df, column, secret), F.col(column)))


def decrypted(df: DataFrame, column: str, secret: str) -> Column:
    """Plain text of a cipher column, null when it cannot be decrypted."""
    raw = F.try_to_binary(F.col(column), F.lit("base64"))
    return F.try_aes_decrypt(raw, _key(df, secret), F.lit("GCM")).cast("string")


def retention_hours(hours: int | None, ttl_seconds: int) -> int:
    return hours if hours is not None else max(1, ttl_seconds // 3600)


def split_expired(vault: DataFrame, now: str, hours: int) -> DataFrame:
    """Flag rows older than the given number of hours before ``now``."""
    cutoff = f"timestamp {lit(now)} - interval {hours} hours"
    return vault.withColumn("expired", F.expr(f"created_at < {cutoff}"))
