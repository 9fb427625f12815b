"""Session lists built from mappings and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(vault: DataFrame, audit: DataFrame) -> DataFrame:
    """(team, session) with number of mappings and time of the last activity.

    The time is that of the latest audit row, else of the first mapping.  Both
    tables are reduced to one row per session before they meet.
    """
    latest = audit.groupBy("session_id").agg(
        F.max_by("created_at", "id").alias("audit_at")
    )
    per_session = vault.groupBy("team_id", "session_id").agg(
        F.count(F.lit(1)).alias("masked_count"),
        F.min_by("created_at", "id").alias("first_at"),
    )
    return per_session.join(latest, "session_id", "left").select(
        "team_id", "session_id", "masked_count",
        F.coalesce("audit_at", "first_at").alias("created_at"),
    )


def sessions_per_team(vault: DataFrame) -> DataFrame:
    return vault.groupBy("team_id").agg(F.countDistinct("session_id").alias("n_sessions"))


def last_sessions_total(session_list: DataFrame, team: str, n: int = 1000) -> DataFrame:
    """Mappings in the latest ``n`` sessions of a team."""
    latest = (
        session_list.filter(F.col("team_id") == team)
        .orderBy(F.desc("created_at"), "session_id")
        .limit(n)
    )
    return latest.agg(F.coalesce(F.sum("masked_count"), F.lit(0)).alias("total"))
