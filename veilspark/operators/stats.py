"""Daily counters per team and type, kept in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.text import lit

KEYS = ["date", "team_id"]


def counters(updates: DataFrame, stats: str = "stats") -> DataFrame:
    """(date, team, type, n) from updates (date, team, map of type and increment).

    ``organization`` counts as ``org``.  Types without a counter column only add
    to the total, and an update without any positive known type is ignored.
    The total is the type ``total``.  An update is judged by itself, so sums are
    combined before the only shuffle.
    """
    known = ", ".join(lit(c) for c in C.STATS_COLUMNS)
    org = f"""coalesce(try_element_at({stats}, 'org'), 0L) + coalesce(try_element_at({stats}, 'organization'), 0L)"""
    types = f"""filter(concat(
            filter(transform(map_entries({stats}), e -> struct(e.key as entity_type, cast(e.value as bigint) as n)),
                   e -> e.entity_type in ({known}) and e.entity_type <> 'org'),
            array(struct('org' as entity_type, cast({org} as bigint) as n))), e -> e.n > 0)"""
    total = f"aggregate(map_values({stats}), 0L, (a, n) -> a + coalesce(cast(n as bigint), 0L))"
    rows = updates.select(
        "date", F.coalesce("team_id", F.lit("default")).alias("team_id"), F.expr(types).alias("__types"), F.expr(total).alias("__total"),
    ).select(*KEYS, F.expr(
        "inline(if(size(__types) > 0, concat(__types, array(struct('total' as entity_type, __total as n))), __types))"))
    return rows.groupBy(*KEYS, "entity_type").agg(F.sum("n").alias("n"))


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add new counters to stored ones; only the touched dates are recomputed."""
    touched = new.select("date").distinct()
    untouched = old.join(touched, "date", "left_anti")
    again = (
        old.join(touched, "date", "left_semi").unionByName(new)
        .groupBy(*KEYS, "entity_type").agg(F.sum("n").alias("n"))
    )
    return untouched.unionByName(again)


def wide(long: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One ``<type>_count`` column per type, zero where nothing was counted."""
    return long.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("entity_type") == c, F.col("n"))), F.lit(0)).alias(
                f"{c}_count"
            )
            for c in [*C.STATS_COLUMNS, "total"]
        ]
    )


def with_missing_columns(stored: DataFrame) -> DataFrame:
    """Give an older wide table the counter columns it lacks, filled with zero."""
    have = set(stored.columns)
    missing = [f"{c}_count" for c in [*C.STATS_COLUMNS, "total"] if f"{c}_count" not in have]
    return stored.withColumns({c: F.lit(0).cast("long") for c in missing}) if missing else stored


def in_range(long: DataFrame, first: str, last: str) -> DataFrame:
    return long.filter(F.col("date").between(first, last))


def daily(long: DataFrame, first: str, last: str) -> DataFrame:
    """Day series over all teams."""
    return wide(in_range(long, first, last), ["date"])


def history_summary(long: DataFrame, first: str, last: str) -> DataFrame:
    """Sum per type over the range; the row ``days`` counts the days that have data."""
    kept = in_range(long, first, last)
    days = kept.agg(F.lit("days").alias("entity_type"), F.countDistinct("date").alias("n"))
    sums = kept.filter(F.col("entity_type").isin([*C.SUMMARY_COLUMNS, "total"])).groupBy(
        "entity_type"
    ).agg(F.sum("n").alias("n"))
    return sums.unionByName(days)


def team_days(long: DataFrame, team: str, today: str, days: int = 7) -> DataFrame:
    first = F.date_sub(F.lit(today).cast("date"), days).cast("string")
    kept = long.filter((F.col("team_id") == team) & (F.col("date") >= first))
    return wide(kept)


def today_all(long: DataFrame, today: str) -> DataFrame:
    """One row for the day over all teams, zero when nothing was counted."""
    kept = long.filter(F.col("date") == today)
    return wide(kept, []).withColumn("date", F.lit(today))


def team_tier(keys: DataFrame) -> DataFrame:
    """Tier of a team: that of its newest key."""
    return keys.groupBy("team_id").agg(F.max_by("tier", "created_at").alias("tier"))


def board(long: DataFrame, keys: DataFrame, today: str) -> DataFrame:
    """Teams of the day with tier, total and the types that occurred."""
    kept = long.filter(F.col("date") == today)
    per_team = kept.groupBy("team_id").agg(
        F.coalesce(F.sum(F.when(F.col("entity_type") == "total", F.col("n"))), F.lit(0)).alias(
            "total_masked"
        ),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("entity_type").isin(C.BOARD_COLUMNS) & (F.col("n") > 0),
                        F.struct("entity_type", "n"),
                    )
                )
            )
        ).alias("by_type"),
    )
    return (
        per_team.join(team_tier(keys), "team_id", "left")
        .withColumn("tier", F.coalesce("tier", F.lit("free")))
    )


def today_summary(long: DataFrame, today: str) -> DataFrame:
    """Global view of the day: rows per type, ``total`` and ``teams_active``."""
    kept = long.filter(F.col("date") == today)
    teams = kept.agg(
        F.lit("teams_active").alias("entity_type"), F.countDistinct("team_id").alias("n")
    )
    types = kept.filter(F.col("entity_type").isin([*C.BOARD_COLUMNS, "total"])).groupBy(
        "entity_type"
    ).agg(F.sum("n").alias("n"))
    return types.filter("n > 0").unionByName(teams)


def nonzero_types(stats: str) -> str:
    return f"map_filter({stats}, (k, v) -> v > 0)"


def transparency(stats: str) -> tuple[str, str]:
    """(total, comma-joined sorted types) of a stats map, without the key ``total``."""
    total = (
        f"aggregate(map_values(map_filter({stats}, (k, v) -> k <> 'total')), 0L, (a, x) -> a + x)"
    )
    types = (
        f"array_join(array_sort(map_keys(map_filter({stats}, "
        f"(k, v) -> v > 0 and k <> 'total'))), ',')"
    )
    return total, types


def negative_totals(long: DataFrame) -> DataFrame:
    """Sanity check: totals below zero, of which there should be none."""
    return long.filter((F.col("entity_type") == "total") & (F.col("n") < 0))


def history(long: DataFrame, first: str, last: str) -> DataFrame:
    """Total per team and day of a range of days: team_id, date, n."""
    return long.filter((F.col("entity_type") == "total") & F.col("date").between(first, last)).select("team_id", "date", "n")


def types_of_day(long: DataFrame, day: str) -> DataFrame:
    """Counts by type of every team on one day, without zeros: team_id, entity_type, n."""
    return long.filter((F.col("date") == day) & (F.col("entity_type") != "total") & (F.col("n") > 0)).select(
        "team_id", "entity_type", "n")
