"""Request log: counters, latency, errors, routing, access."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import catalog as C


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("endpoint", "method", "status").agg(F.count(F.lit(1)).alias("n"))


QUANTILES = (50, 95, 99)
#: How closely a first pass brackets a quantile: ranks are off by one in so many at most.
BRACKET = 10_000


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative buckets, sum, count and exact quantiles (p50, p95, p99) per endpoint.

    A quantile is the smallest latency that this share of the requests does not
    exceed.  A sketch first brackets it between two latencies; then those below are
    counted, and only the few inside the bracket are put in order.
    """
    buckets = [
        F.sum((F.col("latency") <= b).cast("long")).alias(bucket_name(b))
        for b in C.LATENCY_BUCKETS
    ]
    around = [min(1.0, max(0.0, q / 100 + d / BRACKET)) for q in QUANTILES for d in (-3, 3)]
    totals = log.groupBy("endpoint").agg(
        *buckets,
        F.sum("latency").alias("latency_sum"),
        F.count(F.lit(1)).alias("n"),
        F.count("latency").alias("__n"),
        F.percentile_approx("latency", around, BRACKET).alias("__around"),
    )
    ranges = "array(" + ", ".join(
        f"named_struct('q', {q}, 'low', __around[{2 * i}], 'high', __around[{2 * i + 1}], "
        f"'rank', greatest(1L, __n - cast(floor(__n - {q / 100}D * __n) as bigint)))" for i, q in enumerate(QUANTILES)) + ")"
    bounds = totals.selectExpr("endpoint as __of", f"inline({ranges})")
    counted = log.filter("latency is not null").groupBy("endpoint", "latency").agg(F.count(F.lit(1)).alias("n"))
    near = counted.join(bounds, F.col("endpoint").eqNullSafe(F.col("__of"))).groupBy(
        "__of", "q", "rank", F.expr("if(latency between low and high, latency, null) as latency"),
        F.expr("latency < low as below")).agg(F.sum("n").alias("n")).filter("below or latency is not null")
    upto = Window.partitionBy("__of", "q").orderBy(F.desc("below"), "latency").rowsBetween(Window.unboundedPreceding, 0)
    found = near.withColumn("upto", F.sum("n").over(upto)).filter("not below and upto >= rank").groupBy("__of").agg(
        *[F.min(F.expr(f"if(q = {q}, latency, null)")).alias(f"p{q}") for q in QUANTILES])
    return totals.drop("__n", "__around").join(found, F.col("endpoint").eqNullSafe(F.col("__of")), "left").drop("__of")


def bucket_name(bound: float) -> str:
    return "le_inf" if bound == float("inf") else "le_" + str(bound).replace(".", "_")


def error_counts(log: DataFrame) -> DataFrame:
    return log.filter("status >= 500").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def entity_totals(texts: DataFrame, stats: str = "stats", dry_run: str = "dry_run") -> DataFrame:
    """Detected and masked entities by type; dry runs only count as detected."""
    rows = texts.select(F.col(dry_run).alias("dry_run"), F.explode(stats).alias("entity_type", "n"))
    return rows.groupBy("entity_type").agg(
        F.sum("n").alias("detected"),
        F.sum(F.when(~F.col("dry_run"), F.col("n")).otherwise(0)).alias("masked"),
    )


def latest_health(outcomes: DataFrame, node: str = "node") -> DataFrame:
    """Latest state of every node from rows with ``streak``."""
    return outcomes.groupBy(node).agg(
        F.max_by((F.col("streak") < C.FAILURES_TO_UNHEALTHY).cast("int"), "id").alias("healthy")
    )


def route(log: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """Destination of a model: its own route, else the one for ``*``, else the default."""
    star = routes.agg(F.min(F.expr("if(model = '*', target, null)")).alias("__star"))
    exact = routes.filter("model <> '*'").groupBy("model").agg(F.min("target").alias("__own"))
    return (
        log.join(exact, "model", "left")
        .withColumn("__one", F.lit(1)).join(star.withColumn("__one", F.lit(1)), "__one")  # a single row
        .withColumn("target", F.coalesce("__own", "__star", F.lit(default)))
        .drop("__own", "__star", "__one")
    )


def with_team(log: DataFrame, keys: DataFrame, raw_key: str = "api_key") -> DataFrame:
    """Team of the request's key; ``accepted`` is false for unknown or inactive keys."""
    active = keys.filter("is_active").groupBy("key_hash").agg(F.min("team_id").alias("__team"))
    return (
        log.withColumn("key_hash", F.sha2(F.col(raw_key), 256))
        .join(active, "key_hash", "left")
        .withColumn("accepted", F.col("__team").isNotNull())
        .withColumn("team_id", F.coalesce("__team", F.lit("default")))
        .drop("__team")
    )


def ai_hosts(pages: DataFrame, url: str = "url", hosts=None, paths=None) -> DataFrame:
    """Rows whose host is listed, or under a listed host, or whose path names a model API.

    A host is tested through its suffixes: each row looks its few suffixes up in
    the list, instead of trying every listed host.
    """
    hosts = C.AI_HOSTS if hosts is None else hosts
    paths = C.AI_PATHS if paths is None else paths
    labels = "split(__host, '[.]')"
    suffixes = (
        f"transform(sequence(1, size({labels})), "
        f"i -> array_join(slice({labels}, i, size({labels})), '.'))"
    )
    listed = "array(" + ", ".join(f"'{h}'" for h in hosts) + ")"
    by_path = " or ".join(f"contains(__path, '{p}')" for p in paths) or "false"
    return (
        pages.withColumn("__host", F.expr(f"lower(coalesce(try_parse_url({url}, 'HOST'), ''))"))
        .withColumn("__path", F.expr(f"lower(coalesce(try_parse_url({url}, 'PATH'), ''))"))
        .filter(F.expr(f"arrays_overlap({suffixes}, {listed}) or {by_path}"))
        .drop("__path")
        .withColumnRenamed("__host", "host")
    )


def valid_team(team: str) -> str:
    """Team ids: at most 128 letters, digits, - and _, with a letter or digit among them."""
    return (
        f"(length({team}) between 1 and {C.MAX_TEAM_CHARS} "
        f"and rlike({team}, '(?U)^[\\\\p{{Alnum}}_-]+$') and rlike({team}, '(?U)\\\\p{{Alnum}}'))"
    )
