"""Audit log: hash chain, verification, retention, session views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.rulepack import RulePack
from veilspark.functions.spans import fold
from veilspark.functions.text import fingerprint
from veilspark.operators.compliance import placeholder_token
from veilspark.operators.ordered import previous_row
from veilspark.sources.tables import shared_folder

SEGMENT_IDS = 1_000


def row_hash(prev: str, session: str, action: str, detail: str, created: str) -> str:
    return (
        f"sha2(concat_ws('|', coalesce({prev}, ''), coalesce({session}, ''), {action}, "
        f"coalesce({detail}, ''), coalesce({created}, '')), 256)"
    )


def with_segment(audit: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Cut the log into segments of at most ``segment_ids`` rows: ids are unique."""
    return audit.withColumn("segment", F.expr(f"id div {segment_ids}"))


def build_chain(audit: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Add ``prev_hash``: the hash of the row before, over the whole log in order of id.

    Each row's hash needs the one before it, so rows are folded in order inside
    their segment, which bounds the group whatever the share of a session.  The
    fold keeps hashes only and appends them in blocks, so a row costs the same in
    segments of any length.  The first row of a segment gets the link of the
    segment before (see ``segment_ledger``), so only the first row of the log has
    no hash.  Segments are written once to the shared folder, since both
    the rows and the links are made from them.
    """
    columns = ["id", "session_id", "action", "detail_json", "created_at"]
    hashed = fold("rows", "string", "cast(null as string)", "a.pos", row_hash("a.pos", *(f"x.{c}" for c in columns[1:])))
    last = row_hash("element_at(hashes, -1)", *(f"element_at(rows, -1).{c}" for c in columns[1:]))
    folded = (
        with_segment(audit, segment_ids)
        .groupBy("segment")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
        .withColumn("hashes", F.expr(hashed))
        .selectExpr("segment", "rows", "hashes", f"{last} as close_hash")
    )
    path = shared_folder(audit.sparkSession, "chain")
    folded.write.parquet(path)
    folded = audit.sparkSession.read.schema(folded.schema).parquet(path)
    seeds = _seeds(_linked(folded.select("segment", "close_hash"))).withColumnRenamed("segment", "of")
    rows = folded.selectExpr("segment", "inline(arrays_zip(rows, hashes))").selectExpr("segment", "rows.*", "hashes")
    return rows.join(seeds, F.col("segment") == F.col("of"), "left").selectExpr(
        "id", "session_id", "segment", "action", "detail_json", "created_at", "coalesce(hashes, seed) as prev_hash")


def segment_ledger(chain: DataFrame) -> DataFrame:
    """Tie the segments of the log together: segment, n_rows, close_hash, link_hash.

    A segment is closed by the hash of its last row; its link hashes that
    together with the close of the segment before, so dropping or exchanging a
    segment shows.  Each link needs two closes only and is computed in parallel.
    Inside a segment the hashes begin anew: the hash of its first row leaves out
    the link stored with it.
    """
    prev = "if(n_rows = 1, null, l.prev_hash)"
    last = row_hash(prev, "l.session_id", "l.action", "l.detail_json", "l.created_at")
    closes = (
        chain.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max_by(
                F.struct("prev_hash", "session_id", "action", "detail_json", "created_at"), "id"
            ).alias("l"),
        )
        .withColumn("close_hash", F.expr(last))
        .drop("l")
    )
    return _linked(closes)


def _linked(closes: DataFrame) -> DataFrame:
    """Add the hash of each close with the one before."""
    return (
        previous_row(closes, [], "segment", ["close_hash"])
        .withColumn(
            "link_hash",
            F.expr("sha2(concat_ws('|', coalesce(prev.close_hash, ''), close_hash), 256)"),
        )
        .drop("prev")
    )


def _seeds(ledger: DataFrame) -> DataFrame:
    """For each segment the link of the one before."""
    return previous_row(ledger, [], "segment", ["link_hash"]).selectExpr("segment", "prev.link_hash as seed")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Add ``broken``: the stored hash is not the one that the rows before give.

    Neighbouring rows are compared inside their segment, and the first row of a
    segment with the link recomputed from the segments before, all in parallel.
    Every row is judged; a change anywhere but in the last row of the log shows.
    """
    inside = Window.partitionBy("segment").orderBy("id")
    before = F.lag(F.struct("prev_hash", "session_id", "action", "detail_json", "created_at")).over(inside)
    expected = row_hash(
        "if(__no = 2, null, __prev.prev_hash)", "__prev.session_id", "__prev.action", "__prev.detail_json",
        "__prev.created_at")
    return (
        chain.withColumns({"__no": F.row_number().over(inside), "__prev": before})
        .join(_seeds(segment_ledger(chain)), "segment", "left")
        .withColumn("broken", F.expr(f"not (prev_hash <=> if(__no = 1, seed, {expected}))"))
        .drop("__no", "__prev", "seed")
    )


def chain_report(verified: DataFrame, keys: list[str] = ("segment",)) -> DataFrame:
    """Per segment, or other keys: rows, breaks, first break, intact or not."""
    return verified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("broken").cast("long")).alias("n_breaks"),
        F.min(F.when(F.col("broken"), F.col("id"))).alias("first_break"),
        (~F.max("broken")).alias("intact"),
    )


def verify_ledger(chain: DataFrame, stored: DataFrame) -> DataFrame:
    """Compare the rows with the ledger kept apart from them: segment, problem (null if none).

    Finds dropped and added segments, lost rows and changes up to the last row.
    """
    now = segment_ledger(chain).selectExpr("segment", "struct(n_rows, close_hash, link_hash) as now")
    was = stored.selectExpr("segment", "struct(n_rows, close_hash, link_hash) as was")
    return now.join(was, "segment", "full").selectExpr(
        "segment",
        """case when now is null then 'dropped' when was is null then 'added'
                when now.n_rows <> was.n_rows then 'rows lost or added'
                when now.close_hash <> was.close_hash then 'changed'
                when now.link_hash <> was.link_hash then 'follows another segment' end as problem""",
    )


def mask_audit(
    masked: DataFrame, session: str = "session_id", pack: RulePack = RulePack(),
    team: str | None = None, dry_run: bool = False,
) -> DataFrame:
    """Audit detail of masking: counters and value fingerprints, no plain text.

    ``team`` is a SQL expression for the team of a request.
    """
    token = placeholder_token(pack, "m.placeholder")
    entity = (
        f"transform(mappings, m -> named_struct('entity_type', {token}, "
        f"'placeholder', m.placeholder, 'value_hash', {fingerprint('m.value')}))"
    )
    total = "aggregate(map_values(stats), 0L, (a, x) -> a + x)"
    return masked.selectExpr(
        f"{session} as session_id",
        "'mask_request' as action",
        f"to_json(named_struct('entity_count', {total}, 'stats', stats, 'dry_run', {str(dry_run).lower()}, "
        f"'entity_detail', {entity}{f", 'team_id', {team}" if team else ''})) as detail_json",
    )


def session_team(vault: DataFrame) -> DataFrame:
    """Team of a session: the one of its first mapping."""
    return vault.groupBy("session_id").agg(F.min_by("team_id", "id").alias("team_id"))


def expired_audit(audit: DataFrame, vault: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Flag audit rows past the retention of their team's tier.

    A team with several keys follows the shortest tier; unknown teams the
    default.  The key table is reduced to one row per team first.
    """
    days = F.create_map(
        *[F.lit(x) for kv in C.RETENTION_DAYS.items() for x in kv]
    )
    default = C.RETENTION_DAYS["free"]
    team_days = keys.groupBy("team_id").agg(
        F.min(F.coalesce(F.try_element_at(days, F.col("tier")), F.lit(default))).alias("days")
    )
    return (
        audit.drop("team_id")
        .join(session_team(vault), "session_id", "left")
        .join(team_days, "team_id", "left")
        .withColumn("days", F.coalesce("days", F.lit(default)))
        .withColumn(
            "expired",
            F.expr(f"cast(created_at as timestamp) < timestamp '{now}' - make_interval(0, 0, 0, days)"),
        )
    )


def team_audit(audit: DataFrame, team: str) -> DataFrame:
    """Audit rows whose detail names the team."""
    return audit.filter(F.get_json_object("detail_json", "$.team_id") == team)


def session_audit(
    audit: DataFrame, vault: DataFrame, limit: int = 100, team: str | None = None
) -> DataFrame:
    """Newest audit rows of every session that has mappings, or has them for one team.

    The vault only decides which sessions count, so it is a semi join;
    ``copies`` tells how often a plain join would repeat the row.  The group
    limit runs before the shuffle, so a busy session sends few rows.
    """
    if team is not None:
        vault = vault.filter(F.col("team_id") == team)
    per_session = vault.groupBy("session_id").agg(F.count(F.lit(1)).alias("copies"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = (
        audit.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit)
    )
    return top.join(per_session, "session_id")


def session_detail(audit: DataFrame, limit: int = 100) -> DataFrame:
    """Per session one row: the newest events with their parsed detail."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        audit.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit)
        .groupBy("session_id")
        .agg(
            F.max("created_at").alias("created_at"),
            F.sort_array(
                F.collect_list(F.struct("rn", "created_at", "action", "detail_json"))
            ).alias("events"),
        )
        .withColumn(
            "events",
            F.expr("""transform(events, e -> named_struct(
                'created_at', e.created_at, 'action', e.action,
                'detail', from_json(e.detail_json, 'map<string,string>')))"""),
        )
    )


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset(offset).limit(limit)
