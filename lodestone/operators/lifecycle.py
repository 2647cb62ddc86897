"""Lifecycle of sources: upserts, soft deletes, filters, purge and audit as table operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as t

REASONS = [
    "missing_source_unit_id",
    "missing_persisted_record",
    "soft_deleted",
    "status_not_allowed",
    "status_denied",
    "freshness_stale",
    "freshness_invalid_timestamp",
    "freshness_missing_timestamp",
]


def age_days(now: Column, ts: Column) -> Column:
    """Whole days since an instant, floored, so negative for the future."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def freshness_reason(settings: Settings, now: Column) -> Column:
    """Why a record's timestamps keep it out; the first readable one, in the configured order, decides."""
    if settings.freshness_max_age_days is None:
        return F.lit(None).cast("string")
    order = ["last_upsert_iso_ts", "ingestion_iso_ts"]
    if not settings.freshness_use_last_upsert_first:
        order.reverse()
    parsed = F.coalesce(*[t.parse_ts(c) for c in order])
    blank = lambda c: F.coalesce(t.strip(c), F.lit("")) == ""
    invalid = F.lit(False)
    missing = F.lit(False)
    for c in order:
        invalid = invalid | (~blank(c) & t.parse_ts(c).isNull())
        missing = missing | blank(c)
    stale = age_days(now, parsed) > F.lit(settings.freshness_max_age_days)
    out = F.when(parsed.isNotNull(), F.when(stale, "freshness_stale"))
    if settings.freshness_invalid_ts_policy == "exclude":
        out = out.when(invalid, "freshness_invalid_timestamp")
    if settings.freshness_missing_ts_policy == "exclude":
        out = out.when(missing, "freshness_missing_timestamp")
    return out


def with_filter_reason(chunks: DataFrame, records: DataFrame, settings: Settings, now: Column) -> DataFrame:
    """Adds ``filter_reason``, null for rows that stay.  A blank unit id passes every filter unless records are required."""
    fields = ["status", "deletion_mark_iso_ts", "last_upsert_iso_ts", "ingestion_iso_ts"]
    kept = records.select("source_unit_id", *[F.col(c).alias(f"r_{c}") for c in fields], F.lit(True).alias("recorded"))
    joined = chunks.join(kept, "source_unit_id", "left")
    for c in fields:  # a record speaks for the chunk; without one the chunk's own fields do
        own = F.col(c) if c in chunks.columns else F.lit(None).cast("string")
        joined = joined.withColumn(c, F.when(F.col("recorded"), F.col(f"r_{c}")).otherwise(own))
    status = F.lower(t.strip(F.coalesce("status", F.lit(""))))
    required = F.lit(settings.lifecycle_require_persisted_record)
    allowed = [s.strip().lower() for s in settings.status_allow_list]
    denied = [s.strip().lower() for s in settings.status_deny_list]
    reason = F.when(
        F.coalesce(t.strip("source_unit_id"), F.lit("")) == "", F.when(required, "missing_source_unit_id")
    ).when(F.col("recorded").isNull() & required, "missing_persisted_record")
    if settings.exclude_soft_deleted:
        marked = F.coalesce(t.strip("deletion_mark_iso_ts"), F.lit("")) != ""
        reason = reason.when((status == "soft_deleted") | marked, "soft_deleted")
    if allowed:
        reason = reason.when(~status.isin(allowed), "status_not_allowed")
    if denied:
        reason = reason.when(status.isin(denied), "status_denied")
    reason = reason.otherwise(freshness_reason(settings, now))
    return joined.withColumn("filter_reason", reason).drop("recorded", *[f"r_{c}" for c in fields])


def filter_diagnostics(filtered: DataFrame) -> DataFrame:
    """One row: candidates, a counter for every reason, retained."""
    return filtered.agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col("filter_reason") == r).alias(f"filtered_{r}") for r in REASONS],
        F.count_if(F.col("filter_reason").isNull()).alias("retained"),
    )


def upsert(records: DataFrame, batch: DataFrame, now: str, skip_unchanged: bool = False) -> DataFrame:
    """State after a batch of (source_unit_id, source, content_fingerprint, seq), with the last ``action``.

    Repeats of a unit in one batch act in the order of ``seq``.  An unchanged unit is skipped as it is,
    even if it is deleted; every other upsert makes the unit active and clears its deletion mark.
    """
    order = Window.partitionBy("source_unit_id").orderBy("seq")
    old = records.select("source_unit_id", F.col("content_fingerprint").alias("held"), F.lit(True).alias("exists"))
    steps = batch.join(old, "source_unit_id", "left").withColumn("nth", F.row_number().over(order))
    before = F.coalesce(F.lag("content_fingerprint").over(order), "held")
    known = (F.col("nth") > 1) | F.col("exists").isNotNull()
    unchanged = F.lit(skip_unchanged) & known & before.eqNullSafe(F.col("content_fingerprint"))
    action = F.when(unchanged, "unchanged_skipped").when(known, "updated").otherwise("created")
    done = steps.withColumn("action", action)
    last = done.groupBy("source_unit_id").agg(
        F.max_by(F.struct("source", "content_fingerprint", "action"), "seq").alias("l"),
        F.max(F.col("action") != "unchanged_skipped").alias("touched"),
    )
    joined = records.join(last, "source_unit_id", "full_outer")
    touched = F.coalesce("touched", F.lit(False))
    pick = lambda new, c: F.when(touched, new).otherwise(F.col(c)).alias(c)
    blank = F.coalesce(t.strip("ingestion_iso_ts"), F.lit("")) == ""
    return joined.select(
        "source_unit_id",
        F.when(touched, F.col("l.source")).otherwise(F.col("source")).alias("source"),
        pick(F.col("l.content_fingerprint"), "content_fingerprint"),
        pick(F.when(blank, F.lit(now)).otherwise(F.col("ingestion_iso_ts")), "ingestion_iso_ts"),
        pick(F.lit(now), "last_upsert_iso_ts"),
        pick(F.lit(None).cast("string"), "deletion_mark_iso_ts"),
        pick(F.lit("active"), "status"),
        F.col("l.action").alias("action"),
    )


def soft_delete(records: DataFrame, commands: DataFrame, now: str) -> DataFrame:
    """Marks the units of ``commands`` (source_unit_id); units without a record are left out."""
    hit = commands.select("source_unit_id").distinct().withColumn("hit", F.lit(True))
    out = records.join(hit, "source_unit_id", "left")
    return out.withColumns(
        {
            "deletion_mark_iso_ts": F.when(F.col("hit"), F.lit(now)).otherwise(F.col("deletion_mark_iso_ts")),
            "status": F.when(F.col("hit"), F.lit("soft_deleted")).otherwise(F.col("status")),
        }
    ).drop("hit")


def set_status(records: DataFrame, commands: DataFrame, now: str) -> DataFrame:
    """New statuses from (source_unit_id, new_status), one per unit; blank ones keep the old; marks stay."""
    out = records.join(commands.select("source_unit_id", "new_status", F.lit(True).alias("hit")), "source_unit_id", "left")
    given = t.strip(F.coalesce("new_status", F.lit("")))
    return out.withColumns(
        {
            "status": F.when(F.col("hit") & (given != ""), given).otherwise(F.col("status")),
            "last_upsert_iso_ts": F.when(F.col("hit"), F.lit(now)).otherwise(F.col("last_upsert_iso_ts")),
        }
    ).drop("hit", "new_status")


def purge_plan(records: DataFrame, now: Column, older_than_days: float | None = None) -> DataFrame:
    """Adds ``purge``: ``keep``, ``purge``, ``missing_mark`` or ``invalid_mark``.

    Deleted units go; with an age, only those whose mark is at least that old, and unreadable marks are counted.
    """
    mark = F.coalesce(t.strip("deletion_mark_iso_ts"), F.lit(""))
    deleted = (F.lower(t.strip(F.coalesce("status", F.lit("")))) == "soft_deleted") | (mark != "")
    plan = F.when(~deleted, "keep")
    if older_than_days is not None:
        parsed = t.parse_ts("deletion_mark_iso_ts")
        plan = plan.when(mark == "", "missing_mark").when(parsed.isNull(), "invalid_mark")
        plan = plan.when(age_days(now, parsed) < older_than_days, "keep")
    return records.withColumn("purge", plan.otherwise("purge"))


def purge(records: DataFrame, now: Column, older_than_days: float | None = None) -> DataFrame:
    return purge_plan(records, now, older_than_days).where("purge <> 'purge'").drop("purge")


def purge_report(records: DataFrame, now: Column, older_than_days: float | None = None) -> DataFrame:
    """One row: inspected, purged, skipped for a missing or unreadable mark, remaining after the purge."""
    plan = purge_plan(records, now, older_than_days)
    gone = F.count_if(F.col("purge") == "purge")
    return plan.agg(
        F.count("*").alias("inspected_records"),
        gone.alias("purged_count"),
        F.count_if(F.col("purge") == "missing_mark").alias("skipped_missing_deletion_mark_iso_ts"),
        F.count_if(F.col("purge") == "invalid_mark").alias("skipped_invalid_deletion_mark_iso_ts"),
        (F.count("*") - gone).alias("remaining_records"),
    )


def events_of(state: DataFrame, now: str) -> DataFrame:
    """Audit events of an upserted state: one for each unit that the batch named."""
    return state.where("action is not null").select(
        F.lit(now).alias("event_iso_ts"),
        "action",
        "source_unit_id",
        F.create_map(F.lit("source"), F.col("source"), F.lit("status"), F.col("status")).alias("details"),
    )


def purge_events(records: DataFrame, now: Column, stamp: str, older_than_days: float | None = None) -> DataFrame:
    """Audit events of a purge."""
    gone = purge_plan(records, now, older_than_days).where("purge = 'purge'")
    details = F.create_map(*[x for c in ("source", "status", "deletion_mark_iso_ts") for x in (F.lit(c), F.col(c))])
    return gone.select(F.lit(stamp).alias("event_iso_ts"), F.lit("hard_purged").alias("action"), "source_unit_id", details.alias("details"))


def get(records: DataFrame, source_unit_id: str) -> dict | None:
    """The record of one unit."""
    found = records.where(F.col("source_unit_id") == source_unit_id).first()
    return None if found is None else found.asDict()


def as_dict(records: DataFrame) -> dict[str, dict]:
    """All records by unit, for states that a single process is meant to hold."""
    return {r.source_unit_id: r.asDict() for r in records.toLocalIterator()}


#: What an upsert can do to a unit.
INGESTED = ("created", "updated", "unchanged_skipped")


def audit_report(records: DataFrame, events: DataFrame) -> DataFrame:
    """(section, name, n): totals, statuses, timestamp problems, event counts, and events of ingestion, zeros kept."""
    status = F.lower(t.strip(F.coalesce("status", F.lit(""))))
    statuses = records.groupBy(F.lit("status").alias("section"), F.when(status == "", "unknown").otherwise(status).alias("name")).agg(F.count("*").alias("n"))
    blank = lambda c: F.coalesce(t.strip(c), F.lit("")) == ""
    checks = [
        (f"{kind}_{c}", cond)
        for c in ("ingestion_iso_ts", "last_upsert_iso_ts")
        for kind, cond in (("missing", blank(c)), ("invalid", ~blank(c) & t.parse_ts(c).isNull()))
    ]
    marks = records.agg(*[F.count_if(cond).alias(name) for name, cond in checks])
    problems = _rows(marks, "timestamps")
    marked = (status == "soft_deleted") | (F.coalesce("deletion_mark_iso_ts", F.lit("")) != "")
    totals = records.agg(
        F.count("*").alias("total_records"), F.count_if(status == "active").alias("active_count"), F.count_if(marked).alias("soft_deleted_count")
    )
    action = F.lower(t.strip(F.coalesce("action", F.lit(""))))
    counted = events.groupBy(F.when(action == "", "unknown").otherwise(action).alias("name")).agg(F.count("*").alias("n"))
    actions = counted.select(F.lit("events").alias("section"), "name", "n")
    again = counted.agg(*[F.coalesce(F.sum(F.when(F.col("name") == a, F.col("n"))), F.lit(0)).alias(a) for a in INGESTED])
    return reduce(
        DataFrame.unionByName,
        [_rows(totals, "state"), statuses, problems, actions, _rows(again, "reingestion")],
    )


def _rows(one: DataFrame, section: str) -> DataFrame:
    """The columns of a single row as (section, name, n)."""
    named = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns])
    return one.select(F.explode(named).alias("x")).select("x.*")
