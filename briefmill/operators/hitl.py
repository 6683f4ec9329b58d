"""Human loop: escalations, disputes, audit trail, deal life cycle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill import domains

BUCKET_ROWS = 100_000


def bounded_lag(df: DataFrame, key: str, order: str, value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Previous value per key, without sorting a hot key's whole history in one task.

    History is cut into ranges of the order column.  Inside a range a window gives the
    previous row; the first row of a range takes the last value of the range before it,
    from a table with one row per key and range."""
    cut = df.withColumn("_range", F.floor(F.col(order) / bucket_rows))
    inside = Window.partitionBy(key, "_range").orderBy(order)
    ends = cut.groupBy(key, "_range").agg(F.max_by(value, order).alias("_last"))
    across = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_range"))).drop("_last")
    return (
        cut.withColumn("_place", F.row_number().over(inside)).withColumn("previous", F.lag(value).over(inside))
        .join(across, [key, "_range"])
        .withColumn("previous", F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("previous")))
        .drop("_range", "_place", "_before")
    )


def invalid_transitions(history: DataFrame) -> DataFrame:
    """Status changes the life cycle does not allow; repeating a state is allowed."""
    allowed = domains.frame(history.sparkSession, domains.TRANSITIONS, "previous string, status string")
    moves = bounded_lag(history, "deal_id", "seq", "status").filter(
        F.col("previous").isNotNull() & (F.col("previous") != F.col("status")))
    return moves.join(allowed, ["previous", "status"], "left_anti").select("deal_id", "seq", "previous", "status")


def expire_escalations(escalations: DataFrame, deals: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Pending escalations older than the limit time out and take their open deals down."""
    cutoff = as_of - F.expr(f"interval {hours} hours")
    late = escalations.filter((F.col("status") == "pending") & (F.col("created_at") < cutoff))
    after = F.when(~F.col("deal_status").isin("complete", "error"), "error").otherwise(F.col("deal_status"))
    return (
        late.select("escalation_id", "deal_id")
        .join(deals.select("deal_id", F.col("status").alias("deal_status")), "deal_id", "left")
        .select("escalation_id", "deal_id", F.lit("timed_out").alias("status"), after.alias("deal_status"),
                (after != F.col("deal_status")).alias("dropped"))
    )


def dropped_deals(expired: DataFrame) -> DataFrame:
    return expired.filter("dropped").select("deal_id").distinct()


DECISIONS = ["resolve", "request_docs", "accept_risk"]


class Resolution(NamedTuple):
    updates: DataFrame
    findings: DataFrame
    delta_runs: DataFrame
    audit: DataFrame
    errors: DataFrame


def resolve_escalations(requests: DataFrame, escalations: DataFrame, findings: DataFrame) -> Resolution:
    """Decide each requested escalation: confirm the finding by an additive record, ask for
    documents, or accept the risk.  The original finding is never changed.

    ``requests`` has (seq, escalation_id, decision, decision_text, resolved_by); the first one of an
    escalation with a known decision succeeds, later ones find it resolved."""
    known = F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False))
    first = requests.groupBy("escalation_id").agg(F.min(F.when(known, F.col("seq"))).alias("first_seq"))
    joined = requests.join(
        escalations.select("escalation_id", "deal_id", "finding_id", F.col("status").alias("old_status")), "escalation_id", "left"
    ).join(first, "escalation_id")
    error = (
        F.when(F.col("old_status").isNull(), "not found")
        .when((F.col("old_status") == "resolved") | (F.col("seq") > F.col("first_seq")), "already resolved")
        .when(~known, F.concat(F.lit("unknown decision path: "), F.coalesce("decision", F.lit(""))))
    )
    judged = joined.withColumn("error", error)
    good = judged.filter(F.col("error").isNull())
    confirmed = good.filter(F.col("decision") == "resolve").select("finding_id", "decision_text", "resolved_by", "escalation_id")
    additive = findings.join(confirmed, "finding_id").select(
        *[c for c in findings.columns if c not in ("confidence", "agent", "verified", "notes")], "escalation_id",
        F.lit("human_confirmed").alias("confidence"), F.concat(F.lit("human_expert_"), "resolved_by").alias("agent"),
        F.lit(True).alias("verified"), F.concat(F.lit("Human Resolution Override: "), "decision_text").alias("notes"),
    )
    delta = good.filter(F.col("decision") == "request_docs").select("escalation_id", "deal_id", F.lit("started").alias("status"))
    resolved = good.select(
        "deal_id", "escalation_id", F.lit("ESCALATION_RESOLVED").alias("event_type"), F.col("resolved_by").alias("actor"),
        F.concat(F.lit("Escalation "), "escalation_id", F.lit(" resolved with decision: "), "decision").alias("description"))
    started = delta.select(
        "deal_id", "escalation_id", F.lit("DELTA_REANALYSIS_STARTED").alias("event_type"), F.lit("system").alias("actor"),
        F.concat(F.lit("Delta re-analysis started for deal "), "deal_id").alias("description"))
    return Resolution(
        good.select("escalation_id", "deal_id", F.lit("resolved").alias("status"), "decision", "decision_text", "resolved_by"),
        additive, delta, resolved.unionByName(started),
        judged.filter(F.col("error").isNotNull()).select("seq", "escalation_id", "error"),
    )


def escalation_events(created: DataFrame, changes: DataFrame) -> DataFrame:
    """Audit rows for new escalations and status changes.

    ``created``: (escalation_id, deal_id, finding_id, ts); ``changes`` adds (old_status, new_status, actor)."""
    first = created.select(
        "escalation_id", "deal_id", F.lit("ESCALATION_CREATED").alias("event_type"), F.lit("system").alias("actor"),
        F.concat(F.lit("Escalation "), "escalation_id", F.lit(" created for finding "), "finding_id").alias("description"),
        F.lit("pending").alias("status"), "ts")
    later = changes.select(
        "escalation_id", "deal_id", F.lit("ESCALATION_STATUS_CHANGE").alias("event_type"), "actor",
        F.concat(F.lit("Escalation "), "escalation_id", F.lit(" status changed from "), "old_status", F.lit(" to "), "new_status").alias("description"),
        F.col("new_status").alias("status"), "ts")
    return first.unionByName(later)


def latest_escalations(events: DataFrame) -> DataFrame:
    """Current status per escalation from its event log."""
    return events.groupBy("escalation_id").agg(
        F.max_by("status", "ts").alias("status"), F.count("*").alias("events"),
        F.max(F.when(F.col("status") == "resolved", F.col("ts"))).alias("resolved_at"))


class Dispute(NamedTuple):
    disputes: DataFrame
    escalations: DataFrame
    states: DataFrame
    delta_runs: DataFrame
    audit: DataFrame
    trail_requests: DataFrame


def route_disputes(requests: DataFrame, findings: DataFrame, states: DataFrame) -> Dispute:
    """A and C go to an expert, B reopens the dimension and starts a delta run, D asks for
    the audit trail only."""
    filed = requests.filter(F.col("scenario").isin("A", "B", "C"))
    to_expert, reopened = filed.filter(F.col("scenario") != "B"), filed.filter(F.col("scenario") == "B")
    ident = ["dispute_id", "deal_id", "finding_id"]
    escalated = to_expert.select(*ident, F.lit("pending").alias("status"))
    delta = reopened.select("dispute_id", "deal_id", "uploaded_document_path", F.lit("started").alias("status"))
    note = lambda df, event, actor, text: df.select(
        "dispute_id", "deal_id", F.lit(event).alias("event_type"), actor.alias("actor"), text.alias("description"))
    audit = note(
        filed, "DISPUTE_CREATED", F.col("user_id"),
        F.concat(F.lit("Dispute "), "dispute_id", F.lit(" created for finding "), "finding_id", F.lit(" (Scenario "), "scenario", F.lit(")")),
    ).unionByName(note(
        to_expert, "ESCALATION_CREATED", F.lit("system"),
        F.concat(F.lit("Escalation for dispute "), "dispute_id", F.lit(" created for finding "), "finding_id"),
    )).unionByName(note(
        reopened, "DELTA_REANALYSIS_STARTED", F.lit("system"), F.concat(F.lit("Delta re-analysis started for deal "), "deal_id")))
    return Dispute(
        filed.select(*ident, "scenario", F.lit("pending").alias("status")), escalated,
        reopen_dimensions(reopened, findings, states), delta, audit,
        requests.filter(F.col("scenario") == "D").select(*ident),
    )


def reopen_dimensions(disputes: DataFrame, findings: DataFrame, states: DataFrame) -> DataFrame:
    """States with the dimensions of disputed findings set back to active, in the dispute's deal."""
    hit = (
        disputes.select("deal_id", "finding_id").distinct().join(findings.select("finding_id", "dimension"), "finding_id")
        .select("deal_id", "dimension").distinct().withColumn("_hit", F.lit(True))
    )
    return states.join(hit, ["deal_id", "dimension"], "left").withColumn(
        "state", F.when(F.col("_hit"), "active").otherwise(F.col("state"))).drop("_hit")


def audit_trail(wanted: DataFrame, arguments: DataFrame, audit: DataFrame, id_pattern: str = r"\bF\d+\b") -> DataFrame:
    """Arguments by round and audit rows by time for the wanted findings.

    Ids are extracted from the descriptions, which turns the containment test into an
    equi join."""
    ids = wanted.select("finding_id").distinct()
    said = arguments.join(ids, "finding_id", "left_semi").select(
        "finding_id", F.lit("argument").alias("kind"), F.col("argument_id").alias("entry_id"),
        F.col("round").cast("bigint").alias("round"), F.lit(None).cast("timestamp_ntz").alias("event_time"),
        F.concat_ws(" ", "persona", "stance").alias("entry"))
    named = audit.select(
        F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(id_pattern), 0))).alias("finding_id"),
        F.lit("audit").alias("kind"), F.col("audit_id").alias("entry_id"), F.lit(None).cast("bigint").alias("round"),
        F.col("event_time").cast("timestamp_ntz").alias("event_time"), F.concat_ws(" ", "event_type", "description").alias("entry"))
    return said.unionByName(named.join(ids, "finding_id", "left_semi")).orderBy("finding_id", F.desc("kind"), "round", "event_time", "entry_id")


def deal_audit(audit: DataFrame, deal_id: object | None = None) -> DataFrame:
    """Audit rows by time, of one deal or of all; the sort ranges split inside a hot deal."""
    rows = audit if deal_id is None else audit.filter(F.col("deal_id") == deal_id)
    return rows.orderBy("deal_id", "event_time", "audit_id")


def status_counts(escalations: DataFrame) -> DataFrame:
    return escalations.groupBy("deal_id").agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "resolved").alias("resolved"))
