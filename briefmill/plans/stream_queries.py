"""Registered queries: streaming jobs run to completion over the driver's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefmill.plans import inputs as I
from briefmill.plans.registry import cte, query
from briefmill.session import scratch_path
from briefmill.sources.tables import VersionedTable
from briefmill.streaming import jobs


def stream(spark, sf, name):
    return jobs.file_stream(spark, f"{sf}/{name}.parquet*", I.table(spark, sf, name).schema)


def status_events(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "created").when(kind == "view", "indexing").when(kind == "click", "analyzing").when(
        kind == "purchase", "debating").otherwise("error")
    return stream(spark, sf, "events").select(
        F.col("user_id").alias("deal_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


@query("st_ingest_dedup", "select sha256(text) as fingerprint, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def _ingest(spark, sf):
    target = scratch_path(spark, "unique")
    jobs.ingest_unique(stream(spark, sf, "documents"), target, scratch_path(spark, "cp"))
    return jobs.unique_documents(spark, target)


@query("st_chunk_delta", "select chunk_id, document_name, clause_type from classified", "classified")
def _chunks(spark, sf):
    table = scratch_path(spark, "chunk-stream")
    jobs.chunk_delta(stream(spark, sf, "documents"), I.section_lines, table, scratch_path(spark, "cp"), I.FIXTURE_TERMS)
    return VersionedTable(spark, table, "chunk_id").read("chunk_id string, document_name string, clause_type string")


@query("st_phase_latest", """
  select deal_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, events,
         case status when 'created' then 0 when 'indexing' then 20 when 'analyzing' then 40 when 'debating' then 60 else 0 end as percent
  from (select deal_id, arg_max(status, seq) as status, max(ts) as ts, count(*) as events from fx_deal_status group by 1)""", "fx_deal_status")
def _phase(spark, sf):
    table = scratch_path(spark, "phases")
    jobs.follow_phases(status_events(spark, sf), table, scratch_path(spark, "cp"))
    return jobs.current_phases(spark, table)


@query("st_recent_events", """
  select deal_id, seq, status, recency from (
    select *, row_number() over (partition by deal_id order by ts desc, seq desc) as recency from fx_deal_status) where recency <= 200""", "fx_deal_status")
def _recent(spark, sf):
    table = scratch_path(spark, "recent")
    jobs.follow_recent(status_events(spark, sf), table, scratch_path(spark, "cp"))
    return jobs.recent_events(spark, table, "deal_id long, seq long, ts timestamp, status string").drop("ts")


cte("sla_events", "select *, epoch_us(ts) // 1000 as ms from events where event_type in ('error', 'purchase')")


@query("st_sla_timeout", """
  select user_id as deal_id, event_id as escalation_id, ms as opened_ms from sla_events o
  where event_type = 'error' and ms + 86400000 < (select max(ms) from sla_events)
    and not exists (select 1 from sla_events c where c.user_id = o.user_id and c.event_type = 'purchase' and c.ms > o.ms and c.ms <= o.ms + 86400000)""",
       "sla_events")
def _sla(spark, sf):
    kind = F.when(F.col("event_type") == "error", "open").otherwise("close")
    events = stream(spark, sf, "events").filter(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("deal_id"), F.col("event_id").alias("escalation_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    target = scratch_path(spark, "sla")
    jobs.write_available(jobs.sla_timeouts(events, "0 seconds"), target, scratch_path(spark, "cp"))
    return spark.read.parquet(target)


@query("st_transition_guard", """
  select deal_id, seq, previous, status from (
    select *, lag(status) over (partition by deal_id order by seq) as previous from fx_deal_status)
  where previous <> status and (previous, status) not in (select (from_state, to_state) from d_transition)""", "fx_deal_status", "d_transition")
def _guard(spark, sf):
    target = scratch_path(spark, "guard")
    edges = scratch_path(spark, "edges")
    jobs.guard_transitions(status_events(spark, sf), target, edges, scratch_path(spark, "cp"))
    return jobs.violations(spark, target, edges)


@query("st_audit_sink", """
  select deal_id, seq, status, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from fx_deal_status""", "fx_deal_status")
def _audit(spark, sf):
    target = scratch_path(spark, "log")
    jobs.append_log(status_events(spark, sf), target, scratch_path(spark, "cp"))
    return spark.read.parquet(target).drop("day")
