"""Registered queries: judge and verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefmill import domains
from briefmill.operators import debate
from briefmill.operators import verdict as ops
from briefmill.plans import inputs as I
from briefmill.plans.debate_queries import final_states
from briefmill.plans.inputs import SQL_SECTION, SQL_TERM
from briefmill.plans.registry import cte, query

cte("candidates", """
  select f.*, s.state from fx_debated_full f join final_states s using (deal_id, dimension)
  where s.state in ('contested', 'unresolved')""", "fx_debated_full", "final_states")


def candidates(spark, sf):
    return ops.judge_candidates(I.debated_findings(spark, sf), final_states(spark, sf))


@query("jdg_candidates", """
  select finding_id, deal_id, dimension, state, argument_id, persona, round from candidates
  left join (select finding_id, argument_id, persona, round from fx_arguments) using (finding_id)""", "candidates", "fx_arguments")
def _candidates(spark, sf):
    return ops.with_arguments(candidates(spark, sf), I.arguments(spark, sf)).select(
        "finding_id", "deal_id", "dimension", "state", "argument_id", "persona", "round")


cte("calibrated", """
  select finding_id, coalesce(avg(case confidence when 'high' then 0.9 when 'medium' then 0.5 else 0.1 end)
         filter (where not dropout_flag), 0.5) as calibrated_confidence from fx_arguments group by 1""", "fx_arguments")


@query("jdg_calibrated_confidence", "select finding_id, round(cast(calibrated_confidence as double), 6) as calibrated_confidence from calibrated", "calibrated")
def _calibrated(spark, sf):
    return ops.calibrated_confidence(I.debated_findings(spark, sf), I.arguments(spark, sf))


cte("e_queries", f"""
  select finding_id, clause_type, text, regexp_extract(text, '(?i){SQL_SECTION}') as section_id, terms
  from (select *, list_distinct(regexp_extract_all(lower(text), '{SQL_TERM}')) as terms
        from (select *, section_id || ' ' || citation as text from candidates where state = 'unresolved'))""", "candidates")
cte("missing", """
  select finding_id from e_queries q where not exists (select 1 from (
      select *, row_number() over (partition by section_id order by chunk_id) as rn from classified) c
      where c.section_id = q.section_id and c.clause_type = q.clause_type and c.rn <= 50)
    and (exists (select 1 from classified c where c.section_id = q.section_id)
         or not exists (select 1 from classified c where c.clause_type = q.clause_type
            and list_has_all(regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}_]+'), q.terms)))""", "e_queries", "classified")


def missing(spark, sf):
    """As the check SQL of the judge's queries has it: of a named section the first 50 chunks count."""
    return ops.evidence_missing(candidates(spark, sf), I.index(spark, sf), whole=False)


cte("nowhere", """
  select finding_id from e_queries q where not exists (select 1 from classified c where c.section_id = q.section_id and c.clause_type = q.clause_type)
    and (exists (select 1 from classified c where c.section_id = q.section_id)
         or not exists (select 1 from classified c where c.clause_type = q.clause_type
            and list_has_all(regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}_]+'), q.terms)))""", "e_queries", "classified")


@query("jdg_evidence_pass", "select finding_id from nowhere", "nowhere")
def _evidence(spark, sf):
    return ops.evidence_missing(candidates(spark, sf), I.index(spark, sf))


cte("judged", """
  select f.finding_id, f.deal_id, f.dimension,
         case when s.state = 'settled' then 'confirmed' when m.finding_id is not null then 'evidence_not_found'
              else coalesce(d.status, 'overridden') end as status,
         case when s.state = 'settled' or m.finding_id is not null then false else coalesce(d.judge_override_flag, true) end as judge_override_flag,
         case when s.state = 'settled' then 'Finding was already SETTLED.'
              when m.finding_id is not null then 'Evidence not found during final exact-match pass.'
              else coalesce(d.synthesis_rationale, 'LLM failure: no decision') end as synthesis_rationale,
         round(cast(case when s.state = 'settled' then 0.0 else c.calibrated_confidence end as double), 6) as calibrated_confidence
  from fx_debated f join final_states s using (deal_id, dimension)
  left join missing m on m.finding_id = f.finding_id left join fx_decisions d on d.finding_id = f.finding_id
  join calibrated c on c.finding_id = f.finding_id""", "fx_debated", "final_states", "missing", "fx_decisions", "calibrated")


def judged(spark, sf):
    found = I.debated_findings(spark, sf)
    calibrated = ops.calibrated_confidence(found, I.arguments(spark, sf))
    return ops.judge(found, final_states(spark, sf), missing(spark, sf), I.decisions(spark, sf), calibrated)


def stored_judged(spark, sf):
    return I.stored(spark, sf, "judged", lambda: judged(spark, sf))


@query("jdg_apply", "select * from judged", "judged")
def _apply(spark, sf):
    return judged(spark, sf)


def open_results(spark, sf):
    """Judge results exist only for findings that reached the judge."""
    return stored_judged(spark, sf).join(
        candidates(spark, sf).select("finding_id"), "finding_id", "left_semi")


cte("open_judged", "select * from judged where finding_id in (select finding_id from candidates)", "judged", "candidates")
cte("briefed", """
  select f.deal_id, f.finding_id, f.claim, f.severity, coalesce(j.calibrated_confidence, 1.0) as confidence, f.dimension,
         f.citation as section_citation, f.clause_type
  from fx_debated_full f left join final_states s using (deal_id, dimension) left join open_judged j on j.finding_id = f.finding_id
  where s.state = 'settled' or j.status = 'confirmed'""", "fx_debated_full", "final_states", "open_judged")


def brief(spark, sf):
    return ops.brief(I.debated_findings(spark, sf), final_states(spark, sf), open_results(spark, sf))


cte("ranked", """
  select *, row_number() over (partition by deal_id order by case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end,
                               confidence desc, finding_id) as rank
  from briefed""", "briefed")


@query("vrd_brief", "select * from ranked", "ranked")
def _brief(spark, sf):
    return brief(spark, sf)


def escalations(spark, sf):
    told = debate.gate_contradiction(I.arguments(spark, sf))
    return ops.escalations(I.debated_findings(spark, sf), final_states(spark, sf), told, open_results(spark, sf))


@query("vrd_escalations", """
  select c.deal_id, c.finding_id, c.claim, c.dimension, a.arguments, a.has_contradictions, a.has_dropouts,
         j.judge_override_flag as judge_override, j.synthesis_rationale as judge_notes
  from candidates c join (
    select finding_id, string_agg(persona || ':' || stance || ':' || confidence, '|' order by round, argument_id) as arguments,
           bool_or(contradiction_flag) as has_contradictions, bool_or(dropout_flag) as has_dropouts
    from contradictions group by 1) a using (finding_id) join judged j on j.finding_id = c.finding_id""",
       "candidates", "contradictions", "judged")
def _escalations(spark, sf):
    line = F.transform("arguments", lambda a: F.concat_ws(":", a["persona"], a["stance"], a["calibrated_confidence"]))
    return escalations(spark, sf).withColumn("arguments", line)


def gaps(spark, sf):
    return ops.gaps(I.debated_findings(spark, sf), open_results(spark, sf))


cte("gap_rows", """
  select deal_id, dimension, finding_id, claim as missing_claim
  from fx_debated where finding_id in (select finding_id from open_judged where status = 'evidence_not_found')""", "fx_debated", "open_judged")


@query("vrd_gaps", """
  select deal_id, dimension, finding_id, missing_claim from gap_rows""", "gap_rows")
def _gaps(spark, sf):
    return gaps(spark, sf)


@query("vrd_gap_summary", f"""
  select deal_id, dimension, count(*) as missing_claims, '{"|".join(domains.GAP_REMEDIES)}' as suggested_remedies
  from gap_rows group by 1, 2""", "gap_rows")
def _gap_summary(spark, sf):
    return ops.gap_summary(gaps(spark, sf))


def skipped(spark, sf):
    return ops.skipped_dimensions(I.debated_findings(spark, sf), final_states(spark, sf))


@query("vrd_skipped_dimensions", """
  select deal_id, dimension from (select distinct deal_id from fx_debated), d_dim
  except select deal_id, dimension from final_states""", "fx_debated", "d_dim", "final_states")
def _skipped(spark, sf):
    return skipped(spark, sf)


cte("skipped", """
  select deal_id, dimension from (select distinct deal_id from fx_debated), d_dim
  except select deal_id, dimension from final_states""", "fx_debated", "d_dim", "final_states")
cte("document_rows", """
  select deal_id, 'brief' as section, rank as position, finding_id as item_id,
         dimension || ' ' || severity || ' ' || claim || ' ' || section_citation || ' ' || clause_type as item from ranked
  union all select c.deal_id, 'escalations', null, c.finding_id, c.dimension || ' ' || c.claim || ' ' || j.synthesis_rationale
    from candidates c join judged j on j.finding_id = c.finding_id
  union all select deal_id, 'gaps', null, finding_id, dimension || ' ' || missing_claim from gap_rows
  union all select deal_id, 'skipped_dimensions', null, dimension, dimension from skipped""",
    "ranked", "candidates", "judged", "gap_rows", "skipped")


def document_rows(spark, sf):
    return ops.documents(brief(spark, sf), escalations(spark, sf), gaps(spark, sf), skipped(spark, sf))


@query("vrd_document", "select * from document_rows", "document_rows")
def _document(spark, sf):
    """Item rows; for the check, the JSON is shown as its main fields."""
    field = lambda *names: F.concat_ws(" ", *(F.get_json_object("item", f"$.{n}") for n in names))
    shown = (
        F.when(F.col("section") == "brief", field("dimension", "severity", "claim", "section_citation", "clause_type"))
        .when(F.col("section") == "escalations", field("dimension", "claim", "judge_notes"))
        .when(F.col("section") == "gaps", field("dimension", "missing_claim")).otherwise(field("dimension"))
    )
    return document_rows(spark, sf).withColumn("item", shown)


@query("vrd_document_counts", """
  select deal_id, count(*) filter (where section = 'brief') as brief, count(*) filter (where section = 'escalations') as escalations,
         count(*) filter (where section = 'gaps') as gaps, count(*) filter (where section = 'skipped_dimensions') as skipped_dimensions
  from (select distinct deal_id from fx_debated) left join document_rows using (deal_id) group by 1""", "fx_debated", "document_rows")
def _document_counts(spark, sf):
    return ops.document_counts(I.debated_findings(spark, sf), document_rows(spark, sf))


cte("rated", """
  select m.deal_id, m.finding_id, m.dimension, s.severity from mapped m join fx_severity s using (finding_id)""", "mapped", "fx_severity")


def rated(spark, sf):
    from briefmill.operators import findings as fnd
    return fnd.assign_severity(fnd.map_dimension(I.findings(spark, sf)))


@query("vrd_severity_counts", """
  select deal_id, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high,
         count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from rated group by 1""", "rated")
def _counts(spark, sf):
    return ops.severity_counts(rated(spark, sf))


@query("vrd_findings_table", """
  select finding_id, deal_id, dimension, severity,
         case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end as severity_rank
  from rated where dimension = 'risk_exposure'""", "rated")
def _table(spark, sf):
    return ops.findings_table(rated(spark, sf), "risk_exposure").select(
        "finding_id", "deal_id", "dimension", "severity", "severity_rank")
