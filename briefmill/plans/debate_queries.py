"""Registered queries: debate gates, votes and rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefmill import domains
from briefmill.operators import debate as ops
from briefmill.operators import findings as fnd
from briefmill.operators import prompts
from briefmill.plans import inputs as I
from briefmill.plans.debate_replay import replay
from briefmill.plans.registry import cte, query

_GATE = """
  select deal_id, dimension, count(*) as n, case when count(*) >= 3 then 'full' else 'limited' end as mode
  from fx_debated group by 1, 2"""
cte("d_gate", _GATE, "fx_debated")


def gate(spark, sf):
    rows = I.debated_findings(spark, sf)
    return fnd.dimension_gate(rows, rows)


def _state_sql(keys: str, source: str) -> str:
    return f"""
  select {keys}, case when settled then case when opposing_dropout then 'contested' else 'settled' end
                      when vs and vo then 'contested' else 'active' end as state,
         settled, vs, vo, opposing_dropout, votes
  from (select {keys}, count(*) as votes,
               greatest(count(*) filter (where stance = 'support'), count(*) filter (where stance = 'oppose'),
                        count(*) filter (where stance = 'neutral')) >= 4 as settled,
               coalesce(bool_or(bm25_verified) filter (where stance = 'support'), false) as vs,
               coalesce(bool_or(bm25_verified) filter (where stance = 'oppose'), false) as vo,
               bool_or(dropout_flag and opposing) as opposing_dropout
        from {source} group by {keys})"""


cte("r_state", _state_sql("deal_id, dimension, finding_id, round", "fx_arguments"), "fx_arguments")
cte("r_rollup", """
  select deal_id, dimension, round, case when bool_or(state = 'contested') then 'contested'
         when bool_or(state = 'active') then 'active' else 'settled' end as state from r_state group by 1, 2, 3""", "r_state")
cte("s_log", """
  select deal_id, dimension, 0 as round, 'active' as state from d_gate
  union all select deal_id, dimension, round, state from r_rollup""", "d_gate", "r_rollup")


def state_log(spark, sf):
    start = ops.initial_states(gate(spark, sf))
    rounds = ops.round_rollup(ops.round_state(I.arguments(spark, sf)))
    return start.unionByName(rounds)


@query("deb_state_log", """
  select deal_id, dimension, arg_max(state, round) as state, cast(max(round) as bigint) as round from s_log group by 1, 2""", "s_log")
def _log(spark, sf):
    return ops.current_states(state_log(spark, sf))


@query("deb_task_plan", """
  select g.deal_id, g.dimension, f.finding_id, p.persona, r.round
  from (select unnest([1, 2, 3]) as round) r, s_log s join d_gate g using (deal_id, dimension)
  join fx_debated f using (deal_id, dimension) join d_persona p on (g.mode = 'full' or p.in_limited)
  where s.round = r.round - 1 and s.state = 'active' and (g.mode = 'full' or r.round = 1)""",
       "s_log", "d_gate", "fx_debated", "d_persona")
def _plan(spark, sf):
    log, modes, found = state_log(spark, sf), gate(spark, sf), I.debated_findings(spark, sf)
    plans = [
        ops.task_plan(ops.close_limited(log.filter(F.col("round") == n - 1), modes, n), modes, found, n)
        for n in range(1, domains.MAX_ROUNDS + 1)]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query("deb_exit_check", """
  select deal_id, round, bool_or(state = 'active') and round < 3 as continues, bool_and(state = 'settled') as all_settled
  from s_log group by 1, 2""", "s_log")
def _exit(spark, sf):
    log = state_log(spark, sf)
    parts = [ops.continues(log.filter(F.col("round") == n), n).withColumn("round", F.lit(n)) for n in range(domains.MAX_ROUNDS + 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("txt_debate_prompts", """
  select f.finding_id, p.persona, cast(1 as bigint) as round, 'DEBATE DIMENSION: ' || f.dimension || chr(10) || 'CORE QUESTION: ' || d.core_question || chr(10) || 'ROUND: 1'
         || chr(10) || chr(10) || 'FINDING UNDER DEBATE:' || chr(10) || '  Claim: ' || f.claim || chr(10) || '  Citation: ' || f.citation || chr(10) || '  Current Confidence: medium' as prompt
  from fx_debated f join d_gate g using (deal_id, dimension) join d_persona p on (g.mode = 'full' or p.in_limited) join d_dim d on d.dimension = f.dimension""",
       "fx_debated", "d_gate", "d_persona", "d_dim")
def _debate_prompts(spark, sf):
    modes, found = gate(spark, sf), I.debated_findings(spark, sf)
    plan = ops.task_plan(ops.initial_states(modes), modes, found, 1)
    return prompts.debate_prompts(plan, found.withColumn("confidence", F.lit("medium")), domains.dimensions(spark).select("dimension", "core_question"))


cte("cited", """
  select argument_id, 0 as pos, citation_1 as citation from fx_arguments union all
  select argument_id, 1, citation_2 from fx_arguments""", "fx_arguments")
cte("kept_citations", """
  select argument_id, pos, citation from cited where citation in (select section_id from chunks)""", "cited", "chunks")


@query("deb_gate_citations", """
  select argument_id, coalesce(string_agg(citation, '|' order by pos), '') as citations, count(citation) > 0 as bm25_verified
  from fx_arguments left join kept_citations using (argument_id) group by 1""", "fx_arguments", "kept_citations")
def _citations(spark, sf):
    return ops.gate_citations(I.arguments(spark, sf), I.chunks(spark, sf)).select("argument_id", "citations", "bm25_verified")


cte("passage_overlap", r"""
  select argument_id, min(len(list_intersect(w, p)) / len(w)) as overlap
  from (select argument_id, list_distinct(list_filter(regexp_split_to_array(lower(argument), '\s+'), lambda x: x <> '')) as w from fx_arguments)
  join kept_citations using (argument_id)
  join (select section_id as citation, list_distinct(list_filter(regexp_split_to_array(lower(arg_min(text, chunk_id)), '\s+'), lambda x: x <> '')) as p
        from chunks group by 1) using (citation) group by 1""", "fx_arguments", "kept_citations", "chunks")


@query("deb_gate_passage", """
  select argument_id, round(overlap, 6) as overlap, case when overlap < 0.3 then 'speculative' else confidence end as confidence
  from fx_arguments left join passage_overlap using (argument_id)""", "fx_arguments", "passage_overlap")
def _passage(spark, sf):
    chunks = I.chunks(spark, sf)
    return ops.gate_passage(ops.gate_citations(I.arguments(spark, sf), chunks), chunks).select("argument_id", "overlap", "confidence")


@query("deb_gate_corroboration", """
  select argument_id, case when confidence = 'high' and not exists (
      select 1 from fx_arguments o where o.finding_id = a.finding_id and o.round = a.round and o.persona <> a.persona
        and (o.citation_1 in (a.citation_1, a.citation_2) or o.citation_2 in (a.citation_1, a.citation_2)))
    then 'medium' else confidence end as confidence from fx_arguments a""", "fx_arguments")
def _corroboration(spark, sf):
    return ops.gate_corroboration(I.arguments(spark, sf)).select("argument_id", "confidence")


cte("contradictions", """
  select *, coalesce(stance <> lag(stance) over (partition by finding_id, persona order by round), false)
            and length(trim(notes)) <= 10 as contradiction_flag from fx_arguments""", "fx_arguments")


@query("deb_gate_contradiction", "select argument_id, contradiction_flag from contradictions", "contradictions")
def _contradiction(spark, sf):
    return ops.gate_contradiction(I.arguments(spark, sf)).select("argument_id", "contradiction_flag")


@query("deb_round_state", """
  select finding_id, round, votes, case when settled then 'settled' when vs and vo then 'contested' else 'active' end as state
  from r_state""", "r_state")
def _round(spark, sf):
    return ops.round_state(I.arguments(spark, sf), dropout_rule=False).select("finding_id", "round", "votes", "state")


@query("deb_dropout_rule", "select finding_id, round, opposing_dropout, state from r_state", "r_state")
def _dropout(spark, sf):
    return ops.round_state(I.arguments(spark, sf)).select("finding_id", "round", "opposing_dropout", "state")


@query("deb_dropout_fill", f"""
  select finding_id, persona, round, case when dropout_flag then 'neutral' else stance end as stance,
         case when dropout_flag then 'speculative' else confidence end as confidence, dropout_flag,
         case when dropout_flag then '{domains.DROPOUT_ARGUMENT}' else argument end as argument from fx_arguments""", "fx_arguments")
def _fill(spark, sf):
    rows = I.arguments(spark, sf)
    filled = ops.fill_dropouts(rows.select("finding_id", "persona", "round", "deal_id", "dimension"), rows.filter(~F.col("dropout_flag")))
    return filled.select("finding_id", "persona", "round", "stance", "confidence", "dropout_flag", "argument")


cte("latest", """
  select * from (select *, row_number() over (partition by finding_id, persona order by round desc, argument_id) as rn from fx_arguments)
  where rn = 1""", "fx_arguments")


@query("deb_latest_per_persona", "select finding_id, persona, round, argument_id, stance, bm25_verified from latest", "latest")
def _latest(spark, sf):
    return ops.latest_per_persona(I.arguments(spark, sf)).select(
        "finding_id", "persona", "round", "argument_id", "stance", "bm25_verified")


def _consensus_sql(source: str) -> str:
    sides = " or ".join(
        f"(count(*) filter (where stance = '{s}') >= 4 and bool_or(bm25_verified) filter (where stance = '{s}'))" for s in domains.STANCES)
    return f"""
  select deal_id, dimension, finding_id,
         case when coalesce(bool_or(bm25_verified) filter (where stance = 'support'), false)
               and coalesce(bool_or(bm25_verified) filter (where stance = 'oppose'), false) then 'contested'
              when coalesce({sides}, false) then 'settled' else 'unresolved' end as state
  from {source} group by 1, 2, 3"""


cte("consensus", _consensus_sql("latest"), "latest")


@query("deb_finding_consensus", "select finding_id, state from consensus", "consensus")
def _consensus(spark, sf):
    return ops.finding_consensus(I.arguments(spark, sf)).select("finding_id", "state")


cte("final_states", """
  select g.deal_id, g.dimension, coalesce(r.state, 'unresolved') as state, g.n as findings_count
  from d_gate g left join (
    select deal_id, dimension, case when bool_or(state = 'contested') then 'contested'
           when bool_or(state = 'unresolved') then 'unresolved' else 'settled' end as state from consensus group by 1, 2) r
  using (deal_id, dimension)""", "d_gate", "consensus")


def final_states(spark, sf):
    """Final dimension states, stored as the debate leaves them."""
    return I.stored(spark, sf, "states", lambda: rolled_states(spark, sf))


def rolled_states(spark, sf):
    return ops.dimension_rollup(ops.finding_consensus(I.arguments(spark, sf)), ops.initial_states(gate(spark, sf)))


@query("deb_dimension_rollup", "select deal_id, dimension, state from final_states", "final_states")
def _rollup(spark, sf):
    return rolled_states(spark, sf).select("deal_id", "dimension", "state")


cte("compressed", """
  select deal_id, dimension, round, argument_id, persona, stance, substr(argument, 1, instr(argument, '. ')) as key_claim,
         citation_1 || '|' || citation_2 as citation_ids, confidence, contradiction_flag, dropout_flag, notes,
         greatest(1, length(concat_ws(' | ', argument_id, persona, stance, argument, confidence, notes)) // 4) as original_tokens,
         greatest(1, length(concat_ws(' | ', argument_id, persona, stance, substr(argument, 1, instr(argument, '. ')), confidence, notes)) // 4)
           as compressed_tokens
  from contradictions""", "contradictions")
cte("compressed_rounds", """
  select c.deal_id, c.dimension, c.round, count(*) as argument_count, cast(sum(original_tokens) as bigint) as original_tokens,
         cast(sum(compressed_tokens) as bigint) as compressed_tokens, any_value(s.state) as dimension_state
  from compressed c join s_log s using (deal_id, dimension, round) group by 1, 2, 3""", "compressed", "s_log")


def compressed(spark, sf):
    return ops.compress_arguments(ops.gate_contradiction(I.arguments(spark, sf)))


def compressed_rounds(spark, sf):
    states = ops.round_rollup(ops.round_state(I.arguments(spark, sf)))
    return ops.compress_rounds(compressed(spark, sf), states)


@query("deb_compress_arguments", "select * from compressed", "compressed")
def _compress_arguments(spark, sf):
    return compressed(spark, sf)


@query("deb_compress_round", "select * from compressed_rounds", "compressed_rounds")
def _compress(spark, sf):
    return compressed_rounds(spark, sf)


@query("deb_token_reduction", """
  select deal_id, dimension, round, original_tokens, compressed_tokens,
         round(1 - compressed_tokens / cast(original_tokens as double), 6) as reduction from compressed_rounds""", "compressed_rounds")
def _reduction(spark, sf):
    return ops.token_reduction(compressed_rounds(spark, sf))


@query("deb_replay")
def _replay(spark, sf):
    rows = I.arguments(spark, sf)
    return replay(rows, gate(spark, sf), I.debated_findings(spark, sf), I.chunks(spark, sf)).final
