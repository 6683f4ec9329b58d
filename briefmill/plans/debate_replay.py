"""Replay of recorded debates: at most three rounds, each a DataFrame step."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.operators import debate
from briefmill.session import cut_lineage


class Replay(NamedTuple):
    arguments: DataFrame
    log: DataFrame
    final: DataFrame


def replay(responses: DataFrame, gate: DataFrame, findings: DataFrame, chunks: DataFrame) -> Replay:
    """Plan, gate, vote and log each round over recorded responses, then map consensus.

    A round's results are checkpointed to the shared folder, so later rounds neither
    recompute earlier ones nor depend on one executor's memory."""
    gate, findings = cut_lineage(gate), cut_lineage(findings)
    # all that the gates ask of the chunks: the known sections and the first passage of each
    chunks = cut_lineage(debate.passages(chunks))
    log = debate.initial_states(gate)
    done: list[DataFrame] = []
    for number in range(1, domains.MAX_ROUNDS + 1):
        states = debate.close_limited(debate.current_states(log), gate, number)
        closed = states.filter(F.col("state") == "settled").join(
            debate.current_states(log).filter(F.col("state") == "active").select("deal_id", "dimension"),
            ["deal_id", "dimension"], "left_semi",
        ).select("deal_id", "dimension", "state", F.lit(number - 1).alias("round"))
        plan = debate.task_plan(states, gate, findings, number)
        recorded = responses.filter(F.col("round") == number).join(plan, ["finding_id", "persona", "round"], "left_semi")
        recorded = debate.fill_dropouts(plan, recorded)
        history = reduce(DataFrame.unionByName, done) if done else None
        gated = cut_lineage(debate.apply_gates(recorded, chunks, history))
        after = debate.round_rollup(debate.round_state(gated)).select("deal_id", "dimension", "state", "round")
        log = cut_lineage(_replace(log, closed).unionByName(after))
        done.append(gated)
    everything = reduce(DataFrame.unionByName, done)
    final = debate.dimension_rollup(debate.finding_consensus(everything), debate.current_states(log))
    return Replay(everything, log, final)


def _replace(log: DataFrame, closed: DataFrame) -> DataFrame:
    """Log with the closed dimensions' rows of that round rewritten."""
    key = ["deal_id", "dimension", "round"]
    return log.join(closed.select(*key), key, "left_anti").unionByName(closed)
