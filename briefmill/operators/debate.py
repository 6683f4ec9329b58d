"""Recorded debates: citation and consistency gates, votes, rounds.

Arguments are rows (argument_id, finding_id, deal_id, dimension, persona, round, stance,
citations, confidence, flags, notes).  A finding meets six personas for three rounds, but
no operator relies on that: votes and flags are aggregated map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from briefmill import domains
from briefmill.functions import text as T

OVERLAP_MINIMUM = 0.3
MAJORITY = 4
EXPLANATION_LENGTH = 10


# ---- gates ---------------------------------------------------------------------------------


def gate_citations(arguments: DataFrame, chunks: DataFrame, match_chunk_id: bool = False) -> DataFrame:
    """Keep citations that exist in the index, in order; verified when any is left."""
    known = chunks.select(F.col("section_id").alias("citation"))
    if match_chunk_id:
        known = known.unionByName(chunks.select(F.col("chunk_id").alias("citation")))
    kept = (
        arguments.select("argument_id", F.posexplode("citations").alias("pos", "citation"))
        .join(known.distinct(), "citation", "left_semi")
        .groupBy("argument_id").agg(F.array_sort(F.collect_list(F.struct("pos", "citation"))).alias("kept"))
    )
    valid = F.transform("kept", lambda x: x["citation"])
    return (
        arguments.drop("citations", "bm25_verified").join(kept, "argument_id", "left")
        .withColumn("citations", F.coalesce(valid, F.array().cast("array<string>")))
        .withColumn("bm25_verified", F.col("kept").isNotNull()).drop("kept")
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def passages(chunks: DataFrame) -> DataFrame:
    """(section_id, text, chunk_id) of each section's first chunk.

    Ids decide without the texts, of which only the chosen ones travel; chunks of equal ids give their least text."""
    first = chunks.groupBy("section_id").agg(F.min("chunk_id").alias("first_id"))
    first = first.select(F.col("section_id").alias("of_section"), "first_id")
    same = F.col("section_id").eqNullSafe(F.col("of_section")) & F.col("chunk_id").eqNullSafe(F.col("first_id"))
    text = F.when(F.col("chunk_id").isNotNull(), F.col("text"))  # without an id a chunk has no place
    return chunks.select("section_id", "chunk_id", "text").join(first, same).groupBy("section_id").agg(
        F.min(text).alias("text"), F.min("chunk_id").alias("chunk_id"))


def gate_passage(arguments: DataFrame, chunks: DataFrame) -> DataFrame:
    """A verified argument sharing too few words with a cited passage turns speculative.

    Only citations in use are looked up, and a passage is its section's first chunk."""
    known = passages(chunks).select(F.col("section_id").alias("citation"), _words(F.col("text")).alias("passage_words"))
    overlap = (
        arguments.filter("bm25_verified")
        .select("argument_id", _words(F.col("argument")).alias("words"), F.explode("citations").alias("citation"))
        .join(known, "citation")
        .withColumn("overlap", F.when(F.size("words") == 0, 0.0).otherwise(
            F.size(F.array_intersect("passage_words", "words")) / F.size("words")))
        .groupBy("argument_id").agg(F.min("overlap").alias("overlap"))
    )
    return arguments.join(overlap, "argument_id", "left").withColumn(
        "confidence",
        F.when(F.col("overlap") < OVERLAP_MINIMUM, "speculative").otherwise(F.col("confidence")),
    )


def gate_corroboration(arguments: DataFrame) -> DataFrame:
    """High confidence needs another persona citing the same source in the round.

    A source is corroborated when its smallest and largest citing persona differ, which
    aggregates map-side and forms no pairs."""
    cited = arguments.select("finding_id", "round", "persona", "argument_id", "confidence", F.explode("citations").alias("citation"))
    shared = (
        cited.groupBy("finding_id", "round", "citation")
        .agg(F.min("persona").alias("a"), F.max("persona").alias("b")).filter(F.col("a") != F.col("b"))
    )
    backed = (
        cited.filter(F.col("confidence") == "high")
        .join(shared, ["finding_id", "round", "citation"], "left_semi")
        .select("argument_id").distinct().withColumn("backed", F.lit(True))
    )
    weak = (F.col("confidence") == "high") & F.col("backed").isNull()
    return arguments.join(backed, "argument_id", "left").withColumn(
        "confidence", F.when(weak, "medium").otherwise(F.col("confidence"))).drop("backed")


def gate_contradiction(arguments: DataFrame) -> DataFrame:
    """Flag a stance that differs from the persona's latest earlier round without explanation.

    Arguments shrink to one stance per persona and round before the window, which then sees
    as many rows per persona as there are rounds."""
    key = ["finding_id", "persona", "round"]
    stances = arguments.groupBy(*key).agg(F.min_by("stance", "argument_id").alias("stance"))
    rounds = Window.partitionBy("finding_id", "persona").orderBy("round")
    before = stances.select(*key, F.lag("stance").over(rounds).alias("_before"))
    explained = F.length(T.strip(F.coalesce("notes", F.lit("")))) > EXPLANATION_LENGTH
    reversed_ = F.coalesce(F.col("_before") != F.col("stance"), F.lit(False)) & ~explained
    flag = F.col("contradiction_flag") if "contradiction_flag" in arguments.columns else F.lit(False)
    return arguments.join(before, key).withColumn("contradiction_flag", flag | reversed_).drop("_before")


def fill_dropouts(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """Planned personas without a response become neutral, speculative dropout arguments.

    Their ids are made from finding, persona and round: below zero where ids are numbers."""
    key = ["finding_id", "persona", "round"]
    ident = F.concat_ws(":", F.lit("dropout"), *key)
    if "argument_id" in responses.columns and not isinstance(responses.schema["argument_id"].dataType, t.StringType):
        ident = -1 - F.pmod(F.xxhash64(*key), F.lit(1 << 62))
    missing = plan.join(responses, key, "left_anti").select(
        *key, ident.alias("argument_id"), "deal_id", "dimension", F.lit("neutral").alias("stance"), F.lit(domains.DROPOUT_STEELMAN).alias("steelman"),
        F.lit(domains.DROPOUT_ARGUMENT).alias("argument"), F.array().cast("array<string>").alias("citations"),
        F.lit("speculative").alias("confidence"), F.lit(False).alias("bm25_verified"),
        F.lit(True).alias("dropout_flag"), F.lit(domains.DROPOUT_NOTES).alias("notes"),
    )
    return responses.unionByName(missing, allowMissingColumns=True)


# ---- votes -----------------------------------------------------------------------------------


def _votes(grouped) -> DataFrame:
    return grouped.agg(
        F.count("*").alias("votes"),
        *[F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in domains.STANCES],
        *[F.coalesce(F.bool_or(F.when(F.col("stance") == s, F.col("bm25_verified"))), F.lit(False)).alias(f"v_{s}")
          for s in domains.STANCES],
        F.bool_or(F.col("dropout_flag") & F.col("persona").isin(domains.OPPOSING_PERSONAS)).alias("opposing_dropout"),
    )


def round_state(arguments: DataFrame, dropout_rule: bool = True) -> DataFrame:
    """State of each finding after each round."""
    largest = F.greatest(*[F.col(f"n_{s}") for s in domains.STANCES])
    state = F.when(largest >= MAJORITY, "settled").when(F.col("v_support") & F.col("v_oppose"), "contested").otherwise("active")
    keys = [c for c in ("deal_id", "dimension", "finding_id", "round") if c in arguments.columns]
    out = _votes(arguments.groupBy(*keys)).withColumn("state", state)
    return apply_dropout_rule(out) if dropout_rule else out


def apply_dropout_rule(states: DataFrame) -> DataFrame:
    """A settled state turns contested when an opposing persona dropped out."""
    return states.withColumn(
        "state", F.when((F.col("state") == "settled") & F.col("opposing_dropout"), "contested").otherwise(F.col("state")))


def latest_per_persona(arguments: DataFrame) -> DataFrame:
    """Each persona's argument of its latest round; the first one on a tie.  An aggregate, so
    repeated arguments shrink before the shuffle."""
    keep = [c for c in arguments.columns if c not in ("finding_id", "persona")]
    newest = F.min_by(F.struct(*keep), F.struct((-F.col("round")).alias("back"), F.col("argument_id")))
    return arguments.groupBy("finding_id", "persona").agg(newest.alias("row")).select("finding_id", "persona", "row.*")


def finding_consensus(arguments: DataFrame, dropout_rule: bool = False) -> DataFrame:
    """Contested if verified on both sides, settled by a verified majority, else unresolved."""
    majority = F.lit(False)
    for stance in domains.STANCES:
        majority = majority | ((F.col(f"n_{stance}") >= MAJORITY) & F.col(f"v_{stance}"))
    state = F.when(F.col("v_support") & F.col("v_oppose"), "contested").when(majority, "settled").otherwise("unresolved")
    keys = [c for c in ("deal_id", "dimension", "finding_id") if c in arguments.columns]
    out = _votes(latest_per_persona(arguments).groupBy(*keys)).withColumn("state", state)
    return apply_dropout_rule(out) if dropout_rule else out


def _worst(state: str, order: tuple[str, ...]) -> Column:
    out = F.lit(order[-1])
    for name in reversed(order[:-1]):
        out = F.when(F.bool_or(F.col(state) == name), name).otherwise(out)
    return out


def round_rollup(states: DataFrame) -> DataFrame:
    """State of each dimension after each round: the worst of its findings."""
    return states.groupBy("deal_id", "dimension", "round").agg(
        _worst("state", ("contested", "unresolved", "active", "settled")).alias("state"))


def dimension_rollup(consensus: DataFrame, states: DataFrame) -> DataFrame:
    """Final state per dimension; one without arguments is unresolved if still active."""
    rolled = consensus.groupBy("deal_id", "dimension").agg(
        _worst("state", ("contested", "unresolved", "settled")).alias("rolled"))
    return states.join(rolled, ["deal_id", "dimension"], "left").withColumn(
        "state",
        F.coalesce("rolled", F.when(F.col("state") == "active", "unresolved").otherwise(F.col("state"))),
    ).drop("rolled")


# ---- rounds ------------------------------------------------------------------------------------


def initial_states(gate: DataFrame) -> DataFrame:
    """Dimensions with findings start active at round 0."""
    return gate.filter(F.col("mode") != "skipped").select(
        "deal_id", "dimension", F.lit("active").alias("state"), F.lit(0).alias("round"))


def current_states(log: DataFrame) -> DataFrame:
    """Latest state of each dimension in an appended log."""
    return log.groupBy("deal_id", "dimension").agg(
        F.max_by("state", "round").alias("state"), F.max("round").alias("round"))


def continues(states: DataFrame, round_number: int) -> DataFrame:
    """Per deal: does the debate go on after ``round_number`` rounds?"""
    return states.groupBy("deal_id").agg(
        (F.bool_or(F.col("state") == "active") & F.lit(round_number < domains.MAX_ROUNDS)).alias("continues"),
        F.bool_and(F.col("state") == "settled").alias("all_settled"),
    )


def close_limited(states: DataFrame, gate: DataFrame, round_number: int) -> DataFrame:
    """A limited dimension still active when a later round starts is settled."""
    if round_number <= 1:
        return states
    limited = gate.filter(F.col("mode") == "limited").select("deal_id", "dimension", F.lit(True).alias("limited"))
    ends = F.col("limited") & (F.col("state") == "active")
    return states.join(limited, ["deal_id", "dimension"], "left").withColumn(
        "state", F.when(ends, "settled").otherwise(F.col("state"))).drop("limited")


def task_plan(states: DataFrame, gate: DataFrame, findings: DataFrame, round_number: int) -> DataFrame:
    """(deal, dimension, finding, persona) to run in a round."""
    modes = gate.select("deal_id", "dimension", "mode", "personas")
    runs = F.lit(round_number <= domains.MAX_ROUNDS) & (
        (F.col("mode") == "full") | ((F.col("mode") == "limited") & F.lit(round_number == 1)))
    return (
        states.filter(F.col("state") == "active").select("deal_id", "dimension")
        .join(modes, ["deal_id", "dimension"]).filter(runs)
        .join(findings.select("deal_id", "dimension", "finding_id"), ["deal_id", "dimension"])
        .select("deal_id", "dimension", "finding_id", F.explode("personas").alias("persona"), F.lit(round_number).alias("round"))
    )


def apply_gates(arguments: DataFrame, chunks: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Citations, passages, contradictions against earlier rounds, corroboration, in that order."""
    checked = gate_passage(gate_citations(arguments, chunks), chunks).drop("overlap")
    if history is not None:
        marked = gate_contradiction(
            checked.select("finding_id", "persona", "round", "stance", "notes", "argument_id", F.lit(True).alias("now"))
            .unionByName(history.select("finding_id", "persona", "round", "stance", "notes", "argument_id", F.lit(False).alias("now")))
        )
        flags = marked.filter("now").select("argument_id", "contradiction_flag")
        checked = checked.join(flags, "argument_id")
    else:
        checked = gate_contradiction(checked)
    return gate_corroboration(checked)


# ---- compression ---------------------------------------------------------------------------------


ROUND_KEYS = ["deal_id", "dimension", "round"]
FULL_FIELDS = ["argument_id", "persona", "stance", "steelman", "argument", "confidence", "notes"]
SHORT_FIELDS = ["argument_id", "persona", "stance", "key_claim", "confidence", "notes"]


def _line(names: list[str]) -> Column:
    """Fields as one text, nulls as nothing."""
    return F.concat_ws(" | ", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names))


def compress_arguments(arguments: DataFrame) -> DataFrame:
    """Essential fields of every argument, one row each, with the tokens of the full and the short form."""
    short = arguments.withColumn("key_claim", T.key_claim(F.col("argument")))
    return short.select(
        *ROUND_KEYS, "argument_id", "persona", "stance", "key_claim", F.col("citations").alias("citation_ids"), "confidence",
        "contradiction_flag", "dropout_flag", "notes",
        T.token_estimate(_line([c for c in FULL_FIELDS if c in arguments.columns])).alias("original_tokens"), T.token_estimate(_line(SHORT_FIELDS)).alias("compressed_tokens"))


def compress_rounds(compressed: DataFrame, states: DataFrame) -> DataFrame:
    """Per (deal, dimension, round): the dimension's state, argument count and token sums."""
    return compressed.groupBy(*ROUND_KEYS).agg(
        F.count("*").alias("argument_count"), F.sum("original_tokens").alias("original_tokens"),
        F.sum("compressed_tokens").alias("compressed_tokens"),
    ).join(states.select(*ROUND_KEYS, F.col("state").alias("dimension_state")), ROUND_KEYS, "left")


def token_reduction(rounds: DataFrame) -> DataFrame:
    """Share of tokens saved per dimension and round."""
    return rounds.select(
        *ROUND_KEYS, "original_tokens", "compressed_tokens",
        (1 - F.col("compressed_tokens") / F.col("original_tokens")).alias("reduction"))
