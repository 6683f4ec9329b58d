"""Entity mentions and three-tier name resolution as joins.

Names are resolved once per distinct (type, normalised name), however often they occur."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T
from briefmill.functions.name_blocks import similar
from briefmill.session import cut_lineage

FUZZY_THRESHOLD = 0.85
REVIEW_THRESHOLD = 0.60
BUNDLE_BONUS = 0.05
REACH = 0.05  # a candidate is a contender within this much of the best score
ROUNDING = 1e-9
LEVELS = (0.90, 0.80, 0.70, REVIEW_THRESHOLD)
BLOCK_NAMES = 8_192  # names of one type that meet in one task with as many others
MOST_TASKS = 2_000


def mentions(spans: DataFrame) -> DataFrame:
    """Labelled spans with a supported label, as typed mentions with provenance."""
    labels = domains.frame(spans.sparkSession, list(domains.ENTITY_LABELS.items()), "label string, entity_type string")
    return spans.join(labels, "label").withColumn("name", T.strip("name")).drop("label")


def normalized(name: str | Column = "name") -> Column:
    return T.normalize_name(F.col(name) if isinstance(name, str) else name)


def _role_free(name: str = "name") -> Column:
    return normalized(T.strip_roles(F.col(name), domains.ROLE_WORDS))


def person_match(left: Column, right: Column) -> Column:
    """Two-word names sharing one word, where the other is an initial of its counterpart.

    The first shared pair in the order (last, last), (last, first), (first, last),
    (first, first) decides."""

    def initial(a: Column, b: Column) -> Column:
        return ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))

    l, r = (lambda i: F.get(left, i)), (lambda i: F.get(right, i))  # noqa: E741
    chain = (
        F.when(l(1) == r(1), initial(l(0), r(0))).when(l(1) == r(0), initial(l(0), r(1)))
        .when(l(0) == r(1), initial(l(1), r(0))).when(l(0) == r(0), initial(l(1), r(1))).otherwise(False)
    )
    return (F.size(left) == 2) & (F.size(right) == 2) & chain


def _name_words(name: str) -> Column:
    spaced = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def _person_keys(names: DataFrame, name: str) -> DataFrame:
    """(surname, initial) keys under both readings of a two-word person name."""
    words = names.filter(F.col("entity_type") == "person").withColumn("words", _name_words(name)).filter(F.size("words") == 2)
    reading = lambda s, g: F.struct(
        F.get("words", F.lit(s)).alias("surname"), F.substring(F.get("words", F.lit(g)), 1, 1).alias("initial"),
        (F.length(F.get("words", F.lit(g))) == 1).alias("single"))
    return words.select("entity_type", name, "words", F.inline(F.array(reading(1, 0), reading(0, 1)))).distinct()


def person_pairs(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entity_type, name, candidate) person matches.  One side must be an initial, so full
    names sharing a frequent surname never meet each other."""
    left = _person_keys(names, "name").withColumnRenamed("words", "l_words")
    right = _person_keys(candidates, "candidate").withColumnRenamed("words", "r_words")
    key = ["entity_type", "surname", "initial"]
    one = left.filter("single").drop("single").join(right.drop("single"), key)
    two = left.filter(~F.col("single")).drop("single").join(right.filter("single").drop("single"), key)
    return one.unionByName(two).filter(person_match(F.col("l_words"), F.col("r_words"))).select("entity_type", "name", "candidate").distinct()


def exact_pairs(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entity_type, name, candidate) equal by normalised or role-free name or person match."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(F.concat(F.lit("n:"), normalized(name)), F.concat(F.lit("r:"), _role_free(name)))
        return df.select("entity_type", name, F.explode(keys).alias("key"))

    equal = keyed(names, "name").join(keyed(candidates, "candidate"), ["entity_type", "key"]).select("entity_type", "name", "candidate")
    return equal.unionByName(person_pairs(names, candidates)).distinct()


def tier1(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Names with exactly one exact candidate."""
    return (
        exact_pairs(names, candidates).groupBy("entity_type", "name")
        .agg(F.count("*").alias("matches"), F.min("candidate").alias("canonical"))
        .filter(F.col("matches") == 1).drop("matches")
    )


# ---- fuzzy candidates ---------------------------------------------------------------------------


def similar_pairs(left: DataFrame, right: DataFrame | None, ratio: float, reach: float | None = None) -> DataFrame:
    """(entity_type, norm, other, ratio) for all pairs at or above ``ratio``, exactly; with ``reach`` a pair that is further
    than that below the best ratio of its ``norm`` may be left out.  Without ``right`` the names of ``left`` are compared with each
    other, once a pair, and a pair of two different names is listed both ways.

    Both inputs are distinct (entity_type, norm).  The names of a type are dealt into blocks of bounded size, and each two
    blocks of the two sides meet in one task, which bounds a pair by its shared characters before it is compared."""

    alone = right is None
    right = (left if alone else right).select(F.col("entity_type").alias("entity_type"), F.col("norm").alias("norm"))  # columns of its own

    def dealt(names: DataFrame, block: str, across: str) -> DataFrame:
        own, zero, last = F.pmod(F.xxhash64("norm"), F.col(block)), F.lit(0).cast("bigint"), F.col(across) - 1
        first = own if alone and block == "i" else zero
        last = own if alone and block == "j" else last
        return names.filter("norm is not null").join(sides, "entity_type").select(
            "entity_type", "norm", own.alias(block), F.explode(F.sequence(first, last)).alias(across))

    blocks = lambda names, to: names.groupBy("entity_type").agg(F.ceil(F.count("norm") / BLOCK_NAMES).alias(to)).filter(f"{to} > 0")
    sides = cut_lineage(blocks(left, "i").join(blocks(right, "j"), "entity_type"))  # one row a type
    tasks = sides.agg(F.sum(F.col("i") * F.col("j"))).first()[0] or 1
    key = ["entity_type", "i", "j"]
    mine, theirs = (df.repartition(min(tasks, MOST_TASKS), *key) for df in (dealt(left, "i", "j"), dealt(right, "j", "i")))

    def met(group: tuple, names: pa.Table, others: pa.Table) -> pa.Table:
        a, b = names.column("norm").combine_chunks(), others.column("norm").combine_chunks()
        out = []
        if len(a) and len(b):
            for i, j, ratios in similar(a.to_pylist(), b.to_pylist(), ratio, reach):
                pairs = pa.table({"norm": a.take(pa.array(i)), "other": b.take(pa.array(j)), "ratio": pa.array(ratios, pa.float64())})
                if alone and group[1] == group[2]:
                    pairs = pairs.filter(pc.less(pairs["norm"], pairs["other"]))
                out.append(pairs)
        found = pa.concat_tables(out) if out else pa.schema([("norm", pa.string()), ("other", pa.string()), ("ratio", pa.float64())]).empty_table()
        return found.add_column(0, "entity_type", pa.repeat(pa.scalar(group[0].as_py(), pa.string()), len(found)))

    found = mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(met, "entity_type string, norm string, other string, ratio double")
    if not alone:
        return found
    either = F.array(F.struct("norm", "other"), F.struct(F.col("other").alias("norm"), F.col("norm").alias("other")))
    return found.select("entity_type", "ratio", F.inline(either)).select("entity_type", "norm", "other", "ratio")


def fuzzy_scores(names: DataFrame, candidates: DataFrame, minimum: float, reach: float | None = None) -> DataFrame:
    """(deal_id, entity_type, name, candidate, score) with the bundle bonus, for scores at or
    above ``minimum``; with ``reach`` those further below a name's best score may be left out.

    ``names``: (deal_id, entity_type, name); ``candidates``: (deal_id, entity_type, candidate),
    the deals being where a candidate has provenance.  Normalised names, ``norm`` and ``other``, are taken where they are there."""
    names, candidates = _with_norm(names, "name", "norm"), _with_norm(candidates, "candidate", "other")
    distinct_candidates = candidates.select("entity_type", "candidate", "other").distinct()
    pairs = similar_pairs(
        names.select("entity_type", "norm").distinct(),
        distinct_candidates.select("entity_type", F.col("other").alias("norm")).distinct(),
        minimum - BUNDLE_BONUS, None if reach is None else reach + BUNDLE_BONUS,
    )
    bundle = candidates.select("deal_id", "entity_type", "candidate").distinct().withColumn("in_bundle", F.lit(True))
    score = F.when(F.col("in_bundle"), F.least(F.col("ratio") + BUNDLE_BONUS, F.lit(1.0))).otherwise(F.col("ratio"))
    return (
        names.select("deal_id", "entity_type", "name", "norm").distinct()
        .join(pairs, ["entity_type", "norm"])
        .join(distinct_candidates, ["entity_type", "other"])
        .join(bundle, ["deal_id", "entity_type", "candidate"], "left")
        .withColumn("score", score).filter(F.col("score") >= minimum)
        .select("deal_id", "entity_type", "name", "candidate", "score")
    )


def _with_norm(names: DataFrame, name: str, norm: str) -> DataFrame:
    return names if norm in names.columns else names.withColumn(norm, normalized(name))


NAME = ["deal_id", "entity_type", "name"]


def best_matches(scores: DataFrame) -> DataFrame:
    """Best score per name, the number of candidates reaching it and the first of them."""
    per_score = scores.groupBy(*NAME, "score").agg(F.count("*").alias("leaders"), F.min("candidate").alias("canonical"))
    return per_score.groupBy(*NAME).agg(F.max_by(F.struct("score", "leaders", "canonical"), "score").alias("b")).select(*NAME, "b.*")


def contenders(names: DataFrame, candidates: DataFrame, minimum: float = REVIEW_THRESHOLD) -> DataFrame:
    """(deal_id, entity_type, name, candidate, score) of the candidates within ``REACH`` of a name's best score, all scores
    being at least ``minimum``.

    Bounded search: the levels are visited from the highest, each lists the scores that reach it, and a name whose best
    score does so is settled and never compared with anything less alike."""
    left, found = cut_lineage(names.select(*NAME).distinct().withColumn("norm", normalized())), None
    candidates = cut_lineage(candidates.select("deal_id", "entity_type", "candidate").distinct().withColumn("other", normalized("candidate")))
    for level in [*(x for x in LEVELS if x > minimum), minimum]:
        scores = cut_lineage(fuzzy_scores(left, candidates, max(level - REACH - ROUNDING, minimum), REACH + ROUNDING))
        best = scores.groupBy(*NAME).agg(F.max("score").alias("best")).filter(F.col("best") >= level)
        close = scores.join(best, NAME).filter(F.col("score") >= F.col("best") - REACH - ROUNDING).drop("best")
        found = close if found is None else found.unionByName(close)
        left = cut_lineage(left.join(best.select(*NAME), NAME, "left_anti"))
    return found


def unresolved(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Names that tier 1 leaves open."""
    wanted = names.select(*NAME).distinct()
    exact = tier1(wanted.select("entity_type", "name").distinct(), candidates.select("entity_type", "candidate").distinct())
    return wanted.join(exact, ["entity_type", "name"], "left_anti")


def resolve(names: DataFrame, candidates: DataFrame, minimum: float = REVIEW_THRESHOLD, close: DataFrame | None = None) -> DataFrame:
    """Tier, status, canonical name and confidence per (deal, type, name).

    ``close`` are the ``contenders`` of the unresolved names, where they are known already.  A name whose best score is below
    ``minimum`` is unconfirmed with a null confidence."""
    wanted = names.select(*NAME).distinct()
    exact = tier1(wanted.select("entity_type", "name").distinct(), candidates.select("entity_type", "candidate").distinct())
    exact = cut_lineage(exact)
    open_names = cut_lineage(wanted.join(exact, ["entity_type", "name"], "left_anti"))
    best = best_matches(contenders(open_names, candidates, minimum) if close is None else close)
    fuzzy = (F.col("score") > FUZZY_THRESHOLD) & (F.col("leaders") == 1)
    rest = open_names.join(best, NAME, "left").select(
        *NAME, F.when(fuzzy, F.col("canonical")).otherwise(F.col("name")).alias("canonical"),
        F.when(fuzzy, 2).alias("tier"), F.when(fuzzy, "confirmed").otherwise("unconfirmed_node").alias("status"),
        F.col("score").alias("confidence"), F.when(~F.coalesce(fuzzy, F.lit(False)), "no_unique_fuzzy_match").alias("reason"))
    first = wanted.join(exact, ["entity_type", "name"]).select(
        *NAME, "canonical", F.lit(1).alias("tier"), F.lit("confirmed").alias("status"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("reason"))
    return first.unionByName(rest)


def needs_review(resolutions: DataFrame) -> DataFrame:
    """Unconfirmed names whose best score lies between the review and the fuzzy threshold."""
    return resolutions.filter(
        (F.col("status") == "unconfirmed_node") & F.col("confidence").between(REVIEW_THRESHOLD, FUZZY_THRESHOLD))


def review_queue(resolutions: DataFrame, close: DataFrame) -> DataFrame:
    """One row per name to disambiguate and contender; a row form, so a name with very many of them is no special case."""
    return needs_review(resolutions).select(*NAME).join(close, NAME)


def whole_review_queue(resolutions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per name to disambiguate and candidate of its type that reaches the review threshold, however far below the best."""
    return fuzzy_scores(cut_lineage(needs_review(resolutions).select(*NAME)), candidates, REVIEW_THRESHOLD)


def apply_decisions(queue: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outcome of disambiguation per queued name.  A decision may name any candidate of the type, shown in the queue or not.

    ``decisions``: (deal_id, entity_type, name, merge, canonical_name, confidence, reason, failed)."""
    offered = candidates.select("entity_type", F.col("candidate").alias("canonical_name"), F.lit(True).alias("offered")).distinct()
    names = queue.select(*NAME).distinct().join(decisions, NAME, "left")
    joined = names.join(offered, ["entity_type", "canonical_name"], "left")
    why = (
        F.when(F.col("merge").isNull() & F.col("failed").isNull(), "no_llm_resolution_available")
        .when(F.coalesce("failed", F.lit(False)) | F.col("merge").isNull(), "llm_resolution_failed")
        .when(~F.col("merge"), "llm_rejected_merge")
        .when(F.col("offered").isNull(), "llm_returned_unknown_canonical_name")
    )
    return joined.withColumn("why", why).select(
        *NAME, F.when(F.col("why").isNull(), F.col("canonical_name")).otherwise(F.col("name")).alias("canonical"),
        F.when(F.col("why").isNull(), 3).alias("tier"),
        F.when(F.col("why").isNull(), "confirmed").otherwise("unconfirmed_node").alias("status"),
        F.when(F.col("why").isNull(), F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.coalesce("why", "reason").alias("reason"))


def tier_mix(resolutions: DataFrame) -> DataFrame:
    """Share of names per tier and status."""
    counts = resolutions.groupBy("tier", "status").agg(F.count("*").alias("names"))
    return counts.withColumn("share", F.col("names") / resolutions.agg(F.count("*").alias("n")).select("n").scalar())


# ---- canonical names of a corpus -------------------------------------------------------------------


def canonicalise(occurrences: DataFrame) -> DataFrame:
    """Canonical name per (type, normalised name), from first appearances.

    ``occurrences``: (entity_type, name, seq).  Every name points to its best earlier match:
    the only exact one, else the only one with the highest ratio above the threshold.
    Pointers are followed by doubling, so the number of steps is the logarithm of the
    longest chain; each step is checkpointed to the shared folder."""
    seen = (
        occurrences.withColumn("norm", normalized()).groupBy("entity_type", "norm")
        .agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
    )
    seen = cut_lineage(seen)
    earlier = seen.select("entity_type", F.col("name").alias("candidate"), F.col("norm").alias("other"), F.col("seq").alias("other_seq"))
    place = seen.select("entity_type", "name", "norm", "seq")
    exact = (
        exact_pairs(seen.select("entity_type", "name"), earlier.select("entity_type", "candidate"))
        .join(place, ["entity_type", "name"]).join(earlier, ["entity_type", "candidate"])
        .filter(F.col("other_seq") < F.col("seq"))
        .select("entity_type", "norm", "other", F.lit(2.0).alias("score"))
    )
    keys = seen.select("entity_type", "norm")
    fuzzy = (
        similar_pairs(keys, None, FUZZY_THRESHOLD)
        .join(place.select("entity_type", "norm", "seq"), ["entity_type", "norm"])
        .join(earlier.select("entity_type", "other", "other_seq"), ["entity_type", "other"])
        .filter((F.col("other_seq") < F.col("seq")) & (F.col("ratio") > FUZZY_THRESHOLD))
        .select("entity_type", "norm", "other", F.col("ratio").alias("score"))
    )
    counted = exact.unionByName(fuzzy).groupBy("entity_type", "norm", "score").agg(
        F.countDistinct("other").alias("leaders"), F.min("other").alias("parent"))
    usable = counted.filter((F.col("score") <= 1.0) | (F.col("leaders") == 1))
    best = usable.groupBy("entity_type", "norm").agg(F.max_by(F.struct("leaders", "parent"), "score").alias("b")).filter(
        F.col("b.leaders") == 1).select("entity_type", "norm", F.col("b.parent").alias("parent"))
    pointers = cut_lineage(keys.join(best, ["entity_type", "norm"], "left").withColumn("parent", F.coalesce("parent", "norm")))
    while True:
        up = pointers.select("entity_type", F.col("norm").alias("parent"), F.col("parent").alias("next"))
        stepped = cut_lineage(
            pointers.join(up, ["entity_type", "parent"]).select("entity_type", "norm", F.col("next").alias("parent"),
                                                                  (F.col("next") != F.col("parent")).alias("moved")))
        pointers = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            break
    roots = seen.select("entity_type", F.col("norm").alias("parent"), F.col("name").alias("canonical"))
    return pointers.join(roots, ["entity_type", "parent"]).join(seen, ["entity_type", "norm"]).select(
        "entity_type", "name", "norm", "canonical", (F.col("norm") == F.col("parent")).alias("is_canonical"))
