"""Normalised indel similarity, 2*LCS/(len a + len b), as Column expressions.

The longest common subsequence is found by bit-parallel row updates: a bit of the row stands for a place of the left
name, and every character of the right name updates all places at once.  A row is one long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_BITS = 62  # longest left name whose row, and the sum of two rows, fit a long


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def position_masks(text: Column) -> Column:
    """Map from each character to the bits of its places; computed once a name, not once a pair."""
    chars = characters(text)
    places = F.when(F.length(text).between(1, ROW_BITS), F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))

    def bits(c: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda sum_, i: sum_.bitwiseOR(
            F.when(F.get(chars, i) == c, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))

    distinct = F.array_distinct(chars)
    return F.map_from_arrays(distinct, F.transform(distinct, bits))


def _short_lcs(size: Column, masks: Column, other: Column) -> Column:
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), size) - 1
    hits = F.transform(characters(other), lambda c: F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("bigint")))

    def step(row: Column, hit: Column) -> Column:
        met = row.bitwiseAND(hit)
        return (row + met).bitwiseOR(row - met).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(hits, full, step))


def _long_lcs(text: Column, other: Column) -> Column:
    """Row by row, for names beyond ``ROW_BITS``: a place takes the diagonal plus one where it hits, and rows never fall."""
    chars = characters(text)

    def step(row: Column, c: Column) -> Column:
        raised = F.transform(chars, lambda x, i: F.greatest(F.get(row, i + 1), F.when(x == c, F.get(row, i) + 1).otherwise(0)))
        return F.aggregate(raised, F.array(F.lit(0)), lambda out, v: F.concat(out, F.array(F.greatest(F.element_at(out, -1), v))))

    start = F.transform(F.sequence(F.lit(0), F.length(text)), lambda _: F.lit(0))
    return F.element_at(F.aggregate(characters(other), start, step), -1)


def indel_ratio(text: Column, masks: Column, other: Column) -> Column:
    """The similarity of two names; ``masks`` are the ``position_masks`` of the first.  It is a share of 100 scaled back,
    which fixes how it rounds."""
    size, total = F.length(text), F.length(text) + F.length(other)
    lcs = F.when(size <= ROW_BITS, _short_lcs(size, masks, other)).otherwise(_long_lcs(text, other))
    return F.when(total == 0, 1.0).otherwise((1.0 - (total - 2 * lcs) / total) * 100 / 100)
