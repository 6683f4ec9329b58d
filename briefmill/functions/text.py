"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\x0b"
WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD}+(?:[-']{WORD}+)*"
TERM = rf"{WORD}+"
CLAUSE_BREAK = r"\s(?<=[.;]\s)\s*|\r?\n+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SECTION = r"(?:Section|Article)\s+\d+(?:\.\d+)*(?:\([A-Za-z0-9]+\))*"
# what stands before a reference is looked at where one can begin, not at every character
SECTION_REFERENCE = rf"(?i)(?:S(?<!{WORD}S)ection|A(?<!{WORD}A)rticle)\s+\d+(?:\.\d+)*(?:\([A-Za-z0-9]+\))*"
SECTION_HEADER = rf"(?i)^\s*({SECTION})\b(.*)$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def count_tokens(text: Column) -> Column:
    """Lexical tokens; inner hyphens and apostrophes join."""
    return F.regexp_count(text, F.lit(TOKEN))


def terms(text: Column) -> Column:
    """Lower-cased index terms in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def split_clauses(text: Column) -> Column:
    """Pieces ending at a sentence stop or line break, stripped, empties dropped."""
    return F.filter(F.transform(F.split(text, CLAUSE_BREAK), strip), lambda c: c != "")


def split_oversized(text: Column, max_tokens: int) -> Column:
    """Pieces of exactly ``max_tokens`` tokens, each keeping the original characters up to
    the next piece's first token; short text stays whole.

    Tokens have a character between them, so most text is short by its length.  The marked text is bound by a list of
    one, since a lambda would evaluate it again for every piece."""
    marked = F.split(F.regexp_replace(text, f"({TOKEN})", "\x01$1"), "\x01")
    cut = lambda m: F.transform(
        F.sequence(F.lit(2), F.size(m), F.lit(max_tokens)), lambda s: strip(F.array_join(F.slice(m, s, max_tokens), "")))
    pieces = F.get(F.transform(F.array(marked), cut), 0)
    short = (F.length(text) <= 2 * max_tokens) | (count_tokens(text) <= max_tokens)
    return F.when(short, F.array(text)).otherwise(pieces)


def section_references(text: Column) -> Column:
    """References in first-seen order and spelling, unique ignoring case.

    The text is searched once: lists of one bind what is found, which a lambda would find again for every reference."""
    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(SECTION_REFERENCE), 0)), lambda f: F.struct(
        f.alias("spelled"), F.transform(f, F.lower).alias("folded")))
    first = lambda b: F.filter(b["spelled"], lambda x, i: F.array_position(b["folded"], F.lower(x)) == i + 1)
    return F.get(F.transform(found, first), 0)


def section_header(line: Column) -> Column:
    """The section a line opens, or null when it is ordinary text, as most lines are by their first word."""
    opens = F.lower(F.substring(strip(line), 1, 7)).isin("section", "article")
    name = F.regexp_extract(line, SECTION_HEADER, 1)
    rest = F.btrim(F.regexp_extract(line, SECTION_HEADER, 2), F.lit(" .:-"))
    is_prose = (F.regexp_count(rest, F.lit(r"\S+")) > 12) | rest.endswith(".") | rest.endswith(";")
    return F.when(opens & (name != "") & ~is_prose, name)


EDGE = "\x01"


def word_edges(lowered: Column) -> Column:
    """Lower-cased text with every run of word characters between edge marks, for ``has_phrase``."""
    return F.regexp_replace(lowered, f"({TERM})", f"{EDGE}$1{EDGE}")


def has_phrase(lowered: Column, edged: Column, phrase: str) -> Column:
    """Phrase test on word boundaries in lower-cased text.

    ``edged`` are its ``word_edges``, marked once however many phrases are tested: a phrase that begins and ends with a word
    character stands on word boundaries where its own marked form occurs.  Other phrases take a regular expression."""
    wanted = phrase.lower()
    runs = re.sub(r"(\w+)", rf"{EDGE}\1{EDGE}", wanted)
    if wanted.isascii() and runs.startswith(EDGE) and runs.endswith(EDGE) and wanted.count(EDGE) == 0:
        return edged.contains(runs)
    return lowered.contains(wanted) & lowered.rlike(rf"(?<!{WORD})\Q{wanted}\E(?!{WORD})")


def phrases_found(lowered: Column, phrases: Sequence[str]) -> Column:
    """The ``phrases``, lower-cased, that stand on word boundaries in lower-cased text; one pass for all that are one word."""
    wanted = list(dict.fromkeys(p.lower() for p in phrases))
    single = [w for w in wanted if w.isascii() and re.fullmatch(r"\w+", w)]
    others = [F.when(_stands(lowered, w), F.lit(w)) for w in wanted if w not in single]
    empty = F.array().cast("array<string>")
    words = F.array_intersect(F.regexp_extract_all(lowered, F.lit(TERM), 0), F.array(*map(F.lit, single))) if single else empty
    return F.concat(words, F.array_compact(F.array(*others))) if others else words


def _stands(lowered: Column, wanted: str) -> Column:
    """The boundary before is tested where the phrase has been found."""
    return lowered.contains(wanted) & lowered.rlike(rf"\Q{wanted}\E(?<!{WORD}\Q{wanted}\E)(?!{WORD})")


def routing_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[_\-]+", " ")


def routing_term(term: str) -> str:
    return re.sub(r"[_\-]+", " ", term.lower())


def key_claim(text: Column, limit: int = 200) -> Column:
    """First sentence when it ends early enough, else a truncation with an ellipsis."""
    claim = F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, limit), F.lit(BLANKS)), F.lit("..."))
    )
    for stop in ("? ", "! ", ".\n", ". "):
        at = F.instr(text, stop)
        claim = F.when((at > 1) & (at <= limit), F.substring(text, F.lit(1), at)).otherwise(claim)
    return claim


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def normalize_name(name: Column) -> Column:
    """Case, punctuation and spacing removed."""
    folded = F.regexp_replace(F.lower(name), "ß", "ss")
    spaced = F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(spaced, r"\s+", " "))


def strip_roles(name: Column, roles: list[str]) -> Column:
    """Name without role words; unchanged when nothing else is left."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~F.btrim(w, F.lit(".,()")).isin(roles))
    return F.when(F.size(kept) == 0, name).otherwise(F.array_join(kept, " "))


def coerce_confidence(value: Column) -> Column:
    """Number or category text to a category; null when a number is out of range."""
    number = value.cast("string").try_cast("double")
    return (
        F.when(number.isNotNull() & ~number.between(0.0, 1.0), F.lit(None).cast("string"))
        .when(number >= 0.8, "high")
        .when(number >= 0.5, "medium")
        .when(number.isNotNull(), "speculative")
        .when(value.cast("string").isin("high", "medium", "speculative"), value.cast("string"))
        .otherwise("medium")
    )


def rank_of(value: Column, ranks: dict) -> Column:
    """Map a category to its rank; unknown categories rank 0."""
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out
