"""Benchmark decontamination (operator 1): one Aho-Corasick automaton over normalised benchmark windows.

Normalising lower-cases A-Z and reduces every run of other ASCII characters than letters and digits to one
space.  A window is ``width`` consecutive words of an item, or all its words if it has fewer.  Each text is
normalised and scanned once; matches are mapped to words, and for texts with matches to code points of the
original text.

The automaton is built in the tasks from a broadcast list of windows.  The list is measured first: beyond
``most_bytes`` it is dealt into blocks by hash, each with an automaton of its own, and the documents pass
through one after the other; every block sees every document, so results do not depend on the bound.

Null and empty texts have no words.  Windows of an item with a null id hit as others do, but the item is not listed or
counted.  Items with equal ids count as one item; rows of
documents are independent, so repeated rows give repeated results and empty tables an empty result or one
without hits."""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import byte_texts, code_point_offsets, digest, map_arrow, written

WIDTH = 10
MOST_BYTES = 8_000_000  # an automaton takes about 30 times the bytes of its windows in each Python worker

# Everything that parts words becomes a space, A-Z becomes a-z; bytes of other characters stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MATCH = "struct<first:int,last:int,item:string>"


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (item, window) rows; a window is its words joined by spaces."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = [], []
            for item, text in zip(batch.column("item").to_pylist(), byte_texts(batch.column("text"))):
                words = normal_words(text)
                if words:
                    for window in {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}:
                        ids.append(item)
                        out.append(window)
            return pa.record_batch([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item", "window"])

        return step

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return map_arrow(rows, start, "item string, window binary").distinct()


def _automaton(pairs: list[tuple[bytes, str]]) -> ahocorasick.Automaton:
    """Bytes stand as Latin-1 characters, so positions are byte positions."""
    items = defaultdict(list)
    for window, item in pairs:
        items[window].append(item)
    automaton = ahocorasick.Automaton()
    for window, own in items.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" "), own))
    if items:
        automaton.make_automaton()
    return automaton


def _scan(automaton: ahocorasick.Automaton, text: bytes | None) -> tuple[int, list[dict]]:
    words = normal_words(text)
    if not words or not len(automaton):
        return len(words), []
    normal, found = f" {b' '.join(words).decode('latin-1')} ", []
    seen, at = 0, 0
    for end, (gaps, items) in automaton.iter(normal):
        seen += normal.count(" ", at, end)  # spaces before the match's last one: the number of the word before it, plus one
        at = end
        found.extend({"first": seen - 1 - gaps, "last": seen - 1, "item": item} for item in items)
    return len(words), found


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with n_words and matches: word numbers of each occurring window and its item."""
    known = written(windows(items, width), "windows")
    size = known.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 32)).first()[0] or 0
    blocks = max(1, -(-size // most_bytes))
    out = docs.withColumns({"n_words": F.lit(0).cast("int"), "matches": F.lit(None).cast(f"array<{_MATCH}>")})
    for block in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()  # measured above
        out = _pass(out, docs.sparkSession.sparkContext.broadcast([(bytes(r.window), r.item) for r in own]))
        if block < blocks - 1:
            out = written(out, "matches")
    return out


def _pass(docs: DataFrame, shipped) -> DataFrame:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
    state: dict = {}

    @F.arrow_udf(f"struct<n:int,found:array<{_MATCH}>>")
    def scan(texts: pa.Array) -> pa.Array:
        if not state:
            state["automaton"] = _automaton(shipped.value)
        results = [_scan(state["automaton"], text) for text in byte_texts(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([n for n, _ in results], pa.int32()), pa.array([found for _, found in results], kind)], ["n", "found"])

    scanned = docs.withColumn("_scan", scan(F.col("text")))
    return scanned.withColumns({
        "n_words": F.col("_scan.n"),
        "matches": F.concat(F.coalesce("matches", F.array().cast(f"array<{_MATCH}>")), F.col("_scan.found")),
    }).drop("_scan")


def _runs(found: list[dict]) -> list[tuple[int, int]]:
    """First and last word of each run of hit words."""
    runs: list[list[int]] = []
    for first, last in sorted({(m["first"], m["last"]) for m in found}):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [tuple(r) for r in runs]


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that runs of words cover."""
    places = [m.span() for m in _WORD.finditer(text)]
    flat = [x for first, last in runs for x in (places[first][0], places[last][1])]
    points = code_point_offsets(text, flat)
    return list(zip(points[::2], points[1::2]))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All columns of ``docs`` (those named like a result are replaced) with n_words, n_hit, items (sorted ids)
    and spans (code points of the original text covered by hit words)."""

    @F.arrow_udf("struct<n_hit:long,spans:array<struct<start:int,end:int>>>")
    def located(texts: pa.Array, found: pa.Array) -> pa.Array:
        hits, spans = [], []
        for text, own in zip(byte_texts(texts), found.to_pylist()):
            runs = _runs(own or [])
            hits.append(sum(last - first + 1 for first, last in runs))
            spans.append([{"start": a, "end": b} for a, b in _spans(text, runs)] if runs else [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(hits, pa.int64()), pa.array(spans, kind)], ["n_hit", "spans"])

    hit = matches(docs, items, width, most_bytes)
    only_hit = F.when(F.size("matches") > 0, F.col("text"))  # other texts need not travel again
    return (
        hit.withColumn("_at", located(only_hit, F.col("matches")))
        .withColumns({
            "n_words": F.col("n_words").cast("bigint"), "n_hit": F.col("_at.n_hit"), "spans": F.col("_at.spans"),
            "items": F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item"])))),
        })
        .drop("_at", "matches")
    )


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any window of a benchmark item, all columns as they were.

    A text without matches has no hit word; where the words stand is not asked, so one Python worker a task is enough."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return matches(packed, items).filter(F.size("matches") == 0).select("row.*")


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words, row_number() over () as row_no
  from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
g as (
  select distinct item, least(len(words), 10) as width,
    array_to_string(words[k : k + least(len(words), 10) - 1], ' ') as gram
  from b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as t(k) where len(words) > 0),
d as (
  select row_no, k, width, array_to_string(words[k : k + width - 1], ' ') as gram
  from w, (select distinct width from g) as widths, unnest(range(1, len(words) - width + 2)) as t(k)),
m as (select row_no, k, d.width, item from d join g on d.gram = g.gram and d.width = g.width),
h as (select row_no, count(distinct p) as n_hit from m, unnest(range(k, k + width)) as t(p) group by row_no),
i as (
  select row_no, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct row_no, item from m where item is not null) group by row_no)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from w left join h using (row_no) left join i using (row_no)
"""
