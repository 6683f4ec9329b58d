"""Line dedup (operator 4) by a log-template tree.

The tree has a fixed depth: a line goes to a leaf by its number of tokens and its leading tokens (those with a
digit count as variable).  Inside a leaf every distinct line of every document votes, position by position: a
token with at least ``least_documents`` votes stays, any other is a variable field.  A line's template is
what stays of it; it needs a share of ``least_constant`` constant tokens.  Templates found in at least
``least_documents`` documents recur, and their lines are dropped from every text: one made wholly of them is emptied.

Copies count as one document: those of one text, and near copies, which are told by what they share as a whole.
Texts that share their longest repeated line (the same bytes in ``least_documents`` texts) and of which repeated
lines hold more than ``copy_share`` of the bytes are one group of copies.  Lines found in nothing but the group do
not recur, so near-duplicate removal can choose one of its texts.  A short text around boilerplate has more of its
own, and a log's lines differ in their fields, so these count each by itself.

A long line (``long_points`` code points) recurs as it is, without a template, from ``long_documents`` documents.
Each character of a script without spaces is a token, so its lines have templates too.  Lines of fewer than
``least_tokens`` tokens never recur; ``cleaned`` and the pipeline ask for one token and ``least_points`` code points.

Four passes, none of which gathers a leaf or a template in one task:

1. Count leaves and long lines with partial counts in each task; leaves of too few lines cannot hold a template.
2. Lines of the remaining leaves and long lines found often enough go on.  A Bloom filter of fixed size drops most others where they are read,
   a join drops the rest.
3. Repeated lines and the groups of copies are grouped sums over lines and texts; votes and templates are grouped
   sums over (leaf, position, token) and template.
4. The positions of dropped lines are joined to the documents by a 128-bit hash of the text.

Null texts stay null and empty ones empty; lines are parted by \\n alone and kept lines stay as they are.  Repeated
rows are treated alike.  An empty table gives an empty one.  All columns are kept; ``n_chars``, if there is
one, becomes the length of the new text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from briefmill.llm.common import byte_texts, key_filter, map_arrow, may_be_in, written

DEPTH = 2
LEAST_DOCUMENTS = 10
LEAST_CONSTANT = 0.7
LEAST_TOKENS = 3
COPY_SHARE = 8 / 9  # texts with this share in common have a similarity of 0.8
LONG_POINTS = 40
LONG_DOCUMENTS = 3
SHORT = {"least_tokens": 1, "least_points": 4}  # what the query and the pipeline ask for
FILTER_BYTES = 4 << 20
VARIABLE = b"<*>"

_DIGITS = frozenset(b"0123456789")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_MAY_BE_UNSPACED = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")
_TOKENS = re.compile(rf"[{_UNSPACED}]|[^ \t\r\n\v\f{_UNSPACED}]+")


def masked(token: bytes) -> bytes:
    return VARIABLE if not _DIGITS.isdisjoint(token) else token


def leaf_of(tokens: list[bytes], depth: int = DEPTH) -> int:
    """Hash of the path from the root to the leaf."""
    return xxhash.xxh64_intdigest(b"\0".join([str(len(tokens)).encode(), *map(masked, tokens[:depth])])) - (1 << 63)


def tokens_of(line: bytes) -> list[bytes]:
    """Tokens between spaces, and single characters of scripts without spaces."""
    if _MAY_BE_UNSPACED.search(line):
        return [t.encode() for t in _TOKENS.findall(line.decode("utf-8", "replace"))]
    return line.split()


def _points(tokens: list[bytes]) -> int:
    return sum(len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in tokens)


def raw_of(tokens: list[bytes]) -> int:
    """Hash of a line as it is, apart from its spaces."""
    return xxhash.xxh64_intdigest(b" ".join(tokens), 1) - (1 << 63)


def _lines(text: bytes | None, least_tokens: int, least_points: int = 1):
    """(position, tokens, code points) of the lines that may recur."""
    for position, line in enumerate((text or b"").split(b"\n")):
        tokens = tokens_of(line)
        if len(tokens) >= least_tokens:
            points = _points(tokens)
            if points >= least_points:
                yield position, tokens, points


def _leaves(
    docs: DataFrame, depth: int, least_documents: int, least_tokens: int, least_points: int = 1, long_points: int = LONG_POINTS, long_documents: int = LONG_DOCUMENTS,
) -> DataFrame:
    """(leaf, long): leaves with lines in at least as many rows as a template needs documents, and hashes of long lines
    in at least as many rows as those need."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                own = set()
                for _, tokens, points in _lines(text, least_tokens, least_points):
                    own.add((leaf_of(tokens, depth), False))
                    if points >= long_points:
                        own.add((raw_of(tokens), True))
                counts.update(own)
            if len(counts) > 300_000:  # sums are completed by the shuffle
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    def _counted(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([k for k, _ in counts], pa.int64()), pa.array([x for _, x in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], ["leaf", "long", "n"])

    rows = docs.select("text").mapInArrow(run, "leaf bigint, long boolean, n bigint")
    often = F.col("n") >= F.when(F.col("long"), long_documents).otherwise(least_documents)
    return written(rows.groupBy("leaf", "long").agg(F.sum("n").alias("n")).filter(often).select("leaf", "long"), "leaves")


def _leaf_filter(leaves: DataFrame, size: int) -> np.ndarray:
    """One-hash Bloom filter of ``size`` bytes over leaves and long lines, merged by word from partial ``bit_or``."""
    bits = size * 8
    words = leaves.groupBy((F.pmod("leaf", F.lit(bits)) / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(leaf, {bits}) % 64 as int))")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # at most size / 8 rows
    out[np.asarray(got["w"], np.int64)] = np.asarray(got["b"], np.int64)
    return out


def _candidates(
    docs: DataFrame, leaves: DataFrame, depth: int, least_tokens: int, filter_bytes: int, least_points: int = 1, long_points: int = LONG_POINTS,
) -> DataFrame:
    """(doc, position, leaf, tokens, raw, size, total, line) of lines in the leaves and of long lines found often: ``doc``
    is a hash of the text, ``raw`` one of the line as it is; ``size`` and ``total`` are the bytes in tokens of line and
    text.  Long lines stand once more, without leaf and tokens."""
    bits = filter_bytes * 8
    shipped = docs.sparkSession.sparkContext.broadcast(_leaf_filter(leaves, filter_bytes))

    def start():
        words = shipped.value

        def listed(key: int) -> bool:
            at = key % bits
            return bool((int(words[at >> 6]) >> (at & 63)) & 1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in range(8)]
            for text in byte_texts(batch.column("text")):
                key = total = None
                for position, tokens, points in _lines(text, least_tokens, least_points):
                    leaf, raw = leaf_of(tokens, depth), raw_of(tokens)
                    for own, long in ((leaf, False), (raw, True)):
                        if long and points < long_points or not listed(own):
                            continue
                        if key is None:
                            key, total = xxhash.xxh3_128_digest(text), sum(map(len, text.split()))
                        values = (key, position, own, long, None if long else [masked(t) for t in tokens], raw, sum(map(len, tokens)), total)
                        for column, value in zip(out, values):
                            column.append(value)
            types = [pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(column, kind) for column, kind in zip(out, types)]
            columns[4] = columns[4].cast(pa.list_(pa.string()))
            return pa.record_batch(columns, ["doc", "position", "leaf", "long", "tokens", "raw", "size", "total"])

        return step

    schema = "doc binary, position int, leaf bigint, long boolean, tokens array<string>, raw bigint, size bigint, total bigint"
    lines = map_arrow(docs.select("text"), start, schema)
    lines = lines.withColumn("line", F.when(~F.col("long"), F.xxhash64("tokens", F.size("tokens"))))
    return written(lines.join(leaves, ["leaf", "long"], "left_semi"), "lines")


def _copies(lines: DataFrame, least_documents: int, long_documents: int, copy_share: float) -> DataFrame:
    """(doc, anchor) of the near copies; those of one group have one anchor, their longest repeated line."""
    found = lines.groupBy("doc", "raw").agg(F.max("long").alias("long")).groupBy("raw").agg(F.count("*").alias("n"), F.max("long").alias("long"))
    repeated = written(found.filter(F.col("n") >= F.when(F.col("long"), F.least(F.lit(long_documents), F.lit(least_documents))).otherwise(least_documents)).select("raw"), "repeated")
    places = lines.join(repeated, "raw", "left_semi").groupBy("doc", "position").agg(*(F.first(c).alias(c) for c in ("raw", "size", "total")))
    return written(
        places.groupBy("doc")
        .agg(F.sum("size").alias("shared"), F.max(F.struct("size", "raw")).alias("longest"), F.first("total").alias("total"))
        .filter(F.col("shared") > copy_share * F.col("total")).select("doc", F.col("longest.raw").alias("anchor")), "copies")


def recurring(lines: DataFrame, least_documents: int, least_constant: float) -> tuple[DataFrame, DataFrame]:
    """(template, pattern, n_documents) of the templates that recur, and (line, template) of their lines."""
    lines = lines.filter(~F.col("long"))
    in_docs = lines.select("doc", "line").distinct().groupBy("line").agg(F.count("*").alias("n"))
    distinct = written(
        lines.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens")).join(in_docs, "line"), "distinct-lines")
    votes = distinct.select("leaf", "n", F.posexplode("tokens").alias("p", "token"))
    stays = votes.groupBy("leaf", "p", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_documents).withColumn("stays", F.lit(True))
    fields = (
        distinct.select("line", "leaf", F.posexplode("tokens").alias("p", "token"))
        .join(stays.select("leaf", "p", "token", "stays"), ["leaf", "p", "token"], "left")
        .withColumn("field", F.when(F.col("stays") & (F.col("token") != VARIABLE.decode()), F.col("token")).otherwise(VARIABLE.decode()))
    )
    parsed = (
        fields.groupBy("line", "leaf").agg(F.array_sort(F.collect_list(F.struct("p", "field"))).alias("fields"))  # one line's tokens
        .withColumn("pattern", F.transform("fields", lambda f: f["field"]))
        .filter(F.size(F.filter("pattern", lambda t: t != VARIABLE.decode())) >= least_constant * F.size("pattern"))
        .select("line", F.xxhash64("leaf", "pattern").alias("template"), "pattern")
    )
    parsed = written(parsed, "templates")
    found = lines.select("doc", "line").join(parsed.select("line", "template"), "line").select("doc", "template").distinct()
    often = found.groupBy("template").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= least_documents)
    patterns = parsed.groupBy("template").agg(F.first("pattern").alias("pattern"))
    return often.join(patterns, "template").select("template", F.array_join("pattern", " ").alias("pattern"), "n_documents"), (
        parsed.join(often, "template", "left_semi").select("line", "template"))


def _dropped(
    docs: DataFrame, depth: int, least_documents: int, least_constant: float, least_tokens: int, copy_share: float, filter_bytes: int,
    least_points: int, long_points: int, long_documents: int,
) -> DataFrame:
    """(doc, positions) of the lines to drop from each text that loses any."""
    leaves = _leaves(docs, depth, least_documents, least_tokens, least_points, long_points, long_documents)
    lines = _candidates(docs, leaves, depth, least_tokens, filter_bytes, least_points, long_points)
    units = lines.join(_copies(lines, least_documents, long_documents, copy_share), "doc", "left")  # what counts as one document
    units = units.withColumn("doc", F.coalesce(F.col("anchor").cast("string").cast("binary"), "doc"))
    _, bad = recurring(units, least_documents, least_constant)
    long = F.col("long")
    bad_long = units.filter(long).select("raw", "doc").distinct().groupBy("raw").agg(F.count("*").alias("n")).filter(F.col("n") >= long_documents)
    hits = lines.filter(~long).join(bad, "line", "left_semi").select("doc", "position").union(
        lines.filter(long).join(bad_long, "raw", "left_semi").select("doc", "position")).distinct()
    return hits.groupBy("doc").agg(F.collect_list("position").alias("positions"))  # one text's lines


SALTS = 8  # tasks over which the copies of one text are dealt


@F.arrow_udf(BinaryType())
def _text_hash(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else xxhash.xxh3_128_digest(t) for t in byte_texts(texts)], pa.binary())


DEFAULTS = dict(
    depth=DEPTH, least_documents=LEAST_DOCUMENTS, least_constant=LEAST_CONSTANT, least_tokens=LEAST_TOKENS, copy_share=COPY_SHARE,
    filter_bytes=FILTER_BYTES, least_points=1, long_points=LONG_POINTS, long_documents=LONG_DOCUMENTS)


def _cleaned(docs: DataFrame, **settings) -> DataFrame:
    """(row, text, n_dropped): the input's columns kept together, the new text and the number of lines dropped.

    Only texts that lose lines, and a few that a Bloom filter lets through, are shuffled to meet their positions."""
    dropped = written(_dropped(docs, **{**DEFAULTS, **settings}), "dropped")
    shipped = key_filter(dropped.select(F.xxhash64("doc").alias("key")), "key")
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), _text_hash("text").alias("own"))
    may_lose = F.col("text").isNotNull() & may_be_in(F.xxhash64("own"), shipped)
    marked = packed.withColumn("may_lose", may_lose)
    salted = dropped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = marked.filter("may_lose").withColumn("copy", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
    met = rows.join(salted, (F.col("own") == F.col("doc")) & (F.col("copy") == F.col("salt")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains("positions", k)), "\n")
    lost = met.select(
        "row", F.when(F.col("positions").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.array_size("positions").cast("bigint"), F.lit(0).cast("bigint")).alias("n_dropped"))
    return lost.unionByName(marked.filter("not may_lose").select("row", "text", F.lit(0).cast("bigint").alias("n_dropped")))


def drop_recurring_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the lines of recurring templates; ``settings`` replace the ``DEFAULTS``."""
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return _cleaned(docs, **settings).select(*[
        (new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def cleaned(docs: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, text, n_dropped."""
    return _cleaned(docs.select("doc_id", "text"), **settings).select("row.doc_id", "text", "n_dropped")
