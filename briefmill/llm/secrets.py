"""Secret scans (operator 5): assignment-aware lexing on top of three base patterns.

The lexer reads source and configuration syntax (``name = literal``, ``"name": literal``, ``name := a + b``,
``name => 'literal'``, ``name: T = literal``, ``name T = literal``, ``T name = literal``, ``x["name"] = literal``; a
literal may stand in parentheses or on the next line) into pairs of a target name and its literals.  A name assigned earlier stands for its
literals wherever it is assigned on, so ``x = "..."; password = x`` counts ``x``'s literal as a password.
A literal is scored by how sensitive the target's name is and by how random the literal looks; those at
``least`` or above that no base span covers are added as spans of kind ``name``.

A base span is the whole match.  Nulls count as empty texts; rows are independent, so repeated rows give repeated
results and an empty table gives an empty one."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import byte_texts, code_point_offsets, digest, map_arrow

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a run of 24 or more is what the open pattern leaves at that length
KINDS = ["assign", "access", "hex", "name"]

SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 1.0, "credentials": 1.0, "bearer": 1.0, "pass": 0.75, "auth": 0.5, "private": 0.5, "access": 0.5,
    "key": 0.5, "signing": 0.5, "encryption": 0.5, "session": 0.25, "api": 0.25, "client": 0.25,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "dummy", "${", "<")
LEAST = 1.5
SENSITIVE_NAME, LEAST_LITERAL = 0.75, 0.3  # so sensitive a name needs only this of its literal, if that has no space

_STRING = r'"(?:[^"\\\n]|\\.)*+"|' + r"'(?:[^'\\\n]|\\.)*+'"
_TERM = rf"(?:{_STRING}|[A-Za-z0-9_+/.@$%&!#=-]++)"
_WORD = r"[A-Za-z_][A-Za-z0-9_.-]*+"
_T = r"[&*?]{0,2}[A-Za-z_\\][A-Za-z0-9_.\\]*+(?:[<\[][^=\n\"'<]{0,60}[>\]])?[?!*&]?"
_TYPE = rf"{_T}(?:[\x20\t]*+\|[\x20\t]*+{_T}){{0,4}}"
# A literal may stand in parentheses or on the next line, unless it is the key of another pair.
_GAP = rf"""(?:[\x20\t(]*+(?:\\?\r?\n[\x20\t(]*+)?(?=(?:{_STRING})(?![\x20\t]*+[:=]))|[\x20\t]*+\([\x20\t(]*+(?={_WORD}[\x20\t]*+\))|[\x20\t]*+)"""
# Name, or type and name in either order, or a subscript; operator; terms.
_PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.-])["']?({_WORD})["']?(?:[\x20\t]*+\])?(?:[\x20\t]*+:[\x20\t]*+{_TYPE}(?=[\x20\t]*+=(?![=>]))|[\x20\t]++[$&*]?({_TYPE})(?=[\x20\t]*+=(?![=>])))?"""
    rf"""[\x20\t]*+(?:=>|:=|=(?![=>])|:(?![:/=])){_GAP}({_TERM}(?:[\x20\t]*\+[\x20\t]*{_TERM})*)"""
)
_TERMS = re.compile(_TERM)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes."""
    out = []
    lower = text.lower()
    if any(word in lower for word in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    """Sum of the weights of a name's parts, at most 1."""
    return min(1.0, sum(SENSITIVE.get(part.lower(), 0.0) for part in _PARTS.findall(name)))


def literal_score(value: str) -> float:
    """From -1 for placeholders to 1 for long values of high entropy."""
    lower = value.lower()
    if len(value) < 6 or any(p in lower for p in PLACEHOLDERS):
        return -1.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return min(0.5, entropy / 7) + (0.25 if mixed else 0.0) + (0.25 if len(value) >= 16 else 0.0)


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Each target name with the spans of the literals it is assigned, references resolved."""
    known: dict[str, list[tuple[int, int]]] = {}
    out = []
    for pair in _PAIR.finditer(text):
        spans: list[tuple[int, int]] = []
        for term in _TERMS.finditer(text, *pair.span(3)):
            value = term[0]
            if value[0] in "\"'":
                spans.append((term.start() + 1, term.end() - 1))
            elif value in known:
                spans.extend(known[value])
            elif any(c.isdigit() for c in value):  # an unquoted configuration value
                spans.append(term.span())
        spans = list(dict.fromkeys(spans))
        names = [n for n in (pair[1], pair[2]) if n]
        known.update(dict.fromkeys(names, spans))
        if spans:
            out.append((max(reversed(names), key=name_score), spans))
    return out


def scan(text: bytes | None, least: float = LEAST) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of all spans, base spans first at equal starts."""
    text = text or b""
    base = base_spans(text)
    if base:
        places = sorted({p for start, _, end in base for p in (start, end)})
        at = dict(zip(places, code_point_offsets(text, places)))
        base = [(at[start], kind, at[end]) for start, kind, end in base]
    if b"=" not in text and b":" not in text:
        return base
    added = set()
    decoded = text.decode("utf-8", "replace")
    for name, spans in assignments(decoded):
        score = name_score(name)
        literal = "".join(decoded[a:b] for a, b in spans)
        need = min(least, score + LEAST_LITERAL) if score >= SENSITIVE_NAME and not any(c.isspace() for c in literal) else least
        if score and score + literal_score(literal) >= need:
            added |= {(a, 3, b) for a, b in spans if b > a}
    return sorted(base + [x for x in added if not any(s <= x[0] and x[2] <= e for s, _, e in base)])


def secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end) by start and kind as listed."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(text, least)] for text in byte_texts(batch.column("text"))]
            return pa.record_batch([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(rows, start, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] != "name")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        digest(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
