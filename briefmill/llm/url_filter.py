"""URL filters (operator 8): rules by host and path, and a Bloom filter cascade for a listed set of hosts.

Level 1 of the cascade holds the listed keys; level 2 the keys of the universe that pass level 1 without
being listed; level 3 the listed keys that pass level 2, and so on until a level lets nothing false
through.  The first level that rejects a key decides: an even one says listed, an odd one not listed.  As
the universe is every key of the corpus, membership is exact for the corpus and needs no join.

Levels are built from counts and bit positions set in the tasks and merged by word with ``bit_or``.  A
cascade takes about 10 bits a listed key for level 1 and less for the others; keys are dealt by hash
into as many shards as keep a shard below ``most_bytes``, the shards' cascades are applied one after the
other, and every shard sees every row, so the bound changes no result.

Null urls and urls without ``://`` have empty host and path.  Rows are independent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import table, written

# Fixed values: (verdict, host, path) of the rules, and the words that mark a listed host.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_WORDS = ["ads", "bets", "casino", "cheap", "farm", "free", "pills", "spam", "track", "win"]

BITS = 10  # a key of a level
HASHES = 5
MOST_BYTES = 16_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls; equally long rules: the first in order."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key: double hashing with a seed for each level."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + half)), F.lit(bits)) for half in (0, 1))
    return [F.pmod(a + F.lit(k) * b, F.lit(bits)).cast("bigint") for k in range(HASHES)]


def _filter(keys: DataFrame, level: int, count: int) -> tuple[int, np.ndarray]:
    """Words of 64 bits of a Bloom filter over ``keys``; a word meets its bits in a partial aggregate."""
    bits = max(64, -(-count * BITS // 64) * 64)
    rows = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    words = rows.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # at most bits / 64 rows, which most_bytes bounds
    out[np.asarray(got["w"], np.int64)] = np.asarray(got["bits"], np.int64)
    return bits, out


def _passes(key: Column, level: int, bits: int, shipped) -> Column:
    @F.arrow_udf("boolean")
    def inside(*positions: pa.Array) -> pa.Array:
        words = shipped.value
        ok = np.ones(len(positions[0]), bool)
        for p in positions:
            at = np.asarray(p, np.int64)
            ok &= (words[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(ok)

    return inside(*_positions(key, level, bits))


def cascades(universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[list[tuple[int, object]]]:
    """One cascade a shard, each a list of (bits, broadcast words).  ``universe``: distinct (key, listed)."""
    sc = universe.sparkSession.sparkContext
    universe = written(universe, "universe")
    listed = universe.filter("listed").count()
    shards = max(1, -(-listed * BITS * 2 // (8 * most_bytes)))
    out = []
    for shard in range(shards):
        own = universe.filter(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)) == shard)
        levels: list[tuple[int, object]] = []
        inside, outside = own.filter("listed").select("key"), own.filter("not listed").select("key")
        count = inside.count()
        while count:
            level = len(levels)
            bits, words = _filter(inside, level, count)
            levels.append((bits, sc.broadcast(words)))
            false = written(outside.filter(_passes(F.col("key"), level, bits, levels[-1][1])), "passed")
            inside, outside = false, inside
            count = inside.count()
        out.append(levels)
    return out


def listed(key: Column, built: list[list[tuple[int, object]]]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(False)
    for shard, levels in enumerate(built):
        answer = F.lit(len(levels) % 2 == 1)
        for level in reversed(range(len(levels))):
            bits, words = levels[level]
            answer = F.when(_passes(key, level, bits, words), answer).otherwise(F.lit(level % 2 == 1))
        mine = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(built))) == shard
        out = F.when(mine, answer).otherwise(out)
    return out


def listed_hosts(hosts: DataFrame, words: list[str] = LISTED_WORDS) -> DataFrame:
    """Distinct hosts with ``listed``: a label of the host has one of the words between hyphens."""
    parts = F.split("key", r"[.-]")
    return hosts.distinct().withColumn("listed", F.arrays_overlap(parts, F.array(*map(F.lit, words))))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, words: list[str] = LISTED_WORDS) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.  Without a fitting rule, listed hosts are blocked."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    built = cascades(listed_hosts(rows.select(F.col("host").alias("key")), words))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(listed(F.col("host"), built), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumns({"rule": rule, "_rule": verdict, "_method": method}).select(
        "page_id", "host", "path", "rule", F.coalesce("_rule", "_method").alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
with r as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from r),
v as (
  select *, case
      when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from p)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block'
    when rule in ('example.net/en/', 'org/fr/') then 'allow'
    when regexp_matches(host, '(^|[.-])(ads|bets|casino|cheap|farm|free|pills|spam|track|win)($|[.-])') then 'block'
    else 'allow' end as verdict
from v
"""
