"""Language ID (operator 2) by Bayesian fusion of four kinds of evidence.

log P(language | document) is, up to a constant,

- the text's likelihood: byte trigrams under each language's counts, scaled because trigrams overlap;
- the declared markup language: how often that declaration goes with texts of each language;
- the address: a prior of the host, smoothed towards the prior of the address suffix, which is smoothed towards
  the prior of the whole corpus, all from grouped counts.

All counts cover every document.  Languages are the declared codes with at least ``least_documents`` documents with
letters; each takes 128 KB of the model.  One more class, ``und``, stands for text of none of them.  A document is rejected
if it has no letters, or if ``und`` wins, or if the winner is not surer than ``least``.  Where nothing is declared, no language
can be learnt: all are ``und``, and those with letters are kept.

Null or empty texts have no letters.  Null, empty or rare declarations and null hosts are no evidence.  Rows are
independent but for the counts, in which repeated rows count as they stand; an empty table gives an empty
one.  Extra columns are ignored by ``identify`` and kept by ``keep_identified``, whatever their names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import written

BUCKETS = 1 << 14  # of hashed trigrams
SCALE = 1 / 3
LEAST_DOCUMENTS = 3  # declared documents with letters from which a language is learnt
LEAST = 0.5
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 100.0  # documents that the level above is worth
UNKNOWN_PRIOR = 1e-3
UNKNOWN = "und"

# A-Z become a-z, other ASCII characters than letters a space; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def declared_code(value: Column) -> Column:
    """The primary subtag of a declared language in lower case, else null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2,8})(?:[-_].*)?$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The ``lang`` of the ``html`` element."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host of several labels, else null."""
    return F.nullif(F.regexp_extract(F.lower(host), r"\.([^.:]+)(?::\d+)?$", 1), F.lit(""))


def trigram_codes(text: bytes | None) -> np.ndarray:
    """Hashed trigrams over words, runs of other characters counting as one space."""
    words = (text or b"").translate(_TABLE).split()
    if not words:
        return np.zeros(0, np.int32)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)


class Profiles:
    """Log-probabilities of trigrams for each language and, last, for ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = counts + 0.5
        known = np.log(smooth / smooth.sum(1, keepdims=True)) if len(languages) else np.zeros((0, BUCKETS))
        self.table = np.concatenate([known, np.full((1, BUCKETS), -math.log(BUCKETS))]).T.copy()

    def likelihoods(self, text: bytes | None) -> np.ndarray | None:
        codes = trigram_codes(text)
        return SCALE * (np.bincount(codes, minlength=BUCKETS) @ self.table) if len(codes) else None


def _evidence(docs: DataFrame, text: Column, declared: Column, host: Column) -> DataFrame:
    return docs.select(text.alias("_lid_text"), declared_code(declared).alias("_lid_declared"), host.alias("_lid_host"))


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[A-Za-z]|[^\x00-\x7F]"), F.lit(False))


def learn(evidence: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> Profiles:
    """Profiles of the declared languages over all documents; counts are merged in Spark."""
    counts = evidence.filter(has_letters(F.col("_lid_text"))).groupBy("_lid_declared").count().filter("_lid_declared is not null")
    languages = sorted(r[0] for r in counts.filter(F.col("count") >= least_documents).select("_lid_declared").collect())
    if not languages:
        return Profiles([], np.zeros((0, BUCKETS)))
    number = {code: k for k, code in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(number), BUCKETS), np.int64)
        for batch in batches:
            for code, text in zip(batch.column("_lid_declared").to_pylist(), batch.column("_lid_text").cast(pa.binary()).to_pylist()):
                codes = trigram_codes(text)
                if len(codes):
                    counts[number[code]] += np.bincount(codes, minlength=BUCKETS)
        language, bucket = np.nonzero(counts)
        yield pa.record_batch([pa.array(language, pa.int64()), pa.array(bucket, pa.int64()), pa.array(counts[language, bucket], pa.int64())], ["language", "bucket", "n"])

    rows = evidence.filter(F.col("_lid_declared").isin(languages)).select("_lid_declared", "_lid_text")
    merged = rows.mapInArrow(run, "language bigint, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    got = merged.toArrow()  # at most languages x BUCKETS rows
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.asarray(got["language"], np.int64), np.asarray(got["bucket"], np.int64)] = np.asarray(got["n"], np.int64)
    return Profiles(languages, counts)


def _text_language(profiles: Profiles, spark):
    """The language of most likelihood; null without letters."""
    shipped = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("string")
    def likeliest(texts: pa.Array) -> pa.Array:
        found = (shipped.value.likelihoods(t) for t in texts.cast(pa.binary()).to_pylist())
        return pa.array([None if x is None else shipped.value.languages[int(x.argmax())] for x in found], pa.string())

    return likeliest


class Evidence:
    """What the grouped counts of (host, declared, language of the text) say."""

    def __init__(self, counted: DataFrame, languages: list[str]):
        self.languages = languages
        known = languages[:-1]
        overall = {r[0]: r[1] for r in counted.groupBy("text_language").agg(F.sum("n")).collect()}
        self.prior = [(overall.get(c, 0) + 1) / (sum(overall.get(x, 0) for x in known) + len(known)) * (1 - UNKNOWN_PRIOR) for c in known]
        # P(declared | language), each pair counted once more; ``und`` declares anything alike
        pairs = {(r[0], r[1]): r[2] for r in counted.filter(F.col("declared").isin(known)).groupBy("declared", "text_language").agg(F.sum("n")).collect()}
        self.declared = {
            d: np.array([math.log((pairs.get((d, c), 0) + 1) / (sum(pairs.get((x, c), 0) for x in known) + len(known))) for c in known] + [-math.log(len(known))])
            for d in known
        }
        counts = [F.sum(F.when(F.col("text_language") == c, F.col("n")).otherwise(0)).cast("double") for c in known]
        with_suffix = counted.withColumn("suffix", suffix_of(F.col("host")))
        suffixes = with_suffix.filter("suffix is not null").groupBy("suffix").agg(F.array(*counts).alias("s"))
        hosts = with_suffix.filter("host is not null").groupBy("host", "suffix").agg(F.array(*counts).alias("h"))
        smooth = lambda own, above, weight: F.transform(
            F.arrays_zip(own.alias("n"), above.alias("p")),
            lambda x: (x["n"] + F.lit(weight) * x["p"]) / (F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + F.lit(weight)))
        corpus = F.array(*map(F.lit, self.prior))
        placed = suffixes.withColumn("s", smooth(F.col("s"), corpus, SUFFIX_WEIGHT))
        smoothed = hosts.join(placed, "suffix", "left").select(
            "host", smooth(F.col("h"), F.coalesce("s", corpus), HOST_WEIGHT).alias("p"))
        self.hosts = written(smoothed.select(F.col("host").alias("_lid_host"), F.transform("p", lambda x: F.log(x)).alias("_lid_prior")), "hosts")

    def fused(self, profiles: Profiles, spark):
        """Language, confidence and the text's own language from text, declaration and host prior."""
        shipped = spark.sparkContext.broadcast((profiles, self.declared, [math.log(p) for p in self.prior]))

        @F.arrow_udf("struct<language:string,confidence:double,text_language:string>")
        def judge(texts: pa.Array, declared: pa.Array, priors: pa.Array) -> pa.Array:
            model, says, corpus = shipped.value
            out = []
            for text, said, prior in zip(texts.cast(pa.binary()).to_pylist(), declared.to_pylist(), priors.to_pylist()):
                like = model.likelihoods(text)
                if like is None:
                    out.append(None)
                    continue
                scores = like + np.array([*(prior or corpus), math.log(UNKNOWN_PRIOR)]) + says.get(said, 0.0)
                best = int(scores.argmax())
                out.append({
                    "language": model.languages[best], "confidence": float(1 / np.exp(scores - scores[best]).sum()),
                    "text_language": model.languages[int(like.argmax())]})
            kind = pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("text_language", pa.string())])
            return pa.array(out, kind)

        return judge


def scored(docs: DataFrame, text: Column, declared: Column, host: Column) -> DataFrame:
    """``docs`` with _lid: language, confidence and text_language, null where there are no letters, and _lid_none, whether
    nothing is declared from which to learn."""
    spark = docs.sparkSession
    evidence = _evidence(docs, text, declared, host)
    profiles = learn(evidence)
    if len(profiles.languages) == 1:  # nothing is declared
        return docs.withColumns({
            "_lid": F.lit(None).cast("struct<language:string,confidence:double,text_language:string>"), "_lid_none": F.lit(True)})
    likeliest = _text_language(profiles, spark)
    counted = written(
        evidence.select(F.col("_lid_host").alias("host"), F.col("_lid_declared").alias("declared"), likeliest("_lid_text").alias("text_language"))
        .groupBy("host", "declared", "text_language").agg(F.count("*").alias("n")).filter("text_language is not null"), "language-counts")
    known = Evidence(counted, profiles.languages)
    placed = docs.withColumn("_lid_host", host).join(known.hosts, "_lid_host", "left")
    judge = known.fused(profiles, spark)
    return placed.withColumns({
        "_lid": judge(text, declared_code(declared), F.col("_lid_prior")), "_lid_none": F.lit(False)}).drop("_lid_host", "_lid_prior")


def _accepted(text: str) -> Column:
    """Whether the language is known; where none could be learnt, whether there are letters that a language might have."""
    known = (F.col("_lid.language") != UNKNOWN) & (F.col("_lid.confidence") >= LEAST)
    return F.when(F.col("_lid_none"), has_letters(F.col(text))).otherwise(F.coalesce(known, F.lit(False)))


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """Per row: doc_id, language, confidence (6 decimals), text_language, kept."""
    rows = docs.select("doc_id", F.col(text).alias("_lid_body"), F.col(declared).alias("_lid_said"), F.col(host).alias("_lid_from"))
    found = scored(rows, F.col("_lid_body"), F.col("_lid_said"), F.col("_lid_from"))
    return found.select(
        "doc_id", F.coalesce("_lid.language", F.lit(UNKNOWN)).alias("language"), F.coalesce(F.round("_lid.confidence", 6), F.lit(0.0)).alias("confidence"),
        F.coalesce("_lid.text_language", F.lit(UNKNOWN)).alias("text_language"), _accepted("_lid_body").alias("kept"))


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows whose language is known, with their columns as they were."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("_lid_body"), F.col(declared).alias("_lid_said"), F.col(host).alias("_lid_from"))
    found = scored(packed, F.col("_lid_body"), F.col("_lid_said"), F.col("_lid_from"))
    return found.filter(_accepted("_lid_body")).select("row.*")
