"""Inverted index and retrieval: every query is a row, one plan answers all of them.

A query is driven by its rarest term, so a term found in a third of the corpus never
fans out by itself: its postings are only probed by (chunk, term) for chunks that already
hold the rarest one.  Top-k ranks use a literal bound, which lets Spark cut each
partition before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.functions import text as T
from briefmill.session import cut_lineage, scratch_path

K1 = 1.2
B = 0.75
MAX_SIZE = 100
SECTION_CAP = 50
BUCKETS = 64  # directories of stored postings
TASK_CHUNKS = 20_000  # whose postings, about 5 million rows, one task sorts
POINTER_LIMIT = 5
PAYLOAD = ("document_name", "clause_type")


class Index(NamedTuple):
    """The tables retrieval reads; normally stored, here any DataFrames."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build_index(chunks: DataFrame) -> Index:
    return Index(chunks, postings(chunks), term_stats(chunks), corpus_stats(chunks))


def tokens(chunks: DataFrame) -> DataFrame:
    """Index terms with positions."""
    return chunks.select("chunk_id", F.posexplode(T.terms(F.col("text"))).alias("position", "term"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk) with frequency, positions, chunk length and filter columns.

    A chunk is one row, so its postings come out of that row without a shuffle."""
    payload = [c for c in PAYLOAD if c in chunks.columns]
    words = chunks.select("chunk_id", *payload, T.terms(F.col("text")).alias("words"))
    entries = words.select("chunk_id", *payload, F.size("words").alias("length"), F.explode(_entries(F.col("words"))).alias("e"))
    return entries.select(
        "e.term", "chunk_id", bucket_of(F.col("e.term")).alias("bucket"), F.size("e.positions").alias("tf"), "e.positions",
        "length", *payload)


def _entries(words: Column) -> Column:
    """Distinct words with their positions: words sorted with their places, cut where the word changes.

    Lists of one bind the sorted words and the cuts, which a lambda would compute again for every element."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("position"))))

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["term"] != F.get(s, k - 1)["term"]))
        entry = lambda b: F.transform(b, lambda k, j: F.struct(
            F.get(s, k)["term"].alias("term"),
            F.transform(F.slice(s, k + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - k), lambda x: x["position"]).alias("positions")))
        return F.get(F.transform(F.array(starts), entry), 0)

    return F.when(F.size(words) > 0, F.get(F.transform(F.array(placed), cut), 0))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(index: DataFrame, path: str) -> None:
    """Persist the index in directories by hash of the term, sorted by term, so that a lookup opens only the directories of
    its terms and skips row groups inside.  Every task writes the postings of its own chunks: postings are not shuffled, and a
    hot term lies in as many files as there are tasks."""
    index.sortWithinPartitions("bucket", "term", "chunk_id").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def spread(chunks: DataFrame) -> DataFrame:
    """Chunks dealt into tasks small enough for the postings of each to be sorted in memory."""
    cores, n = chunks.sparkSession.sparkContext.defaultParallelism, chunks.count()
    tasks = max(min(cores, n // 1_000 + 1), n // TASK_CHUNKS + 1)
    return chunks.select("chunk_id", "text", *[c for c in PAYLOAD if c in chunks.columns]).repartition(tasks)


def term_stats(chunks: DataFrame) -> DataFrame:
    """Chunk frequency per term."""
    distinct = chunks.select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df"))


def stats_of_postings(index: DataFrame) -> DataFrame:
    """What ``term_stats`` gives, from postings, which hold a row per term and chunk."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in terms."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(F.size(T.terms(F.col("text")))).alias("mean_length"))


def _idf(df: Column, n_chunks: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def _saturation(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean_length))


def _type_allowed() -> Column:
    return (F.coalesce(F.size("q_types"), F.lit(0)) < 1) | F.array_contains("q_types", F.col("clause_type"))


def asks_inside(queries: DataFrame, document: str = "document_name") -> bool:
    """Whether any query has a document filter."""
    return not queries.filter(F.col(document).isNotNull()).isEmpty()


def filtered_join(wanted: DataFrame, rows: DataFrame, key: str | list[str], inside_any: bool = True) -> DataFrame:
    """Join on ``key`` under the exact filters, reading either side once.

    A document filter becomes part of the join key, so a query on one document never meets another document's rows: a row
    is offered under its document and under any; or once, where no query asks inside any document."""
    keys = [key] if isinstance(key, str) else key
    if not inside_any:
        return wanted.drop("q_document").join(rows, keys).filter(_type_allowed()).drop("q_types")
    anywhere, inside = F.lit("*"), lambda name: F.concat(F.lit("="), F.col(name))
    asked = wanted.withColumn("at", F.coalesce(inside("q_document"), anywhere)).drop("q_document")
    offered = rows.withColumn("at", F.explode(F.array(anywhere, inside("document_name"))))
    return asked.join(offered, [*keys, "at"]).filter(_type_allowed()).drop("q_types", "at")


def accepted_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries asking for 1 to MAX_SIZE rows, and the others with the reason of their refusal."""
    ok = F.coalesce(F.col("size").between(1, MAX_SIZE), F.lit(False))
    return queries.filter(ok), queries.filter(~ok).select(
        "query_id", F.concat(F.lit("size must be between 1 and "), F.lit(MAX_SIZE)).alias("error"))


def top_k(scored: DataFrame, limit: Column, order: Sequence[Column] | None = None, key: str = "query_id") -> DataFrame:
    """Best rows per query, at most ``limit``, which ``accepted_queries`` holds at MAX_SIZE or below."""
    order = order or [F.desc("score"), F.asc("chunk_id")]
    best = Window.partitionBy(key).orderBy(*order)
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= MAX_SIZE)
        .filter(F.col("rank") <= limit)
    )


def _filters_of(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id", F.col("document_name").alias("q_document"), F.col("clause_types").alias("q_types"), "size"
    )


def split_rarest(lookups: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rarest term of each lookup, and its other terms.

    ``lookups``: (lookup_id, place, term, weight).  A lookup with a term the index lacks is
    dropped, because all of its terms are required."""
    known = lookups.join(stats, "term", "left")
    row = F.struct("place", "term", "weight", "df")
    rarest = (
        known.groupBy("lookup_id")
        .agg(F.min_by(row, F.struct("df", "place")).alias("r"), F.max(F.col("df").isNull()).alias("missing"),
             F.count("*").alias("n_terms"))
        .filter(~F.col("missing")).select("lookup_id", "r.*", "n_terms")
    )
    others = known.join(rarest.select("lookup_id", F.col("place").alias("first")), "lookup_id").filter(
        F.col("place") != F.col("first")).select("lookup_id", "place", "term", "weight", "df")
    return rarest, others


def with_others(rarest: DataFrame, others: DataFrame) -> DataFrame:
    """Lookups with their other terms as a list, which a query's length bounds, and the bucket of the rarest one."""
    lists = others.groupBy("lookup_id").agg(F.collect_list(F.struct("place", "term", "weight", "df")).alias("others"))
    # a term of the index has a positive df; said so, the buckets prune directories
    return rarest.filter("df > 0").join(lists, "lookup_id", "left").withColumn("bucket", bucket_of(F.col("term")))


def held(index: Index, wanted: DataFrame) -> DataFrame:
    """The postings of the wanted terms only, before anything is shuffled.

    The terms are written first, so that Spark knows their size and sends them to the postings while they are few."""
    spark = wanted.sparkSession
    path = scratch_path(spark, "wanted-terms")
    wanted.select(bucket_of(F.col("term")).alias("place"), "term").distinct().write.parquet(path)
    # no place is negative; said so, the places prune directories
    terms = spark.read.parquet(path).filter("place >= 0").withColumnRenamed("place", "bucket")
    return index.postings.join(terms, ["bucket", "term"], "left_semi")


def probed(index: Index, found: DataFrame, others: DataFrame, column: str, *fields: str) -> DataFrame:
    """One row for each chunk ``found`` and other term of its lookup that the chunk holds, with the postings' ``column`` as
    ``p_...`` and the ``fields`` of the term as ``other``; one row with nulls where the lookup has no other term.  All terms
    are required, so a chunk that lacks one goes before the next shuffle.  The postings are read once, in the buckets of the
    other terms only."""
    asked = found.withColumn("o", F.explode_outer("others")).drop("others").withColumn("p_term", F.col("o.term")).withColumn(
        "other", F.when(F.col("o").isNotNull(), F.struct(*[F.col(f"o.{f}") for f in fields]))).drop("o")
    entries = held(index, others.filter("df > 0")).select(
        F.col("term").alias("p_term"), "chunk_id", F.col(column).alias(f"p_{column}"))
    joined = asked.join(entries, ["p_term", "chunk_id"], "left")
    return joined.filter(F.col("p_term").isNull() | F.col(f"p_{column}").isNotNull())


def bm25_and(index: Index, queries: DataFrame) -> DataFrame:
    """All terms of the query text required; BM25 score; best ``size`` chunks per query.

    Queries with the same terms and filters are scored once and share the ranking."""
    n_chunks = index.corpus.select("n_chunks").scalar()
    mean_length = index.corpus.select("mean_length").scalar()
    words = F.array_sort(T.terms(F.col("text")))
    prepared = queries.select(
        "query_id", "size", words.alias("words"), F.col("document_name").alias("q_document"),
        F.array_sort(F.coalesce("clause_types", F.array().cast("array<string>"))).alias("q_types"),
    ).withColumn("signature", F.to_json(F.struct("words", "q_document", "q_types")))
    shared = prepared.groupBy("signature").agg(
        F.min("query_id").alias("lookup_id"), F.first("words").alias("words"), F.first("q_document").alias("q_document"),
        F.first("q_types").alias("q_types"), F.max("size").alias("size"))
    shared = cut_lineage(shared)
    lookups = (
        shared.select("lookup_id", F.explode("words").alias("term"))
        .groupBy("lookup_id", "term").agg(F.count("*").alias("weight")).withColumn("place", F.col("term"))
    )
    rarest, others = split_rarest(cut_lineage(lookups), index.terms)
    idf, saturation = (lambda c: _idf(c, n_chunks)), lambda tf: _saturation(tf, F.col("length"), mean_length)
    wanted = with_others(rarest, others).join(shared.select("lookup_id", "q_document", "q_types"), "lookup_id")
    entries = held(index, wanted).select("bucket", "term", "chunk_id", "tf", "length", *PAYLOAD)
    found = filtered_join(wanted, entries, ["bucket", "term"], asks_inside(shared, "q_document")).select(
        "lookup_id", "chunk_id", "length", "n_terms", (F.col("weight") * idf(F.col("df")) * saturation(F.col("tf"))).alias("first"), "others")
    part = F.col("other.weight") * idf(F.col("other.df")) * saturation(F.col("p_tf"))
    scored = (
        probed(index, found, others, "tf", "weight", "df").groupBy("lookup_id", "chunk_id")
        .agg(F.first("n_terms").alias("n_terms"), F.first("first").alias("first"), F.count("p_tf").alias("hits"), F.sum(part).alias("rest"))
        .filter(F.col("hits") == F.col("n_terms") - 1)
        .select("lookup_id", "chunk_id", (F.col("first") + F.coalesce("rest", F.lit(0.0))).alias("score"))
    )
    ranked = top_k(scored.withColumn("score", F.round("score", 6)), F.lit(MAX_SIZE), key="lookup_id")
    members = prepared.join(shared.select("signature", "lookup_id"), "signature").select("query_id", "lookup_id", "size")
    return members.join(ranked, "lookup_id").filter(F.col("rank") <= F.col("size")).select("query_id", "chunk_id", "score", "rank")


def phrase_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, chunk) with frequency and summed idf, for distinct (lookup_id, words) phrases.

    A phrase is driven by its rarest term; its frequency is the number of start positions
    shared by all of its terms."""
    n_chunks = index.corpus.select("n_chunks").scalar()
    lookups = phrases.select("lookup_id", F.posexplode("words").alias("place", "term"), F.lit(1).alias("weight"))
    rarest, others = split_rarest(lookups, index.terms)
    starts = F.transform("positions", lambda p: p - F.col("place"))
    found = with_others(rarest, others).join(held(index, rarest.filter("df > 0")).select("bucket", "term", "chunk_id", "positions", "length", *PAYLOAD), ["bucket", "term"]).select(
        "lookup_id", "chunk_id", "length", *PAYLOAD, "n_terms", starts.alias("starts"), _idf(F.col("df"), n_chunks).alias("idf"), "others")
    other_starts = F.transform("p_positions", lambda p: p - F.col("other.place"))
    hits = (
        probed(index, found, others, "positions", "place", "df").groupBy("lookup_id", "chunk_id")
        .agg(F.first("length").alias("length"), *[F.first(c).alias(c) for c in PAYLOAD], F.first("n_terms").alias("n_terms"),
             F.first("starts").alias("starts"), F.collect_list(other_starts).alias("rest"),
             (F.first("idf") + F.coalesce(F.sum(_idf(F.col("other.df"), n_chunks)), F.lit(0.0))).alias("idf"))
        .filter(F.size("rest") == F.col("n_terms") - 1)
        .withColumn("tf", F.size(F.aggregate("rest", F.col("starts"), lambda a, b: F.array_intersect(a, b))))
        .filter(F.col("tf") > 0)
    )
    return hits.select("lookup_id", "chunk_id", *PAYLOAD, "length", "idf", "tf")


def phrases_or(index: Index, queries: DataFrame) -> DataFrame:
    """Query text or any expanded term as an exact phrase; scores of matching phrases add up.

    Each distinct phrase is matched once, however many queries contain it."""
    texts = F.concat(F.array("text"), F.coalesce("expanded_terms", F.array().cast("array<string>")))
    asked = queries.select("query_id", F.explode(texts).alias("phrase")).withColumn("words", T.terms(F.col("phrase"))).filter(
        F.size("words") > 0).select("query_id", F.array_join("words", " ").alias("lookup_id"), "words")
    asked = cut_lineage(asked)
    hits = phrase_hits(index, asked.select("lookup_id", "words").distinct())
    mean_length = index.corpus.select("mean_length").scalar()
    part = F.col("idf") * _saturation(F.col("tf"), F.col("length"), mean_length)
    wanted = asked.select("query_id", "lookup_id").join(_filters_of(queries), "query_id")
    scored = (
        filtered_join(wanted, hits.select("lookup_id", "chunk_id", *PAYLOAD, part.alias("score")), "lookup_id", asks_inside(queries))
        .groupBy("query_id", "chunk_id", "size")
        .agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("phrases"))
    )
    return top_k(scored, F.col("size")).drop("size")


def resolve_sections(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact section lookup, optionally in one document, at most 50 chunks per query.

    The cap is applied to the chunks before the join, so many queries for one popular
    section meet 50 rows each instead of every chunk of that section."""
    by_section = Window.partitionBy("section_id").orderBy("chunk_id")
    by_both = Window.partitionBy("document_name", "section_id").orderBy("chunk_id")
    slim = chunks.select("chunk_id", "document_name", "section_id", "clause_type")
    anywhere = slim.withColumn("rank", F.row_number().over(by_section)).filter(F.col("rank") <= SECTION_CAP)
    wanted = queries.select("query_id", "section_id", F.col("document_name").alias("q_document"))
    # written, so that Spark knows its size: many queries for one section then meet its few rows where they are
    path = scratch_path(chunks.sparkSession, "first-of-sections")
    anywhere.write.parquet(path)
    anywhere = chunks.sparkSession.read.schema(anywhere.schema).parquet(path)
    loose = wanted.filter(F.col("q_document").isNull()).drop("q_document").join(anywhere, "section_id")
    strict = wanted.filter(F.col("q_document").isNotNull()).withColumnRenamed("q_document", "document_name")
    # a document is asked for few of its sections: only those are ranked
    asked = strict.select("document_name", "section_id").distinct()
    within = (
        slim.join(asked, ["document_name", "section_id"], "left_semi")
        .withColumn("rank", F.row_number().over(by_both)).filter(F.col("rank") <= SECTION_CAP)
    )
    strict = strict.join(within, ["document_name", "section_id"])
    columns = ["query_id", "chunk_id", "document_name", "section_id", "clause_type", "rank"]
    return loose.select(*columns).unionByName(strict.select(*columns)).withColumn("score", F.lit(1.0))


def named_section(text: Column) -> Column:
    """Section a query text names, as spelled, or null."""
    found = F.regexp_extract(text, T.SECTION_REFERENCE, 0)
    return F.when(found != "", found)


def whole_sections(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the queries whose section exists, and each one's chunks of that section under its filters, at most ``size``.

    No section is cut before the filters: of the chunks of one section and clause type no query can return more than
    its first MAX_SIZE, so a popular section meets many queries in few rows a type and nothing is lost."""
    by_type, by_all = ["section_id", "clause_type"], ["document_name", "section_id", "clause_type"]
    slim = chunks.select("chunk_id", "document_name", "section_id", "clause_type")
    wanted = queries.select("query_id", "section_id", F.col("document_name").alias("q_document"), F.col("clause_types").alias("q_types"), "size")
    found, offered = [], []
    for asked, keys in ((wanted.filter("q_document is null").drop("q_document"), by_type),
                        (wanted.filter("q_document is not null").withColumnRenamed("q_document", "document_name"), by_all)):
        places = keys[:-1]
        rows = slim.join(asked.select(*places).distinct(), places, "left_semi")
        first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))).filter(F.col("place") <= MAX_SIZE)
        first = cut_lineage(first.select(*keys, "chunk_id", "place"))
        kinds = first.select(*keys).distinct()
        found.append(asked.join(kinds.select(*places).distinct(), places, "left_semi").select("query_id"))
        typed = asked.join(kinds, places).filter(_type_allowed()).drop("q_types")
        offered.append(typed.join(first.select(*[F.col(k).alias(f"f_{k}") for k in keys], "chunk_id", "place"), _equal(keys)).filter(
            F.col("place") <= F.col("size")).select("query_id", "chunk_id", "size"))
    return found[0].unionByName(found[1]), offered[0].unionByName(offered[1]).withColumn("score", F.lit(1.0))


def _equal(keys: list[str]) -> Column:
    """A clause type may be null, as a type of its own."""
    same = F.col("clause_type").eqNullSafe(F.col("f_clause_type"))
    for key in keys[:-1]:
        same = same & (F.col(key) == F.col(f"f_{key}"))
    return same


def section_or_bm25(index: Index, queries: DataFrame, whole: bool = False) -> DataFrame:
    """A query naming an existing section returns that section's chunks; the rest are scored.

    The chunks are the section's first 50 under the query's filters, or with ``whole`` all of them."""
    named = queries.withColumn("section_id", named_section(F.col("text"))).filter(F.col("section_id").isNotNull())
    if whole:
        resolved, offered = whole_sections(index.chunks, named)
        resolved = cut_lineage(resolved)
        ranked = top_k(offered, F.col("size"), [F.asc("chunk_id")])
    else:
        resolved = cut_lineage(resolve_sections(index.chunks, named))
        filtered = resolved.join(_filters_of(queries), "query_id").filter(
            (F.coalesce(F.size("q_types"), F.lit(0)) < 1) | F.array_contains("q_types", F.col("clause_type"))
        )
        ranked = top_k(
            filtered.select("query_id", "chunk_id", "score", F.col("rank").alias("place"), "size"),
            F.col("size"), [F.asc("place")],
        )
    direct = ranked.select("query_id", "chunk_id", "score", "rank", F.lit("section").alias("route"))
    rest = cut_lineage(queries.join(resolved.select("query_id").distinct(), "query_id", "left_anti"))
    if rest.isEmpty():
        return direct
    scored = bm25_and(index, rest).select("query_id", "chunk_id", "score", "rank", F.lit("bm25").alias("route"))
    return direct.unionByName(scored)


def fetch_sections(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of a set of sections per query, at most ``size``, unscored.

    ``wanted`` has (query_id, section_id, document_name, size)."""
    found = first_of_sections(chunks, wanted)
    return top_k(found.withColumn("score", F.lit(0.0)), F.col("size"), [F.asc("chunk_id")]).drop("size")


def first_of_sections(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted section's first chunks; MAX_SIZE per section bounds any later limit."""
    slim = chunks.select("chunk_id", "document_name", "section_id")
    by_section = Window.partitionBy("section_id").orderBy("chunk_id")
    by_both = Window.partitionBy("document_name", "section_id").orderBy("chunk_id")
    anywhere = slim.withColumn("place", F.row_number().over(by_section)).filter(F.col("place") <= MAX_SIZE)
    within = slim.withColumn("place", F.row_number().over(by_both)).filter(F.col("place") <= MAX_SIZE)
    keys = wanted.select("query_id", "section_id", F.col("document_name").alias("q_document"), "size").distinct()
    loose = keys.filter(F.col("q_document").isNull()).drop("q_document").join(anywhere, "section_id")
    strict = (
        keys.filter(F.col("q_document").isNotNull()).withColumnRenamed("q_document", "document_name")
        .join(within, ["document_name", "section_id"])
    )
    columns = ["query_id", "chunk_id", "section_id", "size"]
    return loose.select(*columns).unionByName(strict.select(*columns))


def section_pointers(chunks: DataFrame, hits: DataFrame, limit: int = POINTER_LIMIT) -> DataFrame:
    """Hits plus up to ``limit`` chunks of sections they refer to and do not already include.

    ``hits`` has (query_id, chunk_id, score); at most MAX_SIZE rows per query."""
    hits = cut_lineage(hits.select("query_id", "chunk_id", "score"))
    placed = hits.join(chunks.select("chunk_id", "section_id", "references_sections"), "chunk_id")
    present = placed.select("query_id", "section_id").distinct()
    order = Window.partitionBy("query_id").orderBy("section_id")
    missing = (
        placed.select("query_id", F.explode("references_sections").alias("section_id")).distinct()
        .join(present, ["query_id", "section_id"], "left_anti")
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        .select("query_id", "section_id", F.lit(None).cast("string").alias("document_name"), F.lit(limit).alias("size"))
    )
    extra = fetch_sections(chunks, missing).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return hits.select("query_id", "chunk_id", "score", F.lit(False).alias("is_pointer")).unionByName(
        extra.select("query_id", "chunk_id", "score", F.lit(True).alias("is_pointer"))
    )


def highlight(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Query terms in the hit's text wrapped in ``<em>``."""
    words = F.array_join(F.array_distinct(T.terms(F.col("q_text"))), "|")
    pattern = F.concat(F.lit(rf"(?iu)(?<!{T.WORD})("), words, F.lit(rf")(?!{T.WORD})"))
    return (
        hits.join(queries.select("query_id", F.col("text").alias("q_text")), "query_id")
        .join(chunks.select("chunk_id", "text"), "chunk_id")
        .select("query_id", "chunk_id", F.regexp_replace(F.col("text"), pattern, F.lit("<em>$1</em>")).alias("highlight"))
    )


def synonym_groups(synonyms: DataFrame) -> DataFrame:
    """(agent, group_no, term, pos) rows to lower-cased, order-deduplicated groups of two or more."""
    return (
        synonyms.groupBy("agent", "group_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("ordered"))
        .select("agent", "group_no", F.array_distinct(F.filter(
            F.transform("ordered", lambda x: F.lower(T.strip(x["term"]))), lambda w: w != ""
        )).alias("members"))
        .filter(F.size("members") > 1)
    )


def synonym_expand(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Tokens plus, where a group member occurs, the words of its other members.

    Runs of as many words as a member has are looked up in the group table, an equi join.  The
    table is a registry; its member lengths are few numbers.  A run carries the words that stand where others would be
    added, so what is added is new to its chunk and only added rows are deduplicated; rows that share a chunk id are
    deduplicated whole."""
    words = F.col("words")
    sizes = [r[0] for r in groups.select(F.explode("members").alias("m")).select(F.size(T.terms(F.col("m")))).distinct().collect()]
    lengths = sorted(n for n in sizes if n > 0)
    longest = max(sizes, default=1)

    def runs_of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
        run = lambda i: F.struct(
            i.alias("position"), F.array_join(F.slice(words, i + 1, n), " ").alias("run"), F.slice(words, i + 1, longest).alias("here"))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), run)

    runs = F.flatten(F.array(*[runs_of(n) for n in lengths or [1]]))
    base = chunks.select("chunk_id", T.terms(F.col("text")).alias("words"))
    others = (
        groups.select(F.explode("members").alias("member"), "members")
        .select(F.array_join(T.terms(F.col("member")), " ").alias("run"), F.col("member"), "members")
        .select("run", "member", F.explode("members").alias("other")).filter(F.col("member") != F.col("other")).drop("member").distinct()
        .select("run", F.posexplode(T.terms(F.col("other"))).alias("shift", "term"))
    )
    added = (
        base.select("chunk_id", F.inline(runs)).join(others, "run")
        .filter(~F.get("here", F.col("shift")).eqNullSafe(F.col("term")))
        .select("chunk_id", (F.col("position") + F.col("shift")).alias("position"), "term").distinct()
    )
    own = tokens(chunks).select("chunk_id", "position", "term")
    shared = cut_lineage(chunks.groupBy("chunk_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("chunk_id").alias("shared_id")))
    if shared.isEmpty():
        return own.unionByName(added)
    is_shared = F.col("chunk_id").eqNullSafe(F.col("shared_id"))
    both = own.unionByName(added)
    return both.join(shared, is_shared, "left_anti").unionByName(both.join(shared, is_shared, "left_semi").distinct())


def compound_queries(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Expand request texts with the agent's synonym groups that occur in them.

    ``registry`` has one row per agent: groups array<array<string>>, clause_types, top_k."""
    lowered = F.lower("text")
    joined = requests.join(registry, "agent")
    active = F.filter("groups", lambda g: F.exists(g, lambda m: F.contains(lowered, F.lower(m))))
    expanded = F.array_distinct(F.filter(F.flatten(active), lambda m: F.lower(m) != lowered))
    return joined.select(
        "query_id", "agent", "text", expanded.alias("expanded_terms"),
        F.lit(None).cast("string").alias("document_name"), "clause_types", F.col("top_k").alias("size"),
    )


def agent_stats(retrieved: DataFrame, relevance: DataFrame, findings: DataFrame, runs: DataFrame, agents: DataFrame) -> DataFrame:
    """Per agent: chunks retrieved, relevant (true or unjudged), findings, failure."""
    judged = (
        retrieved.join(relevance, ["agent", "chunk_id"], "left")
        .groupBy("agent")
        .agg(F.count("*").alias("chunks_retrieved"), F.count_if(F.coalesce("relevant", F.lit(True))).alias("chunks_relevant"))
    )
    counts = findings.groupBy("agent").agg(F.count("*").alias("findings"))
    failed = runs.groupBy("agent").agg(F.max("error").alias("error"))
    return (
        agents.select("agent").join(judged, "agent", "left").join(counts, "agent", "left").join(failed, "agent", "left")
        .select("agent", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_retrieved", "chunks_relevant", "findings")], "error")
    )
