"""Inputs of the registered queries, derived by Spark from the driver's tables.

Every derivation covers its whole table.  The select statements are plain enough to run
unchanged in the checking engine.  Deal ``D0`` holds a third of all findings on purpose,
so that every per-deal operator meets a hot key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T
from briefmill.operators import chunking, classify, search
from briefmill.plans.registry import CTES, cte
from briefmill.session import scratch_path

PAGE_LINES = 40
SECTION_LINES = 5

# Terms that occur in the invented prose, standing in for the legal vocabulary.
FIXTURE_TERMS = {
    "tax_provision": ["an", "are"], "ip_assignment": ["by", "from"], "liability_cap": ["at", "of the"],
    "fx_hedging": ["st", "ou"], "employment_term": ["nd", "tion"], "change_of_control": ["he", "ed"],
    "indemnification": ["ing", "or"], "data_protection": ["ti", "ea"], "insurance_policy": ["nt", "ly"],
    "governance_clause": ["ble", "ther"], "related_party_transaction": ["sh", "thon"],
    "cyber_security": ["thth", "than"], "supplier_contract": ["wh", "thre"], "customer_contract": ["thnt", "thes"],
    "reputation_risk": ["thhe", "thha"], "esg_obligation": ["thed", "in the"],
}


def fixture_registry() -> list[dict]:
    """Agent n routes on the terms of clause type n; its synonym group adds one term of the next."""
    types = list(FIXTURE_TERMS)
    out = []
    for i, agent in enumerate(domains.AGENTS):
        first, second = FIXTURE_TERMS[types[i]]
        following = FIXTURE_TERMS[types[(i + 1) % len(types)]][0]
        out.append({
            "agent": agent, "routing_terms": [first, second], "clause_types": [types[i]],
            "synonym_groups": [[first, second, following]], "top_k": domains.DEFAULT_TOP_K,
        })
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return ",".join("(" + ",".join(lit(v) for v in row) + ")" for row in rows)


def values_cte(name: str, columns: str, rows: list[tuple]) -> None:
    cte(name, f"select * from (values {_values(rows)}) as v({columns})")


D = domains
values_cte("d_dim", "dimension_idx, dimension, core_question",
           [(i, n, D.DIMENSION_QUESTIONS[n]) for i, n in enumerate(D.DIMENSIONS)])
values_cte("d_agent", "agent_idx, agent, default_dimension, domain",
           [(i + 1, a, D.AGENT_DIMENSION[a], D.AGENT_DOMAIN[a]) for i, a in enumerate(D.AGENTS)])
values_cte("d_clause", "clause_idx, clause_type, critical_min, high_min, medium_min",
           [(i + 1, c, *D.SEVERITY_THRESHOLDS[c]) for i, c in enumerate(D.CLAUSE_TYPES)])
values_cte("d_persona", "persona_idx, persona, in_limited, opposing",
           [(i, p, p in D.LIMITED_PERSONAS, p in D.OPPOSING_PERSONAS) for i, p in enumerate(D.PERSONAS)])
values_cte("d_transition", "from_state, to_state", D.TRANSITIONS)
values_cte("d_lookup", "agent, clause_type, dimension", D.DIMENSION_LOOKUP)
values_cte("d_tax", "idx, clause_type, term",
           [(i + 1, c, w) for i, c in enumerate(FIXTURE_TERMS) for w in FIXTURE_TERMS[c]])
values_cte("d_registry", "idx, agent, pos, term, clause_type",
           [(i + 1, r["agent"], p, w, r["clause_types"][0])
            for i, r in enumerate(fixture_registry()) for p, w in enumerate(r["routing_terms"])])
values_cte("d_synonym", "agent, group_no, pos, term",
           [(r["agent"], g, p, w) for r in fixture_registry()
            for g, group in enumerate(r["synonym_groups"]) for p, w in enumerate(group)])

# ---- text ---------------------------------------------------------------------------------
_B = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sectioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_lines(table(spark, sf_dir, "documents"))


def section_lines(docs: DataFrame) -> DataFrame:
    """Legal-looking structure over the prose: headers, references, definition sections."""
    first_word = F.nullif(F.regexp_extract("text", T.TERM, 0), F.lit(""))
    meaning = F.concat(F.lit('"'), first_word, F.lit('" means the '), "source", F.lit(" term."))
    # documents are dealt before they are taken apart, so all that follows stays where the document is; its front stands at -1
    raws = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_name"),
        F.concat(F.array(meaning), F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))).alias("raws"),
    ).repartition("document_name").select("document_name", F.posexplode("raws").alias("at", "raw")).select(
        "document_name", (F.col("at") - 1).alias("pos"), "raw").filter((F.col("pos") < 0) | (T.strip("raw") != ""))
    entry = lambda seq, line: F.struct(seq.alias("seq"), line.alias("line"))
    front = F.array(entry(F.lit(-2), F.lit("Section 0. Definitions")), entry(F.lit(-1), F.col("raw")))
    number = F.floor(F.col("pos") / SECTION_LINES)
    header = entry(F.col("pos") * 2, F.concat(F.lit("Section "), number + 1, F.lit(". Part")))
    body = entry(F.col("pos") * 2 + 1, F.concat("raw", F.when(
        F.col("pos") % 7 == 3, F.concat(F.lit(" see Section "), F.col("pos") % 4 + 1, F.lit("."))).otherwise("")))
    opened = F.when(F.col("pos") < 0, front).when(F.col("pos") % SECTION_LINES == 0, F.array(header, body)).otherwise(F.array(body))
    page = F.floor(F.greatest("pos", F.lit(0)) / PAGE_LINES).cast("int")
    return raws.select("document_name", page.alias("page_index"), F.inline(opened)).filter(F.col("line").isNotNull())


cte("raw_lines", """
  select 'doc-' || doc_id as document_name, unnest(parts) as raw, unnest(range(len(parts))) as pos
  from (select doc_id, string_split(text, chr(10)) as parts from documents)""")
cte("fx_lines", f"""
  select document_name, cast(floor(pos / {PAGE_LINES}) as bigint) as page_index, 2 * pos as seq,
         'Section ' || (1 + cast(floor(pos / {SECTION_LINES}) as bigint)) || '. Part' as line
  from raw_lines where pos % {SECTION_LINES} = 0 and trim(raw, {_B}) <> ''
  union all
  select document_name, cast(floor(pos / {PAGE_LINES}) as bigint), 2 * pos + 1,
         raw || case when pos % 7 = 3 then ' see Section ' || (1 + pos % 4) || '.' else '' end
  from raw_lines where trim(raw, {_B}) <> ''
  union all
  select 'doc-' || doc_id, 0, -2, 'Section 0. Definitions' from documents
  union all
  select 'doc-' || doc_id, 0, -1, line from (
    select doc_id, '"' || nullif(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+'), '') || '" means the ' || source || ' term.' as line
    from documents) where line is not null""", "raw_lines")

SQL_TOKEN = r"[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*"
SQL_TERM = r"[\p{L}\p{N}_]+"
SQL_SECTION = r"(?:Section|Article)\s+\d+(?:\.\d+)*(?:\([A-Za-z0-9]+\))*"
SQL_HEADER = rf"(?i)^\s*({SQL_SECTION})\b(.*)$"
cte("headed", rf"""
  select document_name, page_index, seq, line,
         case when name <> '' and len(regexp_extract_all(rest, '\S+')) <= 12
                   and not ends_with(rest, '.') and not ends_with(rest, ';') then name end as header
  from (select *, regexp_extract(line, '{SQL_HEADER}', 1) as name,
               trim(regexp_extract(line, '{SQL_HEADER}', 2), ' .:-') as rest
        from (select document_name, page_index, seq, trim(line, {_B}) as line from fx_lines)
        where line <> '')""", "fx_lines")
cte("carried", """
  select *, coalesce(last_value(header ignore nulls) over (
           partition by document_name order by page_index, seq
           rows between unbounded preceding and current row), 'document_root') as section_id
  from headed""", "headed")
cte("numbered", """
  select *, cast(sum(turn) over (partition by document_name order by page_index, seq rows unbounded preceding) as bigint) as run
  from (select *, case when lag(section_id) over w <> section_id or lag(page_index) over w <> page_index
                       then 1 else 0 end as turn
        from carried window w as (partition by document_name order by page_index, seq))""", "carried")
cte("split_clause", rf"""
  select document_name, page_index, seq, section_id, run, unnest(parts) as clause, unnest(range(len(parts))) as part_no
  from (select *, list_filter(list_transform(
          regexp_split_to_array(regexp_replace(line, '([.;])\s+', '\1' || chr(10), 'g'), '\r?\n+'),
          lambda x: trim(x, {_B})), lambda x: x <> '') as parts from numbered)""", "numbered")
cte("bounded_clause", rf"""
  select document_name, page_index, seq, section_id, run, part_no, 0 as piece_no, clause
  from split_clause where len(regexp_extract_all(clause, '{SQL_TOKEN}')) <= 500
  union all
  select document_name, page_index, seq, section_id, run, part_no, unnest(range(n_pieces)) as piece_no,
         unnest(list_transform(range(n_pieces), lambda k:
           trim(array_to_string(list_slice(marked, 2 + 500 * k, 501 + 500 * k), ''), {_B}))) as clause
  from (select *, cast(ceil((len(marked) - 1) / 500.0) as bigint) as n_pieces
        from (select *, string_split(regexp_replace(clause, '({SQL_TOKEN})', chr(1) || '\1', 'g'), chr(1)) as marked
              from split_clause where len(regexp_extract_all(clause, '{SQL_TOKEN}')) > 500))""", "split_clause")
cte("sized", rf"""
  select document_name, page_index, seq, section_id, run, clause, part_no, piece_no,
         row_number() over (partition by document_name, run order by seq, part_no, piece_no) as i,
         len(regexp_extract_all(clause, '{SQL_TOKEN}')) as tokens
  from bounded_clause""", "bounded_clause")
cte("packed", """
  select document_name, run, i, tokens as acc, cast(0 as bigint) as part, clause, tokens, section_id, page_index
  from sized where i = 1
  union all
  select c.document_name, c.run, c.i,
         case when p.acc + c.tokens > 500 then c.tokens else p.acc + c.tokens end,
         p.part + case when p.acc + c.tokens > 500 then 1 else 0 end, c.clause, c.tokens, c.section_id, c.page_index
  from packed p join sized c on c.document_name = p.document_name and c.run = p.run and c.i = p.i + 1""", "sized")
cte("pieces", """
  select document_name, run, part, any_value(section_id) as section_id, any_value(page_index) as absolute_page,
         string_agg(clause, ' ' order by i) as text, cast(sum(tokens) as bigint) as tokens, count(*) as clause_count
  from packed group by document_name, run, part""", "packed")
cte("chunks", rf"""
  select document_name || ':' || chunk_index || ':' || substr(sha256(text), 1, 16) as chunk_id,
         document_name, chunk_index, text, section_id, absolute_page, tokens,
         list_filter(refs, lambda r, j: list_position(folded, lower(r)) = j) as references_sections
  from (select *, list_transform(refs, lambda r: lower(r)) as folded
        from (select *, regexp_extract_all(text, '(?i)\b{SQL_SECTION}') as refs,
                     row_number() over (partition by document_name order by run, part) - 1 as chunk_index
              from pieces))""", "pieces")
_HITS = ", ".join(
    f"case when regexp_matches(body, '(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])') then {n} end"
    for n, term in enumerate([w for words in FIXTURE_TERMS.values() for w in words], 1)
)
cte("term_hits", f"""
  select h.chunk_id, t.rn, t.idx, t.clause_type, t.term
  from (select chunk_id, unnest([{_HITS}]) as rn from (select chunk_id, lower(text) as body from chunks)) h
  join (select *, row_number() over () as rn from d_tax) t on t.rn = h.rn""", "chunks", "d_tax")
cte("classified", """
  select c.*, coalesce(r.clause_type, 'general') as clause_type, coalesce(r.confidence, cast(0 as double)) as classification_confidence,
         coalesce(r.matched_terms, '') as matched_terms
  from chunks c left join (
    select chunk_id,
           case when leaders = 1 then any_value(clause_type) filter (where n = best) else 'general' end as clause_type,
           cast(case when leaders = 1 then least(0.7 + 0.1 * (best - 1), 0.99) else 0.0 end as double) as confidence,
           case when leaders = 1 then any_value(terms) filter (where n = best)
                else array_to_string(list_sort(list_distinct(flatten(list(term_list)))), '|') end as matched_terms
    from (select *, count(*) filter (where n = best) over (partition by chunk_id) as leaders
          from (select *, max(n) over (partition by chunk_id) as best
                from (select chunk_id, clause_type, count(*) as n, list(term) as term_list,
                             string_agg(term, '|' order by rn) as terms
                      from term_hits group by chunk_id, clause_type)))
    group by chunk_id, leaders, best) r using (chunk_id)""", "chunks", "term_hits")


def raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_chunks(sectioned_lines(spark, sf_dir))


_STORED: dict[tuple[str, ...], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write=None) -> DataFrame:
    """A derived table written once to the shared folder and read by every consumer.

    It is kept for the application, the folder and the name: inputs that change during a session need a folder of their own."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        if write is None:
            build().write.parquet(path)
        else:
            write(build(), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def classified_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(raw_chunks(spark, sf_dir), FIXTURE_TERMS)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified chunks of the whole corpus, stored."""
    return stored(spark, sf_dir, "chunks", lambda: classified_chunks(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    rows = chunks(spark, sf_dir)
    entries = stored(spark, sf_dir, "postings", lambda: search.postings(search.spread(rows)), search.write_postings)
    terms = stored(spark, sf_dir, "terms", lambda: search.stats_of_postings(entries))
    corpus = stored(spark, sf_dir, "corpus", lambda: search.corpus_stats(rows))
    return search.Index(rows, entries, terms, corpus)


# ---- retrieval requests -----------------------------------------------------------------------


def agent_registry(spark: SparkSession) -> DataFrame:
    rows = [(r["agent"], r["synonym_groups"], r["clause_types"], r["top_k"]) for r in fixture_registry()]
    return domains.frame(
        spark, rows, "agent string, groups array<array<string>>, clause_types array<string>, top_k int")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per specialist plus one per document (its first two words)."""
    rows = [("A-" + r["agent"], " ".join(r["routing_terms"]), None, 0) for r in fixture_registry()]
    by_agent = domains.frame(spark, rows, "query_id string, text string, document_name string, n bigint")
    by_document = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Q-"), "doc_id").alias("query_id"),
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(T.TERM), 0), 1, 2), " ").alias("text"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc-"), "doc_id")).alias("document_name"),
        F.col("doc_id").alias("n"),
    ).filter(F.col("text") != "")
    kinds = F.array(*[F.lit(k) for k in FIXTURE_TERMS])
    return by_agent.unionByName(by_document).select(
        "query_id", "text", F.array().cast("array<string>").alias("expanded_terms"), "document_name",
        F.when(F.col("n") % 3 == 1, F.slice(kinds, (F.col("n") % 16 + 1).cast("int"), 8))
        .otherwise(F.array().cast("array<string>")).alias("clause_types"),
        F.lit(domains.DEFAULT_TOP_K).alias("size"),
    )


def unfiltered(queries: DataFrame) -> DataFrame:
    return queries.withColumn("document_name", F.lit(None).cast("string")).withColumn(
        "clause_types", F.array().cast("array<string>"))


_KINDS = "[" + ", ".join(f"'{k}'" for k in FIXTURE_TERMS) + "]"
_AGENT_Q = ", ".join(f"('A-{r['agent']}', '{' '.join(r['routing_terms'])}', 0)" for r in fixture_registry())
cte("requests", f"""
  select query_id, text, document_name, case when n % 3 = 1 then list_slice({_KINDS}, n % 16 + 1, n % 16 + 8) else [] end as kinds,
         10 as size
  from (select column0 as query_id, column1 as text, cast(null as varchar) as document_name, column2 as n
        from (values {_AGENT_Q}) as v(column0, column1, column2)
        union all
        select 'Q-' || doc_id, array_to_string(list_slice(regexp_extract_all(text, '{SQL_TERM}'), 1, 2), ' '),
               case when doc_id % 3 = 0 then 'doc-' || doc_id end, doc_id from documents)
  where text <> ''""")
cte("tok", f"""
  select chunk_id, unnest(words) as term, unnest(range(len(words))) as position, len(words) as length
  from (select chunk_id, regexp_extract_all(lower(text), '{SQL_TERM}') as words from chunks)""", "chunks")
cte("tf", """
  select term, chunk_id, count(*) as tf, list(position order by position) as positions, any_value(length) as length
  from tok group by 1, 2""", "tok")
cte("df", "select term, count(*) as df from tf group by 1", "tf")
cte("corpus", """
  select (select count(*) from chunks) as n_chunks, (select avg(length) from (
    select chunk_id, max(length) as length from tok group by 1)) as mean_length""", "tok", "chunks")
cte("scored_terms", """
  select tf.chunk_id, tf.term, tf.length, tf.positions, n_chunks, mean_length,
         ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) as idf,
         tf / (tf + 1.2 * (1 - 0.75 + 0.75 * tf.length / mean_length)) as saturation
  from tf join df using (term), corpus""", "tf", "df", "corpus")
cte("q_terms", f"""
  select query_id, term, count(*) as weight, count(*) over (partition by query_id) as n_terms
  from (select query_id, unnest(regexp_extract_all(lower(text), '{SQL_TERM}')) as term from requests)
  group by 1, 2""", "requests")
cte("and_scores", """
  select query_id, chunk_id, round(sum(weight * idf * saturation), 6) as score
  from q_terms join scored_terms using (term)
  group by query_id, chunk_id, n_terms having count(*) = n_terms""", "q_terms", "scored_terms")
cte("bm25_all", """
  select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from and_scores)
  where rank <= 10""", "and_scores")
cte("bm25_filtered", """
  select * from (
    select a.*, row_number() over (partition by query_id order by score desc, chunk_id) as rank
    from and_scores a join requests r using (query_id) join classified c using (chunk_id)
    where (r.document_name is null or r.document_name = c.document_name)
      and (len(r.kinds) = 0 or list_contains(r.kinds, c.clause_type)))
  where rank <= 10""", "and_scores", "requests", "classified")


# ---- findings -----------------------------------------------------------------------------------
# A third of all orders belong to deal D0.
cte("fx_findings_raw", """
  select concat('F-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
                cast(round(l_extendedprice * 100) as bigint), '-', cast(l_quantity as bigint)) as finding_id,
         l_orderkey * 10 + l_linenumber as seq,
         case when l_orderkey % 3 = 0 then 'D0' else concat('D', 1 + cast(floor(l_orderkey / 8) as bigint)) end as deal_id,
         1 + l_suppkey % 16 as agent_idx,
         1 + l_partkey % 17 as clause_idx,
         round(l_discount * 10, 1) as confidence_num,
         concat('Section ', 1 + l_partkey % 12) as section_id,
         concat('clause ', l_suppkey % 10) as citation,
         concat('doc-', l_partkey) as document_name,
         cast(l_linenumber as bigint) as absolute_page,
         case l_linenumber when 1 then 'possible injunction' when 2 then 'material breach alleged'
              when 3 then 'fraud and default' else 'standard term' end as claim
  from lineitem""")
cte("fx_findings", """
  select f.*, agent, default_dimension, domain, clause_type, critical_min, high_min, medium_min,
         case when confidence_num >= 0.8 then 'high' when confidence_num >= 0.5 then 'medium' else 'speculative' end as confidence
  from fx_findings_raw f join d_agent using (agent_idx) join d_clause using (clause_idx)""",
    "fx_findings_raw", "d_agent", "d_clause")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per order line, with agent and clause type."""
    raw = spark.sql(CTES["fx_findings_raw"][0].replace("from lineitem", "from {lineitem}"),
                    lineitem=table(spark, sf_dir, "lineitem"))
    return (
        raw.join(domains.agents(spark).select("agent_idx", "agent"), "agent_idx")
        .join(domains.clause_types(spark).select("clause_idx", "clause_type"), "clause_idx")
        .withColumn("confidence", T.coerce_confidence(F.col("confidence_num")))
        .drop("agent_idx", "clause_idx")
    )


# ---- recorded debates: six personas, three rounds, one finding per 18 events --------------------
cte("fx_arguments_raw", """
  select event_id as argument_id,
         concat('F', cast(floor(event_id / 18) as bigint)) as finding_id,
         case when cast(floor(event_id / 18) as bigint) % 3 = 0 then 'D0'
              else concat('D', 1 + cast(floor(event_id / 144) as bigint)) end as deal_id,
         event_id % 6 as persona_idx,
         1 + cast(floor((event_id % 18) / 6) as bigint) as round,
         cast(floor(event_id / 18) as bigint) % 8 as dimension_idx,
         case when event_type in ('purchase', 'signup', 'view') then 'support'
              when event_type = 'error' then 'oppose' else 'neutral' end as stance,
         value >= 25 as bm25_verified,
         event_id % 11 = 0 as dropout_flag,
         case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'speculative' end as confidence,
         concat('Section ', 1 + event_id % 40) as citation_1,
         concat('Section ', 1 + user_id % 60) as citation_2,
         concat('the ', event_type, ' of by from section ', event_id % 97, '. and the rest of an argument') as argument,
         case when event_id % 4 = 0 then 'revised after new evidence' else '' end as notes,
         ts
  from events""")
cte("fx_arguments", """
  select a.*, persona, opposing, in_limited, dimension
  from fx_arguments_raw a join d_persona using (persona_idx) join d_dim using (dimension_idx)""",
    "fx_arguments_raw", "d_persona", "d_dim")


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(CTES["fx_arguments_raw"][0].replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    return (
        raw.join(domains.personas(spark).select("persona_idx", "persona"), "persona_idx")
        .join(domains.dimensions(spark).select("dimension_idx", "dimension"), "dimension_idx")
        .withColumn("citations", F.array("citation_1", "citation_2"))
        .drop("persona_idx", "dimension_idx", "citation_1", "citation_2")
    )


cte("fx_debated", """
  select finding_id, any_value(deal_id) as deal_id, any_value(dimension) as dimension,
         case cast(substr(finding_id, 2) as bigint) % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity,
         concat('claim of ', finding_id) as claim, min(citation_1) as citation, min(citation_2) as section_id,
         1 + cast(substr(finding_id, 2) as bigint) % 17 as clause_idx
  from fx_arguments group by finding_id""", "fx_arguments")
cte("fx_debated_full", "select d.*, clause_type from fx_debated d join d_clause using (clause_idx)", "fx_debated", "d_clause")


def debated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings the recorded arguments are about, stored."""
    return stored(spark, sf_dir, "debated", lambda: _debated_findings(spark, sf_dir))


def _debated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("finding_id", 2, 20).cast("bigint")
    return (
        arguments(spark, sf_dir).groupBy("finding_id")
        .agg(F.first("deal_id").alias("deal_id"), F.first("dimension").alias("dimension"),
             F.min(F.col("citations")[0]).alias("citation"), F.min(F.col("citations")[1]).alias("section_id"))
        .withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in domains.SEVERITIES]), (number % 4 + 1).cast("int")))
        .withColumn("claim", F.concat(F.lit("claim of "), "finding_id"))
        .withColumn("clause_idx", number % 17 + 1)
        .join(domains.clause_types(spark).select("clause_idx", "clause_type"), "clause_idx").drop("clause_idx")
    )


cte("fx_decisions", """
  select finding_id, case user_id % 4 when 0 then 'confirmed' when 1 then 'evidence_not_found' else 'overridden' end as status,
         user_id % 4 = 2 as judge_override_flag, concat('rationale ', user_id) as synthesis_rationale
  from (select concat('F', cast(floor(event_id / 18) as bigint)) as finding_id, min_by(user_id, event_id) as user_id
        from events group by 1)
  where user_id % 4 <> 3""")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge decisions: the event that opens a finding decides it; some findings get none."""
    return spark.sql(CTES["fx_decisions"][0].replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
