"""Registered queries: index, retrieval and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T
from briefmill.operators import prompts, routing, search
from briefmill.plans import inputs as I
from briefmill.plans.inputs import SQL_SECTION, SQL_TERM
from briefmill.plans.registry import cte, query


@query("ir_tokens", "select chunk_id, position, term from tok", "tok")
def _tokens(spark, sf):
    return search.tokens(I.chunks(spark, sf))


@query("ir_postings", """
  select term, chunk_id, tf, array_to_string(positions, '|') as positions, length, document_name, clause_type
  from tf join (select chunk_id, document_name, clause_type from classified) using (chunk_id)""", "tf", "classified")
def _postings(spark, sf):
    return search.postings(I.chunks(spark, sf)).drop("bucket")


@query("ir_corpus_stats", """
  select term, df, n_chunks, round(mean_length, 6) as mean_length from df, corpus""", "df", "corpus")
def _corpus(spark, sf):
    rows = I.chunks(spark, sf)
    index = search.Index(rows, rows, search.term_stats(rows), search.corpus_stats(rows))
    return index.terms.select(
        "term", "df", index.corpus.select("n_chunks").scalar().alias("n_chunks"),
        index.corpus.select("mean_length").scalar().alias("mean_length"))


def _synonyms(spark):
    rows = [(r["agent"], g, p, w) for r in I.fixture_registry()
            for g, group in enumerate(r["synonym_groups"]) for p, w in enumerate(group)]
    return domains.frame(spark, rows, "agent string, group_no int, pos int, term string")


@query("ir_synonym_groups", """
  select agent, group_no, string_agg(term, '|' order by pos) as members, cast(coalesce(sum(df), 0) as bigint) as member_chunks
  from d_synonym left join df using (term) group by 1, 2""", "d_synonym", "df")
def _groups(spark, sf):
    groups = search.synonym_groups(_synonyms(spark))
    member = groups.select("agent", "group_no", "members", F.explode("members").alias("term"))
    return (
        member.join(search.term_stats(I.chunks(spark, sf)), "term", "left")
        .groupBy("agent", "group_no", "members").agg(F.sum(F.coalesce("df", F.lit(0))).alias("member_chunks"))
    )


cte("grams", """
  select chunk_id, position, term as run from tok
  union all
  select chunk_id, position, run from (
    select chunk_id, position, term || ' ' || lead(term) over (partition by chunk_id order by position) as run from tok)
  where run is not null""", "tok")


@query("ir_synonym_expand", f"""
  select chunk_id, position, term from tok
  union
  select chunk_id, position + unnest(range(len(words))), unnest(words) from (
    select g.chunk_id, g.position, regexp_extract_all(o.term, '{SQL_TERM}') as words
    from grams g join d_synonym m on m.term = g.run
    join d_synonym o on o.agent = m.agent and o.group_no = m.group_no and o.term <> m.term)""",
       "tok", "grams", "d_synonym")
def _expand(spark, sf):
    return search.synonym_expand(I.chunks(spark, sf), search.synonym_groups(_synonyms(spark)))


@query("ir_bm25_and_topk", "select query_id, chunk_id, score, rank from bm25_all", "bm25_all")
def _bm25(spark, sf):
    return search.bm25_and(I.index(spark, sf), I.unfiltered(I.requests(spark, sf)))


@query("ir_exact_filters", "select query_id, chunk_id, score, rank from bm25_filtered", "bm25_filtered")
def _filters(spark, sf):
    return search.bm25_and(I.index(spark, sf), I.requests(spark, sf))


cte("compound", f"""
  select r.query_id, replace(r.query_id, 'A-', '') as agent, r.text, s.terms
  from requests r join (
    select q.query_id, list(s.term order by s.pos) filter (where s.term <> lower(q.text)) as terms
    from (select query_id, text, replace(query_id, 'A-', '') as agent from requests where query_id like 'A-%') q
    join d_synonym s using (agent)
    where exists (select 1 from d_synonym m where m.agent = s.agent and m.group_no = s.group_no
                  and contains(lower(q.text), m.term))
    group by 1) s using (query_id)""", "requests", "d_synonym")
cte("agent_words", f"""
  select 'W-' || agent || '-' || word as query_id, agent, word as text, n from (
    select word, count(*) as n from (
      select unnest(list_slice(regexp_extract_all(lower(text), '{SQL_TERM}'), 1, 2)) as word from documents) group by 1), d_agent""",
    "d_agent")


def _requests_per_agent(spark, sf):
    """Every agent asks for every distinct word that opens a document."""
    opening = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(SQL_TERM), 0), 1, 2)
    words = I.table(spark, sf, "documents").select(F.explode(opening).alias("text")).distinct()
    agents = F.array(*[F.lit(a) for a in domains.AGENTS])
    return words.withColumn("agent", F.explode(agents)).withColumn(
        "query_id", F.concat_ws("-", F.lit("W"), "agent", "text"))


cte("word_groups", """
  select distinct w.text, m.agent, m.group_no from (select distinct text from agent_words) w join d_synonym m on contains(w.text, m.term)""",
    "agent_words", "d_synonym")
cte("compound_words", """
  select w.query_id, w.agent, w.text, coalesce(array_to_string(e.terms, '|'), '') as expanded_terms, e.terms as term_list
  from agent_words w left join (
    select g.text, g.agent, list(s.term order by s.pos) filter (where s.term <> g.text) as terms
    from word_groups g join d_synonym s on s.agent = g.agent and s.group_no = g.group_no
    group by 1, 2) e on e.text = w.text and e.agent = w.agent""", "agent_words", "word_groups", "d_synonym")


@query("ir_compound_query", """
  select query_id, c.agent, text, expanded_terms, clause_type as clause_types, cast(10 as bigint) as size
  from compound_words c join (select distinct agent, clause_type from d_registry) r on r.agent = c.agent""",
       "compound_words", "d_registry")
def _compound(spark, sf):
    built = search.compound_queries(_requests_per_agent(spark, sf), I.agent_registry(spark))
    return built.drop("document_name")


cte("phrases", """
  select query_id, phrase_no, phrase from (
    select query_id, unnest(list_prepend(text, coalesce(term_list, []))) as phrase,
           unnest(range(1 + len(coalesce(term_list, [])))) as phrase_no from compound_words)""", "compound_words")
cte("phrase_terms", f"""
  select query_id, phrase_no, unnest(words) as term, unnest(range(len(words))) as ofs, len(words) as n_terms
  from (select *, regexp_extract_all(lower(phrase), '{SQL_TERM}') as words from phrases)""", "phrases")
cte("phrase_hits", """
  select query_id, phrase_no, chunk_id, count(*) as tf, max(idf) as idf, max(length) as length, max(mean_length) as mean_length
  from (select p.query_id, p.phrase_no, s.chunk_id, s.position - p.ofs as start, count(*) as found, max(p.n_terms) as n_terms,
               sum(idf) as idf, max(s.length) as length, max(mean_length) as mean_length
        from phrase_terms p join (select chunk_id, term, idf, length, mean_length, unnest(positions) as position from scored_terms) s using (term)
        group by 1, 2, 3, 4)
  where found = n_terms group by 1, 2, 3""", "phrase_terms", "scored_terms")


@query("ir_phrase_should", """
  select query_id, chunk_id, score, phrases, rank from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
      select query_id, chunk_id, count(*) as phrases,
             round(sum(idf * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) as score
      from phrase_hits join classified using (chunk_id)
      join (select query_id, agent from agent_words) using (query_id)
      join (select distinct agent, clause_type as wanted from d_registry) using (agent)
      where wanted = clause_type
      group by 1, 2)) where rank <= 10""", "phrase_hits", "classified", "agent_words", "d_registry")
def _phrase(spark, sf):
    built = search.compound_queries(_requests_per_agent(spark, sf), I.agent_registry(spark))
    return search.phrases_or(I.index(spark, sf), built)


def _section_requests(spark, sf):
    """Per document: one query naming a section, in that document or anywhere, some with filters."""
    n = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in I.FIXTURE_TERMS])
    return I.table(spark, sf, "documents").select(
        F.concat(F.lit("S-"), n).alias("query_id"),
        F.concat(F.when(n % 5 == 0, "section ").otherwise("Section "), n % 23, F.lit(" an")).alias("text"),
        F.concat(F.lit("Section "), n % 23).alias("section_id"),
        F.array().cast("array<string>").alias("expanded_terms"),
        F.when(n % 2 == 0, F.concat(F.lit("doc-"), n)).alias("document_name"),
        F.when(n % 3 == 1, F.slice(kinds, (n % 16 + 1).cast("int"), 8))
        .otherwise(F.array().cast("array<string>")).alias("clause_types"),
        F.lit(10).alias("size"),
    )


cte("s_requests", f"""
  select 'S-' || doc_id as query_id, case when doc_id % 5 = 0 then 'section ' else 'Section ' end || (doc_id % 23) || ' an' as text,
         'Section ' || (doc_id % 23) as section_id, case when doc_id % 2 = 0 then 'doc-' || doc_id end as document_name,
         case when doc_id % 3 = 1 then list_slice({I._KINDS}, doc_id % 16 + 1, doc_id % 16 + 8) else [] end as kinds
  from documents""")


def _resolve_sql(section: str) -> str:
    return f"""
  select * from (
    select q.query_id, c.chunk_id, c.document_name, c.section_id, c.clause_type, q.kinds,
           row_number() over (partition by q.query_id order by c.chunk_id) as rank
    from (select *, {section} as wanted from s_requests) q join classified c on c.section_id = q.wanted
    where q.document_name is null or q.document_name = c.document_name) where rank <= 50"""


cte("s_resolved", _resolve_sql("section_id"), "s_requests", "classified")
cte("s_named", _resolve_sql(f"regexp_extract(text, '(?i){SQL_SECTION}')"), "s_requests", "classified")


@query("ir_resolve_section", """
  select query_id, chunk_id, document_name, section_id, clause_type, rank, cast(1 as double) as score from s_resolved""",
       "s_resolved")
def _resolve(spark, sf):
    return search.resolve_sections(I.chunks(spark, sf), _section_requests(spark, sf))


@query("ir_section_shortcircuit", f"""
  select query_id, chunk_id, cast(1 as double) as score, place as rank, 'section' as route from (
    select *, row_number() over (partition by query_id order by rank) as place from s_named
    where len(kinds) = 0 or list_contains(kinds, clause_type)) where place <= 10
  union all
  select query_id, chunk_id, score, rank, 'bm25' from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
      select t.query_id, s.chunk_id, round(sum(idf * saturation), 6) as score
      from (select query_id, document_name, kinds, unnest(words) as term, len(words) as n_terms
            from (select *, regexp_extract_all(lower(text), '{SQL_TERM}') as words from s_requests
                  where query_id not in (select query_id from s_named))) t
      join scored_terms s using (term) join classified c using (chunk_id)
      where (t.document_name is null or t.document_name = c.document_name)
        and (len(t.kinds) = 0 or list_contains(t.kinds, c.clause_type))
      group by t.query_id, s.chunk_id, n_terms having count(*) = n_terms)) where rank <= 10""",
       "s_named", "s_requests", "scored_terms", "classified")
def _shortcircuit(spark, sf):
    return search.section_or_bm25(I.index(spark, sf), _section_requests(spark, sf).drop("section_id"))


@query("ir_fetch_sections", """
  select query_id, chunk_id, section_id, cast(0 as double) as score, rank from (
    select q.query_id, c.chunk_id, c.section_id, row_number() over (partition by q.query_id order by c.chunk_id) as rank
    from (select query_id, document_name, unnest([section_id, 'Section 2']) as wanted from s_requests) q
    join (select * from chunks) c on c.section_id = q.wanted
    where q.wanted is not null and (q.document_name is null or q.document_name = c.document_name)
    group by q.query_id, c.chunk_id, c.section_id) where rank <= 10""", "s_requests", "chunks")
def _fetch(spark, sf):
    wanted = _section_requests(spark, sf).select(
        "query_id", "document_name", "size",
        F.explode(F.array("section_id", F.lit("Section 2"))).alias("section_id"))
    return search.fetch_sections(I.chunks(spark, sf), wanted)


@query("ir_section_pointers", """
  select query_id, chunk_id, score, false as is_pointer from bm25_all
  union all
  select query_id, chunk_id, cast(0 as double), true from (
    select *, row_number() over (partition by query_id order by chunk_id) as place from (
      select p.query_id, c.chunk_id from (
        select *, row_number() over (partition by query_id order by section_id) as place from (
          select distinct query_id, unnest(references_sections) as section_id from bm25_all join chunks using (chunk_id)
          except select query_id, section_id from bm25_all join chunks using (chunk_id))) p
      join chunks c using (section_id) where p.place <= 5)) where place <= 5""", "bm25_all", "chunks")
def _pointers(spark, sf):
    index = I.index(spark, sf)
    hits = search.bm25_and(index, I.unfiltered(I.requests(spark, sf))).select("query_id", "chunk_id", "score")
    return search.section_pointers(index.chunks, hits)


@query("ir_highlight", f"""
  select query_id, chunk_id, array_to_string(list_transform(
           regexp_extract_all(c.text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
           lambda x: case when list_contains(q.terms, lower(x)) then '<em>' || x || '</em>' else x end), '') as highlight
  from bm25_all join chunks c using (chunk_id)
  join (select query_id, regexp_extract_all(lower(text), '{I.SQL_TERM}') as terms from requests) q using (query_id)""",
       "bm25_all", "chunks", "requests")
def _highlight(spark, sf):
    index, queries = I.index(spark, sf), I.unfiltered(I.requests(spark, sf))
    return search.highlight(search.bm25_and(index, queries).select("query_id", "chunk_id"), index.chunks, queries)


cte("agent_hits", "select replace(query_id, 'A-', '') as agent, chunk_id from bm25_all where query_id like 'A-%'", "bm25_all")


def agent_hits(spark, sf):
    asked = I.unfiltered(I.requests(spark, sf)).filter(F.col("query_id").startswith("A-"))
    found = lambda: search.bm25_and(I.index(spark, sf), asked).select(
        F.regexp_replace("query_id", "^A-", "").alias("agent"), "chunk_id")
    return I.stored(spark, sf, "agent-hits", found)


def relevance(hits):
    """Verdicts for a part of the hits: none, true or false by a hash of the chunk id."""
    n = F.conv(F.substring(F.md5("chunk_id"), 1, 6), 16, 10).cast("bigint") % 3
    return hits.select("agent", "chunk_id", F.when(n == 0, True).when(n == 1, False).alias("relevant")).filter(
        F.col("relevant").isNotNull())


_MD5 = "cast('0x' || substr(md5(chunk_id), 1, 6) as bigint) % 3"


@query("val_gap_relevance", f"select agent, chunk_id from agent_hits where {_MD5} <> 1", "agent_hits")
def _relevance(spark, sf):
    from briefmill.operators.validation import keep_relevant
    hits = agent_hits(spark, sf)
    return keep_relevant(hits, relevance(hits))


@query("ir_agent_retrieval_stats", f"""
  select agent, coalesce(h.n, 0) as chunks_retrieved, coalesce(h.r, 0) as chunks_relevant, coalesce(f.n, 0) as findings, e.error
  from d_agent left join (select agent, count(*) as n, count(*) filter (where {_MD5} <> 1) as r from agent_hits group by 1) h using (agent)
  left join (select agent, count(*) as n from fx_findings group by 1) f using (agent)
  left join (select agent, max('timeout') as error from (
       select 1 + event_id % 16 as agent_idx from events where event_type = 'error') join d_agent using (agent_idx)
       group by 1) e using (agent)""", "d_agent", "agent_hits", "fx_findings")
def _stats(spark, sf):
    hits = agent_hits(spark, sf)
    agents = domains.agents(spark)
    runs = I.table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        (F.col("event_id") % 16 + 1).alias("agent_idx"), F.lit("timeout").alias("error")).join(agents, "agent_idx")
    findings = I.findings(spark, sf)
    return search.agent_stats(hits, relevance(hits), findings, runs.select("agent", "error"), agents)


# ---- routing -------------------------------------------------------------------------------------
_WORDS = [w for words in I.FIXTURE_TERMS.values() for w in words]


def _hits_sql(body: str) -> str:
    return ", ".join(
        f"case when regexp_matches({body}, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') then {n} end"
        for n, w in enumerate(_WORDS, 1))


cte("doc_routes", f"""
  select doc_id, rn from (select doc_id, unnest([{_hits_sql('body')}]) as rn
    from (select doc_id, regexp_replace(lower(text), '[_\\-]+', ' ', 'g') as body from documents)) where rn is not null""")
cte("registry_rn", "select *, row_number() over () as rn from d_registry", "d_registry")


@query("route_contains_term", "select doc_id, term from doc_routes join registry_rn using (rn)", "doc_routes", "registry_rn")
def _contains(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", T.routing_text(F.col("text")).alias("body")).withColumn("edged", T.word_edges(F.col("body")))
    hits = F.array_compact(F.array(*[F.when(routing.contains_term(F.col("body"), F.col("edged"), w), F.lit(w)) for w in _WORDS]))
    return docs.select("doc_id", F.explode(hits).alias("term"))


cte("deal_documents", """
  select case when doc_id % 3 = 0 then 'D0' else 'D' || (1 + doc_id // 4) end as deal_id, 'doc-' || doc_id as document_name
  from documents""")


def deal_documents(spark, sf):
    n = F.col("doc_id")
    return I.table(spark, sf, "documents").select(
        F.when(n % 3 == 0, "D0").otherwise(F.concat(F.lit("D"), F.floor(n / 4) + 1)).alias("deal_id"),
        F.concat(F.lit("doc-"), n).alias("document_name"))


cte("routed", f"""
  select deal_id, agent, string_agg(match, '|' order by pos) as matched_terms, false as used_fallback from (
    select distinct deal_id, agent, pos, match from deal_documents join (
      select document_name, agent, pos, term as match from (
        select document_name, unnest([{_hits_sql('body')}]) as rn
        from (select document_name, regexp_replace(lower(text), '[_\\-]+', ' ', 'g') as body from chunks
              union all select document_name, regexp_replace(document_name, '[_\\-]+', ' ', 'g') from deal_documents)) join registry_rn using (rn)
      union all
      select document_name, agent, 9, clause_type from classified join (select distinct agent, clause_type from d_registry) using (clause_type))
      using (document_name))
  group by 1, 2""", "deal_documents", "chunks", "registry_rn", "classified", "d_registry")
cte("planned", """
  select * from routed union all
  select deal_id, agent, '', true from (select distinct deal_id from deal_documents
    where deal_id not in (select deal_id from routed)), d_agent""", "routed", "deal_documents", "d_agent")


def planned(spark, sf):
    return routing.specialists(deal_documents(spark, sf), I.chunks(spark, sf), I.fixture_registry())


@query("route_specialists", "select * from planned", "planned")
def _specialists(spark, sf):
    return planned(spark, sf)


def _suggestions(spark, sf):
    e = F.col("event_id")
    agents = F.array(*[F.lit(a) for a in domains.AGENTS])
    return I.table(spark, sf, "events").select(
        F.concat(F.lit("D"), F.col("user_id") + 1).alias("deal_id"),
        F.when((e % 7 == 0) & (F.col("user_id") % 2 == 0), F.element_at(agents, (e % 16 + 1).cast("int")))
        .otherwise("unknown_agent").alias("agent"))


cte("suggestions", """
  select 'D' || (user_id + 1) as deal_id, agent from events join d_agent on agent_idx = event_id % 16 + 1
  where event_id % 7 = 0 and user_id % 2 = 0""", "d_agent")


@query("route_suggested_agents", """
  select distinct deal_id, agent, '' as matched_terms, false as used_fallback from suggestions join d_agent using (agent)
  union all
  select deal_id, agent, matched_terms, true from planned
  where deal_id not in (select deal_id from suggestions join d_agent using (agent))""", "suggestions", "d_agent", "planned")
def _suggested(spark, sf):
    return routing.suggested(_suggestions(spark, sf), planned(spark, sf))


@query("route_finding_enrich", """
  select finding_id, agent, default_dimension as dimension, domain from fx_findings""",
       "fx_findings", "d_agent")
def _enrich(spark, sf):
    return routing.enrich_findings(I.findings(spark, sf).select("finding_id", "agent"))


@query("txt_prompt_table", """
  select agent, chunk_id, 'Analyze the following passage for ' || domain || ' issues.' || chr(10) || chr(10) || '<untrusted_source doc_id="'
         || document_name || '" section="' || section_id || '" page="' || absolute_page || '">' || chr(10) || text || chr(10) || '</untrusted_source>' as prompt
  from classified join (select distinct agent, clause_type from d_registry) using (clause_type) join d_agent using (agent)""",
       "classified", "d_registry", "d_agent")
def _prompts(spark, sf):
    """Every chunk goes to the specialists of its clause type."""
    rows = I.chunks(spark, sf)
    registry = I.agent_registry(spark).select("agent", F.explode("clause_types").alias("clause_type"))
    hits = rows.join(registry, "clause_type").select("agent", "chunk_id")
    return prompts.analysis_prompts(hits, rows, domains.agents(spark))
