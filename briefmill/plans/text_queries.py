"""Registered queries: sources, text functions, chunking and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefmill.functions import text as T
from briefmill.operators import chunking, classify, definitions
from briefmill.plans import inputs as I
from briefmill.plans.inputs import SQL_SECTION, SQL_TOKEN
from briefmill.plans.registry import cte, query
from briefmill.sources import documents as docs


@query("src_documents", """
  select 'doc-' || doc_id || suffix as document_name, lower(substr(suffix, 2)) as document_type,
         lower(suffix) in ('.pdf', '.docx') as accepted,
         case when lower(suffix) not in ('.pdf', '.docx') then 'unsupported document type: ' || suffix end as reason
  from (select *, case doc_id % 4 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.docx' else '.txt' end as suffix
        from documents)""")
def _src_documents(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".DOCX", ".docx", ".txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = I.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id"), suffix).alias("path"))
    return docs.dispatch(files)


@query("src_documents_loaded", """
  select 'doc-' || doc_id || case doc_id % 4 when 0 then '.pdf' when 1 then '.DOCX' else '.docx' end as document_name,
         case doc_id % 4 when 0 then 'pdf' else 'docx' end as document_type, strlen(text) as size, sha256(text) as fingerprint,
         cast(null as varchar) as reason
  from documents where doc_id % 4 <> 3""")
def _src_loaded(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".DOCX", ".docx", ".txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    named = I.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id"), suffix).alias("document_name"), F.col("text").alias("content"))
    return docs.load(docs.dispatch(named, "document_name"), named).drop("content")


@query("src_dedup_fingerprint", """
  select sha256(text) as fingerprint, min(doc_id) as doc_id, count(*) as copies from documents group by 1""")
def _src_dedup(spark, sf):
    return docs.first_per_fingerprint(I.table(spark, sf, "documents"))


@query("src_lines", f"""
  select doc_id, page_index, seq, line from (
    select doc_id, page_index, unnest(range(len(parts))) as seq, unnest(list_transform(parts, lambda x: trim(x, {I._B}))) as line
    from (select doc_id, page_index, regexp_split_to_array(page, '\\r\\n|\\n|\\r') as parts
          from (select doc_id, unnest(range(len(pages))) as page_index, unnest(pages) as page
                from (select doc_id, string_split(text, chr(12)) as pages from documents))))
  where line <> ''""")
def _src_lines(spark, sf):
    pages = chunking.pages_of(I.table(spark, sf, "documents").select("doc_id", "text"))
    return chunking.lines_of(pages)


@query("txt_count_tokens", f"""
  select doc_id, len(regexp_extract_all(text, '{SQL_TOKEN}')) as tokens from documents""")
def _count(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


cte("line_clauses", f"""
  select document_name, seq, list_filter(list_transform(
           regexp_split_to_array(regexp_replace(line, '([.;])\\s+', '\\1' || chr(10), 'g'), '\\r?\\n+'),
           lambda x: trim(x, {I._B})), lambda x: x <> '') as parts
  from headed""", "headed")


@query("txt_split_clauses", """
  select document_name, seq, unnest(range(len(parts))) as clause_no, unnest(parts) as clause from line_clauses""",
       "line_clauses")
def _split(spark, sf):
    lines = I.sectioned_lines(spark, sf).withColumn("line", T.strip("line"))
    return lines.select("document_name", "seq", F.posexplode(T.split_clauses(F.col("line"))).alias("clause_no", "clause"))


@query("txt_section_refs", f"""
  select document_name, array_to_string(list_filter(refs, lambda r, j:
           list_position(list_transform(refs, lambda q: lower(q)), lower(r)) = j), '|') as refs
  from (select document_name, regexp_extract_all(string_agg(line, chr(10) order by page_index, seq),
                                                 '(?i)\\b{SQL_SECTION}') as refs
        from fx_lines group by document_name)""", "fx_lines")
def _refs(spark, sf):
    whole = (
        I.sectioned_lines(spark, sf).groupBy("document_name")
        .agg(F.array_sort(F.collect_list(F.struct("page_index", "seq", "line"))).alias("ordered"))
        .select("document_name", F.array_join(F.transform("ordered", lambda x: x["line"]), "\n").alias("text"))
    )
    return whole.select("document_name", T.section_references(F.col("text")).alias("refs"))


@query("txt_section_header", "select document_name, page_index, seq, header from headed", "headed")
def _header(spark, sf):
    lines = I.sectioned_lines(spark, sf)
    return lines.select("document_name", "page_index", "seq", T.section_header(T.strip("line")).alias("header"))


@query("txt_split_oversized", f"""
  select doc_id, 0 as piece_no, text as piece from documents where len(regexp_extract_all(text, '{SQL_TOKEN}')) <= 100
  union all
  select doc_id, unnest(range(n)), unnest(list_transform(range(n), lambda k:
           trim(array_to_string(list_slice(marked, 2 + 100 * k, 101 + 100 * k), ''), {I._B})))
  from (select *, cast(ceil((len(marked) - 1) / 100.0) as bigint) as n
        from (select doc_id, string_split(regexp_replace(text, '({SQL_TOKEN})', chr(1) || '\\1', 'g'), chr(1)) as marked
              from documents where len(regexp_extract_all(text, '{SQL_TOKEN}')) > 100))""")
def _oversized(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(T.split_oversized(F.col("text"), 100)).alias("piece_no", "piece"))


@query("txt_section_carry_forward", "select document_name, page_index, seq, section_id from carried", "carried")
def _carry(spark, sf):
    return chunking.carry_sections(I.sectioned_lines(spark, sf)).select("document_name", "page_index", "seq", "section_id")


@query("txt_chunk_pack", """
  select document_name, run, part, section_id, absolute_page, tokens, clause_count, text from pieces""", "pieces")
def _pack(spark, sf):
    return chunking.pack_chunks(I.sectioned_lines(spark, sf))


@query("txt_chunk_build", """
  select chunk_id, document_name, chunk_index, section_id, absolute_page, tokens, text,
         array_to_string(references_sections, '|') as references_sections from chunks""", "chunks")
def _build(spark, sf):
    return I.raw_chunks(spark, sf)


@query("txt_classify_clause", """
  select chunk_id, clause_type, round(classification_confidence, 6) as classification_confidence, matched_terms
  from classified""", "classified")
def _classify(spark, sf):
    return I.classified_chunks(spark, sf).select("chunk_id", "clause_type", "classification_confidence", "matched_terms")


@query("txt_clause_distribution", "select clause_type, count(*) as chunks from classified group by 1", "classified")
def _distribution(spark, sf):
    return classify.distribution(I.classified_chunks(spark, sf))


_M = "\"''“”‘’"
_V = r"\s+(?:shall\s+)?(?:means?|have\s+the\s+meaning|refers\s+to)\s+([^.;\n]+)"
cte("def_lines", r"""
  select document_name, page_index, seq, line from (
    select *, coalesce(bool_or(started and stops) over w, false) as ended from (
      select *, bool_or(starts) over w as started from (
        select *, not starts and (regexp_matches(line, '(?i)^(section|article|appendix)[\s\d.]*[a-z0-9]')
                 or (upper(line) = line and lower(line) <> line and length(line) < 40
                     and not contains(upper(line), 'DEFINITIONS'))) as stops
        from (select *, regexp_matches(line, '(?i)^(?:section|article|appendix)\s*\d*(?:\.\d*)*\s*definitions\b') as starts
              from headed))
      window w as (partition by document_name order by page_index, seq rows unbounded preceding))
    window w as (partition by document_name order by page_index, seq rows unbounded preceding))
  where started and not ended""", "headed")
cte("defs", f"""
  select document_name, term, arg_max(definition, ord) as definition from (
    select document_name, page_index * 1000000000 + seq as ord,
           trim(case when q <> '' then q else u end, {I._B}) as term,
           trim(case when q <> '' then qd else ud end, {I._B}) as definition
    from (select *, regexp_extract(line, '(?i)[{_M}]([^{_M}]{{2,50}})[{_M}]{_V}', 1) as q,
                 regexp_extract(line, '(?i)[{_M}]([^{_M}]{{2,50}})[{_M}]{_V}', 2) as qd,
                 regexp_extract(line, '(?i)^\\s*([A-Z][A-Za-z0-9\\s]{{1,49}}){_V}', 1) as u,
                 regexp_extract(line, '(?i)^\\s*([A-Z][A-Za-z0-9\\s]{{1,49}}){_V}', 2) as ud
          from def_lines))
  where length(term) >= 2 group by document_name, term""", "def_lines")


@query("txt_definitions", "select document_name, term, definition from defs", "defs")
def _definitions(spark, sf):
    return definitions.definitions(I.sectioned_lines(spark, sf))


@query("txt_defined_terms_map", r"""
  select chunk_id, string_agg(term || '=' || definition, '|' order by term) as defined_terms
  from chunks join defs using (document_name)
  where regexp_matches(text, '(^|[^\p{L}\p{N}_])' || term || '($|[^\p{L}\p{N}_])')
  group by chunk_id""", "chunks", "defs")
def _terms_map(spark, sf):
    lines = I.sectioned_lines(spark, sf)
    mapped = definitions.defined_terms_map(I.raw_chunks(spark, sf), definitions.definitions(lines))
    pairs = F.transform(F.map_entries("defined_terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return mapped.select("chunk_id", F.array_sort(pairs).alias("defined_terms"))


@query("txt_doc_snippets", """
  select 'doc-' || doc_id as document_name, coalesce(snippet, '(No content/metadata extracted)') as snippet
  from documents left join (
    select document_name, substr(string_agg(text, chr(10) order by chunk_index), 1, 1000) as snippet
    from chunks group by 1) on document_name = 'doc-' || doc_id""", "chunks")
def _snippets(spark, sf):
    names = I.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_name"))
    return chunking.snippets(names, I.raw_chunks(spark, sf))


def _claim_sql() -> str:
    cases = "".join(
        f" when instr(text, {stop}) > 1 and instr(text, {stop}) <= 200 then substr(text, 1, instr(text, {stop}))"
        for stop in ("'. '", "'.' || chr(10)", "'! '", "'? '")
    )
    return f"case{cases} when length(text) <= 200 then text else rtrim(substr(text, 1, 200), {I._B}) || '...' end"


@query("txt_key_claim", f"select doc_id, {_claim_sql()} as key_claim from documents")
def _key_claim(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.key_claim(F.col("text")).alias("key_claim"))


@query("txt_token_estimate", "select doc_id, greatest(1, length(text) // 4) as estimate from documents")
def _estimate(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))
