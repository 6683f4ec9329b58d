"""Registered queries: entities and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T
from briefmill.operators import entities as ent
from briefmill.operators import graph as gr
from briefmill.plans import inputs as I
from briefmill.plans.inputs import SQL_TERM
from briefmill.plans.registry import cte, query

# ---- names: every mention of every chunk ---------------------------------------------------------
# A mention is a capitalised word, typed by its first letter; a person's name takes the next word too.  Three of
# eight mentions of a chunk are respelled.  Candidates are the names that two documents or more mention.

_LABELS = ["ORG", "PERSON", "GPE", "LOC", "FAC", "PRODUCT", "LAW", "DATE"]
_TYPES = ", ".join(f"('{k}', '{v}')" for k, v in domains.ENTITY_LABELS.items())
_NAME = r"\p{Lu}\p{L}+(?: \p{L}+)?"
cte("fx_mentions", f"""
  select document_name, case when n % 3 = 0 then 'D0' else 'D' || (1 + n // 4) end as deal_id, entity_type,
         case when entity_type = 'person' then full_name else w end as base, i, w, substr(full_name, length(w) + 2) as second
  from (select document_name, cast(substr(document_name, 5) as bigint) as n, full_name, i, str_split(full_name, ' ')[1] as w,
               [{", ".join(f"'{x}'" for x in _LABELS)}][1 + unicode(lower(full_name)) % 8] as label
        from (select document_name, unnest(m) as full_name, unnest(range(len(m))) as i from (select document_name, regexp_extract_all(text, '{_NAME}') as m from chunks)))
  join (values {_TYPES}) as t(label, entity_type) using (label)""", "chunks")
cte("fx_names", """
  select distinct deal_id, entity_type, case i % 8 when 1 then 'Director ' || base when 2 then lower(base) || ', '
         when 3 then case when entity_type = 'person' and second <> '' then substr(w, 1, 1) || ' ' || second else substr(base, 1, 2) || substr(base, 4) end
         else base end as name from fx_mentions""", "fx_mentions")
cte("fx_cands", """
  select distinct deal_id, entity_type, base as candidate from fx_mentions
  where (entity_type, base) in (select (entity_type, base) from fx_mentions group by entity_type, base having count(distinct document_name) > 1)""", "fx_mentions")


def name_mentions(spark, sf):
    return I.stored(spark, sf, "name_mentions", lambda: _name_mentions(spark, sf))


def names(spark, sf):
    return I.stored(spark, sf, "names", lambda: _names(spark, sf))


def candidates(spark, sf):
    return I.stored(spark, sf, "candidates", lambda: _candidates(spark, sf))


def _name_mentions(spark, sf):
    n, both, w = F.substring("document_name", 5, 20).cast("bigint"), F.col("name"), F.substring_index("name", " ", 1)
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.ascii(F.lower(both)) % 8 + 1)
    labelled = I.chunks(spark, sf).select(
        "chunk_id", "document_name", "chunk_index", F.posexplode(F.regexp_extract_all("text", F.lit(_NAME), 0)).alias("i", "name")).withColumn("label", label)
    return ent.mentions(labelled).select(
        "document_name", F.when(n % 3 == 0, "D0").otherwise(F.concat(F.lit("D"), F.floor(n / 4) + 1)).alias("deal_id"), "entity_type",
        F.when(F.col("entity_type") == "person", both).otherwise(w).alias("base"), "i", "chunk_index", w.alias("w"),
        F.substring(both, F.length(w) + 2, F.length(both)).alias("second"))


def respelled():
    base, w, second = F.col("base"), F.col("w"), F.col("second")
    initial = F.when((F.col("entity_type") == "person") & (second != ""), F.concat_ws(" ", F.substring(w, 1, 1), second))
    return (
        F.when(F.col("i") % 8 == 1, F.concat(F.lit("Director "), base)).when(F.col("i") % 8 == 2, F.concat(F.lower(base), F.lit(", ")))
        .when(F.col("i") % 8 == 3, F.coalesce(initial, F.concat(F.substring(base, 1, 2), F.substring(base, 4, 1000000)))).otherwise(base)
    )


def _names(spark, sf):
    return name_mentions(spark, sf).select("deal_id", "entity_type", respelled().alias("name")).distinct()


def _candidates(spark, sf):
    rows = name_mentions(spark, sf)
    known = rows.groupBy("entity_type", "base").agg(F.min("document_name").alias("a"), F.max("document_name").alias("b")).filter("a <> b")
    return rows.join(known.select("entity_type", "base"), ["entity_type", "base"]).select("deal_id", "entity_type", F.col("base").alias("candidate")).distinct()


def _norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")


_ROLES = "[" + ", ".join(f"'{r}'" for r in domains.ROLE_WORDS) + "]"


def _free(x: str) -> str:
    kept = (f"list_filter(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''), "
            f"lambda w: not list_contains({_ROLES}, trim(w, '.,()')))")
    return f"case when len({kept}) = 0 then {x} else array_to_string({kept}, ' ') end"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query("ent_normalize", f"select deal_id, entity_type, name, {_norm('name')} as norm from fx_names", "fx_names")
def _normalize(spark, sf):
    return names(spark, sf).withColumn("norm", ent.normalized())


@query("ent_strip_roles", f"select deal_id, entity_type, name, {_free('name')} as stripped from fx_names", "fx_names")
def _strip(spark, sf):
    return names(spark, sf).withColumn("stripped", T.strip_roles(F.col("name"), domains.ROLE_WORDS))


cte("n_names", f"""
  select entity_type, name, {_norm('name')} as norm, {_norm(_free('name'))} as role_free, {_words('name')} as w
  from (select distinct entity_type, name from fx_names)""", "fx_names")
cte("n_cands", f"""
  select entity_type, candidate, {_norm('candidate')} as c_norm, {_norm(_free('candidate'))} as c_free, {_words('candidate')} as v
  from (select distinct entity_type, candidate from fx_cands)""", "fx_cands")


def _initial(a: str, b: str) -> str:
    return f"((length({a}) = 1 and starts_with({b}, {a})) or (length({b}) = 1 and starts_with({a}, {b})))"


cte("p_pairs", f"""
  select entity_type, name, candidate from n_names join n_cands using (entity_type)
  where entity_type = 'person' and len(w) = 2 and len(v) = 2 and
    case when w[2] = v[2] then {_initial('w[1]', 'v[1]')} when w[2] = v[1] then {_initial('w[1]', 'v[2]')}
         when w[1] = v[2] then {_initial('w[2]', 'v[1]')} when w[1] = v[1] then {_initial('w[2]', 'v[2]')} else false end""", "n_names", "n_cands")


@query("ent_person_match", "select entity_type, name, candidate from p_pairs", "p_pairs")
def _person(spark, sf):
    return ent.person_pairs(names(spark, sf).select("entity_type", "name").distinct(),
                            candidates(spark, sf).select("entity_type", "candidate").distinct())


cte("t1", """
  select entity_type, name, min(candidate) as canonical from (
    select entity_type, name, candidate from n_names join n_cands using (entity_type) where norm = c_norm or role_free = c_free
    union select * from p_pairs) group by 1, 2 having count(*) = 1""", "n_names", "n_cands", "p_pairs")


@query("ent_tier1", "select entity_type, name, canonical from t1", "t1")
def _tier1(spark, sf):
    return ent.tier1(names(spark, sf).select("entity_type", "name").distinct(), candidates(spark, sf).select("entity_type", "candidate").distinct())


cte("lcs_pairs", """
  select entity_type, norm, c_norm, (1.0::double - cast(length(norm) + length(c_norm) - 2 * (length(norm) - bit_count(s)) as double)
         / (length(norm) + length(c_norm))) * 100 / 100 as ratio
  from (select entity_type, norm, c_norm,
               list_reduce(list_transform(str_split(c_norm, ''), lambda ch: list_sum(list_transform(a, lambda x, i: case when x = ch then p[i] else 0 end))::bigint),
                           lambda s, m: ((s + (s & m)) | (s - (s & m))) & full_mask, full_mask) as s
        from (select entity_type, norm, c_norm, str_split(norm, '') as a, (1::bigint << length(norm)) - 1 as full_mask,
                     list_transform(range(length(norm)), lambda i: 1::bigint << i) as p
              from (select distinct entity_type, norm from n_names where (entity_type, name) not in (select (entity_type, name) from t1))
              join (select distinct entity_type, c_norm from n_cands) using (entity_type)
              where norm <> '' and c_norm <> '' and length(norm) < 62
                and length(norm) + length(c_norm) - length(translate(norm, c_norm, '')) - length(translate(c_norm, norm, ''))
                    >= 0.55 * (length(norm) + length(c_norm)) - 1e-9
                and 2.0 * least(length(norm), length(c_norm)) / (length(norm) + length(c_norm)) >= 0.55))""", "n_names", "n_cands", "t1")
cte("f_scores", """
  select n.deal_id, n.entity_type, n.name, c.candidate,
         case when b.candidate is not null then least(ratio + 0.05::double, 1.0) else ratio end as score
  from fx_names n join n_names m using (entity_type, name) join lcs_pairs p on p.entity_type = m.entity_type and p.norm = m.norm
  join n_cands c on c.entity_type = p.entity_type and c.c_norm = p.c_norm
  left join fx_cands b on b.deal_id = n.deal_id and b.entity_type = n.entity_type and b.candidate = c.candidate
  where (n.entity_type, n.name) not in (select (entity_type, name) from t1)""", "fx_names", "n_names", "lcs_pairs", "n_cands", "fx_cands", "t1")
cte("f_best", """
  select deal_id, entity_type, name, max(score) as score, count(*) filter (where score = top) as leaders, min(candidate) filter (where score = top) as canonical
  from (select *, max(score) over (partition by deal_id, entity_type, name) as top from f_scores where score >= 0.6) group by 1, 2, 3""", "f_scores")
cte("resolved", """
  select n.deal_id, n.entity_type, n.name,
         case when t.name is not null then t.canonical when b.score > 0.85 and b.leaders = 1 then b.canonical else n.name end as canonical,
         case when t.name is not null then 1 when b.score > 0.85 and b.leaders = 1 then 2 end as tier,
         case when t.name is not null or (b.score > 0.85 and b.leaders = 1) then 'confirmed' else 'unconfirmed_node' end as status,
         case when t.name is not null then 1.0::double else b.score end as confidence
  from fx_names n left join t1 t on t.entity_type = n.entity_type and t.name = n.name
  left join f_best b on b.deal_id = n.deal_id and b.entity_type = n.entity_type and b.name = n.name""", "fx_names", "t1", "f_best")


def contenders(spark, sf):
    return I.stored(spark, sf, "contenders", lambda: ent.contenders(ent.unresolved(names(spark, sf), candidates(spark, sf)), candidates(spark, sf)))


def resolutions(spark, sf):
    return I.stored(spark, sf, "resolutions", lambda: ent.resolve(names(spark, sf), candidates(spark, sf), close=contenders(spark, sf)))


@query("ent_tier2_fuzzy", """
  select deal_id, entity_type, name, canonical, tier, status, round(confidence, 6) as confidence from resolved""", "resolved")
def _tier2(spark, sf):
    return resolutions(spark, sf).drop("reason")


cte("review", """
  select r.deal_id, r.entity_type, r.name, s.candidate, s.score from resolved r join f_scores s using (deal_id, entity_type, name)
  where r.status = 'unconfirmed_node' and r.confidence between 0.6 and 0.85 and s.score >= r.confidence - 0.05 - 1e-9 and s.score >= 0.6""", "resolved", "f_scores")


def queue(spark, sf):
    return ent.review_queue(resolutions(spark, sf), contenders(spark, sf))


cte("whole_review", """
  select r.deal_id, r.entity_type, r.name, s.candidate, s.score from resolved r join f_scores s using (deal_id, entity_type, name)
  where r.status = 'unconfirmed_node' and r.confidence between 0.6 and 0.85 and s.score >= 0.6""", "resolved", "f_scores")


@query("ent_tier3_queue", "select deal_id, entity_type, name, candidate, round(score, 6) as score from whole_review", "whole_review")
def _queue(spark, sf):
    return ent.whole_review_queue(resolutions(spark, sf), candidates(spark, sf))


def _hash(column: str):
    return F.conv(F.substring(F.md5(column), 1, 6), 16, 10).cast("bigint") % 6


_H = "cast('0x' || substr(md5(name), 1, 6) as bigint) % 6"


@query("ent_tier3_apply", f"""
  select q.deal_id, q.entity_type, q.name, case when h >= 4 then q.candidate else q.name end as canonical,
         case when h >= 4 then 3 end as tier, case when h >= 4 then 'confirmed' else 'unconfirmed_node' end as status,
         case when h >= 4 then cast(0.75 as double) else 0.0 end as confidence,
         case h when 0 then 'no_llm_resolution_available' when 1 then 'llm_resolution_failed' when 2 then 'llm_rejected_merge'
                when 3 then 'llm_returned_unknown_canonical_name' else 'same' end as reason
  from (select deal_id, entity_type, name, min(candidate) as candidate, {_H} as h from review group by 1, 2, 3) q""", "review")
def _apply(spark, sf):
    waiting = queue(spark, sf)
    h = _hash("name")
    first = waiting.groupBy("deal_id", "entity_type", "name").agg(F.min("candidate").alias("candidate"))
    decided = first.filter(h > 0).select(
        "deal_id", "entity_type", "name", (h >= 3).alias("merge"), F.when(h == 3, "somebody else").otherwise(F.col("candidate")).alias("canonical_name"),
        F.lit(0.75).alias("confidence"), F.lit("same").alias("reason"), (h == 1).alias("failed"))
    return ent.apply_decisions(waiting, decided, candidates(spark, sf))


@query("ent_tier_mix", """
  select tier, status, count(*) as names, round(count(*) / cast((select count(*) from resolved) as double), 6) as share from resolved group by 1, 2""", "resolved")
def _mix(spark, sf):
    return ent.tier_mix(resolutions(spark, sf))


@query("ent_canonicalise")
def _canonicalise(spark, sf):
    place = F.substring("document_name", 5, 20).cast("bigint") * 100_000_000 + F.col("chunk_index") * 10_000 + F.col("i")
    return ent.canonicalise(name_mentions(spark, sf).select("entity_type", respelled().alias("name"), place.alias("seq")))


# ---- graph: capitalised words of every chunk, labelled by length ---------------------------------
cte("spans", f"""
  select chunk_id, document_name, chunk_index, section_id, absolute_page, position, word as name,
         [{", ".join(f"'{x}'" for x in _LABELS)}][1 + length(word) % 8] as label
  from (select *, unnest(words) as word, unnest(range(len(words))) as position
        from (select *, regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}+') as words from chunks))""", "chunks")
cte("mentions", f"select spans.* exclude (label), entity_type from spans join (values {_TYPES}) as t(label, entity_type) using (label)", "spans")
cte("placed", f"""
  select m.*, canonical, 'entity:' || entity_type || ':' || substr(sha256(entity_type || ':' || norm), 1, 16) as node_id, status
  from (select *, {_norm('name')} as norm from mentions) m
  join (select entity_type, {_norm('name')} as norm, min(name) as canonical, case when count(*) > 1 then 'confirmed' else 'unconfirmed_node' end as status
        from mentions group by 1, 2) using (entity_type, norm)""", "mentions")


def spans(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), 0)
    labels = F.array(*[F.lit(x) for x in _LABELS])
    return I.chunks(spark, sf).select(
        "chunk_id", "document_name", "chunk_index", "section_id", "absolute_page", F.posexplode(words).alias("position", "name")
    ).withColumn("label", F.element_at(labels, F.length("name") % 8 + 1))


def placed(spark, sf):
    """Mentions with nodes; a name is confirmed when it occurs again."""
    found = ent.mentions(spans(spark, sf))
    spelled = found.groupBy("entity_type", "name").agg(F.count("*").alias("times")).withColumn("norm", ent.normalized())
    counted = spelled.groupBy("entity_type", "norm").agg(
        F.min("name").alias("canonical"), F.when(F.sum("times") > 1, "confirmed").otherwise("unconfirmed_node").alias("status"))
    table = spelled.drop("times").join(counted, ["entity_type", "norm"]).drop("norm")
    return I.stored(spark, sf, "members", lambda: gr.members(found, table))


def graph_tables(spark, sf):
    rows = placed(spark, sf)
    return gr.Graph(gr.nodes(rows), rows, gr.cooccurrence_rows(rows))


@query("ent_mentions", "select chunk_id, document_name, section_id, absolute_page, position, name, entity_type from mentions", "mentions")
def _mentions(spark, sf):
    return ent.mentions(spans(spark, sf)).drop("chunk_index")


cte("nodes", """
  select node_id, any_value(entity_type) as entity_type, any_value(canonical) as canonical_name, any_value(status) as status,
         count(distinct name) as alias_count, count(distinct chunk_id) as chunk_count
  from placed group by 1""", "placed")


@query("gr_nodes", "select * from nodes", "nodes")
def _nodes(spark, sf):
    return graph_tables(spark, sf).nodes


@query("gr_node_aliases", "select distinct node_id, name from placed", "placed")
def _aliases(spark, sf):
    return gr.aliases(placed(spark, sf))


@query("gr_section_nodes", """
  select 'section:' || substr(sha256(lower(ref)), 1, 16) as node_id, min(ref) as canonical_name, count(*) as reference_count
  from (select unnest(references_sections) as ref from chunks) group by 1""", "chunks")
def _section_nodes(spark, sf):
    return gr.section_nodes(I.chunks(spark, sf))


cte("edge_rows", """
  select distinct a.chunk_id, a.section_id, a.node_id as src, b.node_id as dst
  from (select distinct chunk_id, section_id, node_id from placed) a join (select distinct chunk_id, node_id from placed) b
  on a.chunk_id = b.chunk_id and a.node_id <> b.node_id""", "placed")


@query("gr_cooccurrence_edges", """
  select src, dst, count(distinct chunk_id) as chunk_count, count(distinct section_id) as section_count, 'co_occurrence' as relationship
  from edge_rows group by 1, 2""", "edge_rows")
def _edges(spark, sf):
    return gr.cooccurrence_edges(placed(spark, sf))


@query("gr_cooccurrence_places", "select src, dst, chunk_id, section_id from edge_rows", "edge_rows")
def _edge_places(spark, sf):
    return graph_tables(spark, sf).edges.select("src", "dst", "chunk_id", "section_id")


@query("gr_reference_edges", """
  select node_id as src, dst, count(distinct chunk_id) as chunk_count, count(distinct section_id) as section_count,
         'section_reference' as relationship
  from placed join (select chunk_id, 'section:' || substr(sha256(lower(unnest(references_sections))), 1, 16) as dst from chunks) using (chunk_id)
  group by 1, 2""", "placed", "chunks")
def _reference_edges(spark, sf):
    return gr.edges(gr.reference_rows(placed(spark, sf), I.chunks(spark, sf)), "section_reference")


@query("gr_report", """
  select 'count' as kind, entity_type || '/' || status as name, count(*) as value from nodes group by 2
  union all select 'edges', 'co_occurrence', count(*) from (select distinct src, dst from edge_rows)
  union all select * from (select 'top', node_id, alias_count from nodes where status = 'confirmed' order by alias_count desc, node_id limit 10)""",
       "nodes", "edge_rows")
def _report(spark, sf):
    tables = graph_tables(spark, sf)
    node_rows = gr.nodes(tables.members)
    halves = gr.cooccurrence_halves(tables.members).select("src", "dst").distinct()
    counts = halves.agg((2 * F.count("*")).alias("edges"))
    report = gr.node_report(node_rows, counts).select(
        F.lit("count").alias("kind"), F.concat_ws("/", "entity_type", "status").alias("name"), F.col("nodes").alias("value"))
    top = gr.top_entities(node_rows).select(F.lit("top").alias("kind"), F.col("node_id").alias("name"), F.col("alias_count").alias("value"))
    return report.unionByName(counts.select(F.lit("edges").alias("kind"), F.lit("co_occurrence").alias("name"), F.col("edges").alias("value"))).unionByName(top)


cte("cited_findings", """
  select finding_id, c.chunk_id from fx_findings f join chunks c on c.document_name = f.document_name and c.chunk_index = f.absolute_page""",
    "fx_findings", "chunks")
cte("hubs", """
  select deal_id, finding_id, node_id, count(*) over (partition by deal_id, node_id) as findings_on_node
  from (select distinct f.deal_id, c.finding_id, p.node_id from cited_findings c join placed p using (chunk_id) join fx_findings f using (finding_id))""",
    "cited_findings", "placed", "fx_findings")


@query("gr_finding_hubs", "select * from hubs", "hubs")
def _hubs(spark, sf):
    return finding_hubs(spark, sf)


cte("linked", """
  select distinct a.deal_id, a.finding_id, b.finding_id as linked_id from hubs a join hubs b
  on a.deal_id = b.deal_id and a.node_id = b.node_id and a.finding_id < b.finding_id""", "hubs")
cte("unlinked", """
  select a.deal_id, a.finding_id, b.finding_id as linked_id
  from (select distinct deal_id, finding_id from hubs) a join (select distinct deal_id, finding_id from hubs) b
  on a.deal_id = b.deal_id and a.finding_id < b.finding_id
  except select * from linked""", "hubs", "linked")


@query("gr_finding_links", """
  select *, 'shared_entity' as link from linked
  union all
  select distinct u.deal_id, u.finding_id, u.linked_id, 'edge' from unlinked u
  join hubs a on a.deal_id = u.deal_id and a.finding_id = u.finding_id join hubs b on b.deal_id = u.deal_id and b.finding_id = u.linked_id
  join (select distinct src, dst from edge_rows) e on e.src = a.node_id and e.dst = b.node_id""", "linked", "unlinked", "hubs", "edge_rows")
def _links(spark, sf):
    return gr.finding_links(finding_hubs(spark, sf), gr.cooccurrence_halves(placed(spark, sf)))


@query("gr_finding_edges", """
  select a.deal_id, e.src, e.dst, a.findings_on_node as findings_on_src, b.findings_on_node as findings_on_dst
  from (select distinct src, dst from edge_rows where src < dst) e
  join (select distinct deal_id, node_id, findings_on_node from hubs) a on a.node_id = e.src
  join (select distinct deal_id, node_id, findings_on_node from hubs) b on b.node_id = e.dst and b.deal_id = a.deal_id""", "edge_rows", "hubs")
def _finding_edges(spark, sf):
    return gr.finding_edges(finding_hubs(spark, sf), gr.cooccurrence_halves(placed(spark, sf)))


def finding_hubs(spark, sf):
    tables = graph_tables(spark, sf)
    found = I.findings(spark, sf)
    places = I.chunks(spark, sf).select(
        F.col("chunk_id").alias("citation_chunk_id"), "document_name", F.col("chunk_index").cast("bigint").alias("absolute_page"))
    cited = found.join(places, ["document_name", "absolute_page"]).select("deal_id", "finding_id", "citation_chunk_id")
    return gr.finding_hubs(cited, tables.members)
