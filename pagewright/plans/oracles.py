"""DuckDB SQL for the queries, written from their definitions and not from their plans."""

from __future__ import annotations

from pagewright.operators.assemble import SYSTEM

SQL: dict[str, str] = {}

_SP = r"[\s\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'), ' ')"


def _terms(x: str) -> str:
    return rf"list_transform(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w))"


def _knn(distance: str, where: str = "true") -> str:
    return f"""
with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 20 = 0),
v as (select vec_id, embedding::double[] as e from embeddings where {where}),
d as (select query_id, vec_id, round({distance}, 9) as distance from q, v),
r as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from d)
select query_id, vec_id, rank, round(distance, 6) + 0::double as distance from r where rank <= 40"""


_L2 = "greatest(0, list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_COS = "1 - list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(q.e, lambda z: z * z)) * list_sum(list_transform(v.e, lambda z: z * z)))"
_DOT = "1 - list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))"

SQL["knn_l2"], SQL["knn_cosine"], SQL["knn_dot"] = _knn(_L2), _knn(_COS), _knn(_DOT)
SQL["knn_pivots"] = SQL["knn_l2"]
SQL["knn_tag_filter"] = _knn(_COS, "label = 3")

_CHUNKS = "select doc_id as chunk_index, text, lang as tag from documents"
_TURNS = "select conv_id * 1000 + turn as chunk_index, text, '' as tag from conversations"
_QUESTIONS = "select item_id as query_id, text as query from benchmark"
_WORDS = f"string_split({_collapse('text')}, ' ')"
_VARIANTS = [_QUESTIONS, f"select item_id as query_id, array_to_string({_WORDS}[1:8], ' ') as query from benchmark", f"select item_id as query_id, array_to_string({_WORDS}[greatest(len({_WORDS}) - 7, 1):], ' ') as query from benchmark"]


def _bm25(p: str, questions: str, chunks: str, k: int, keep: str = "true") -> str:
    """CTEs that end in {p}hits(query_id, chunk_index, score, store_rank, rank)."""
    return f"""
{p}c as ({chunks}), {p}t as (select chunk_index, {_terms('text')} as w from {p}c),
{p}s as (select count(*) as n, avg(len(w)) as avgdl from {p}t),
{p}p as (select chunk_index, dl, term, count(*) as tf from (select chunk_index, len(w) as dl, unnest(w) as term from {p}t) group by all),
{p}i as (select term, greatest(0.0::double, ln(n - count(*) + 0.5) - ln(count(*) + 0.5)) as idf from {p}p, {p}s group by term, n),
{p}a as (select query_id, term, count(*) as qtf from (select query_id, unnest({_terms('query')}) as term from ({questions})) group by all),
{p}x as (select query_id, chunk_index, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) as score
  from {p}a join {p}i using (term) join {p}p using (term), {p}s group by all having score > 0),
{p}r as (select query_id, chunk_index, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_index)::int as store_rank from {p}x),
{p}k as (select r.*, row_number() over (partition by query_id order by store_rank)::int as rank from {p}r r join {p}c using (chunk_index) where {keep}),
{p}hits as (select * from {p}k where rank <= {k})"""


SQL["token_count"] = r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint as tokens from documents"
SQL["bm25_terms"] = f"select term, count(*) as occurrences from (select unnest({_terms('text')}) as term from documents) group by term"
SQL["shorten_text"] = f"""
with c as (select doc_id, {_collapse('text')} as t from documents)
select doc_id, case when length(t) > 220 then left(t, 220) || '...' else t end as short,
       case when length(t) > 120 then rtrim(left(t, 120), ' ') || '...' else t end as label from c"""
SQL["md_completeness"] = r"""
with c as (select doc_id, replace(replace(text, '\```', ''), '\**', '') as t from documents)
select doc_id, len(regexp_extract_all(t, '```')) % 2 = 1 or len(regexp_extract_all(t, '\*\*')) % 2 = 1 as issue from c"""
SQL["sha_ids"] = f"""
select doc_id, sha256(text) as source_sha256, 'Doc' || doc_id || '-' || left(sha256(lower('/docs/' || lang || '/Doc' || doc_id || '.md')), 12) as document_id,
       sha256({_strip('text')}) as question_hash from documents"""
SQL["bm25_topk"] = f"with {_bm25('', _QUESTIONS, _CHUNKS, 40)} select query_id, chunk_index, rank, round(score, 6) as score from hits"
SQL["bm25_idf"] = f"""
with t as (select doc_id, {_terms('text')} as w from documents), n as (select count(*) as n from t),
d as (select term, count(*) as df from (select distinct doc_id, unnest(w) as term from t) group by term)
select term, df, round(round(greatest(0.0::double, ln(n - df + 0.5) - ln(df + 0.5)), 9), 6) as idf from d, n"""
_TAGGED = _bm25("", _QUESTIONS, _CHUNKS, 40, "tag = 'de'")
SQL["bm25_tag_postfilter"] = f"with {_TAGGED} select query_id, chunk_index, store_rank, rank, round(score, 6) as score from hits"
_THREE = ",".join(_bm25(p, v, _CHUNKS, 40) for p, v in zip("xyz", _VARIANTS, strict=True))
_FUSE = "round(sum(1.0::double / (60 + rank)), 12) as rrf"
SQL["rrf_multi_query"] = f"""
with {_THREE},
lists as (select query_id, chunk_index, rank, score from xhits union all select query_id, chunk_index, rank, score from yhits union all select query_id, chunk_index, rank, score from zhits),
m as (select query_id, chunk_index as key, {_FUSE}, min(rank) as bm25_rank, max(score) as s from lists group by all),
o as (select *, row_number() over (partition by query_id order by rrf desc, bm25_rank, key)::int as rank from m)
select query_id, key, round(rrf, 9) as rrf_score, bm25_rank, round(s, 6) as bm25_score, rank from o where rank <= 20"""


def _item_knn(p: str, shift: int, distance: str) -> str:
    return f"""
{p}q as (select item_id as query_id, embedding::double[] as e from benchmark join embeddings on vec_id = item_id + {shift}),
{p}v as (select vec_id, embedding::double[] as e from embeddings),
{p}d as (select query_id, vec_id, round({distance}, 9) as distance from {p}q q, {p}v v),
{p}r as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from {p}d),
{p}near as (select * from {p}r where rank <= 40)"""


SQL["rrf_hybrid"] = f"""
with {_bm25('', _QUESTIONS, _CHUNKS, 40)}, {_item_knn('n', 0, _COS)},
lists as (select query_id, vec_id as key, rank, rank as vr, null::int as br, distance from nnear
  union all select query_id, chunk_index, rank, null, rank, null from hits),
m as (select query_id, key, {_FUSE}, min(vr) as vector_rank, min(br) as bm25_rank, min(distance) as distance,
  array_to_string(list_filter([case when min(vr) is not null then 'vector' end, case when min(br) is not null then 'bm25' end], lambda x: x is not null), ',') as sources from lists group by query_id, key),
o as (select *, row_number() over (partition by query_id order by rrf desc, coalesce(vector_rank, 1000000000), coalesce(bm25_rank, 1000000000), key)::int as rank from m)
select query_id, key, round(rrf, 9) as rrf_score, vector_rank::double as vector_rank, bm25_rank::double as bm25_rank, round(distance, 6) as distance, sources, rank from o where rank <= 40"""
SQL["distance_merge"] = f"""
with {_item_knn('a', 0, _L2)}, {_item_knn('b', 1, _L2)},
u as (select query_id, vec_id as key, distance, rank, 0 as l from anear union all select query_id, vec_id, distance, rank, 1 from bnear),
f as (select *, row_number() over (partition by query_id, key order by distance, rank, l) as n from u),
o as (select *, row_number() over (partition by query_id order by distance, rank, l, key)::int as merged_rank from f where n = 1)
select query_id, key, round(distance, 6) as distance, merged_rank from o where merged_rank <= 40"""
_PAGES = "select conv_id * 1000 + turn as chunk_index, conv_id::varchar as document_id, (turn // 2 + 1)::int as page_start from conversations"
SQL["page_collapse"] = f"""
with {_bm25('', _QUESTIONS, _TURNS, 40)}, g as ({_PAGES}),
f as (select *, row_number() over (partition by query_id, document_id, page_start order by rank) as n from hits join g using (chunk_index)),
o as (select *, row_number() over (partition by query_id order by rank)::int as page_rank from f where n = 1)
select query_id, document_id, page_start, chunk_index, page_rank from o where page_rank <= 8"""
SQL["candidate_limit"] = f"""
with {_bm25('', _QUESTIONS, _TURNS, 40)}, g as ({_PAGES}),
f as (select *, row_number() over (partition by query_id, document_id, page_start order by rank) as n from hits join g using (chunk_index) where rank <= 10)
select query_id, count(*) as pages, max(rank) as last_rank from f where n = 1 group by query_id"""
_CP = "select conv_id, (turn + 1)::int as page_number, text as markdown from conversations"
SQL["pages_join"] = f"""
select conv_id, string_agg('<!-- PAGE ' || page_number || ' -->' || chr(10) || chr(10) || {_strip('markdown')}, chr(10) || chr(10) order by page_number) || chr(10) as markdown
from ({_CP}) group by conv_id"""
SQL["page_split"] = f"select conv_id, page_number, {_strip('markdown')} as markdown from ({_CP})"
SQL["context_window4"] = f"""
with p as (select conv_id, page_number, row_number() over (partition by conv_id order by page_number) - 1 as i, count(*) over (partition by conv_id) as n from ({_CP})),
w as (select *, least(4, n) as size, greatest(0, least(i - least(4, n) // 2, n - least(4, n))) as start from p)
select w.conv_id, w.page_number, string_agg(q.page_number::varchar, ',' order by q.i) as context
from w join p q on q.conv_id = w.conv_id and q.i >= w.start and q.i < w.start + w.size group by w.conv_id, w.page_number"""
SQL["chunk_index_global"] = f"select conv_id, page_number, row_number() over (order by conv_id, page_number) - 1 as chunk_index from ({_CP})"
_EQ = "select conv_id * 1000 + turn as query_id, conv_id, text as query from conversations where conv_id % 20 = 0 and role = 'user'"
_EXP = f"select query_id, conv_id::varchar as document_id, (c.turn + 1)::int as page from ({_EQ}) q join conversations c using (conv_id) where c.role = 'assistant'"
_SCORED = f"""
{_bm25('', _EQ, _TURNS, 5)}, e as (select distinct * from ({_EXP})), ec as (select query_id, count(*) as expected_count from e group by query_id),
h as (select hits.query_id, rank, c.conv_id::varchar as document_id, (c.turn + 1)::int as page from hits join conversations c on c.conv_id * 1000 + c.turn = chunk_index),
j as (select h.*, e.page is not null as hit from h left join e using (query_id, document_id, page)),
f as (select query_id, count(*) as retrieved_count, count(distinct case when hit and rank = 1 then page end) as relevant_at_1,
  count(distinct case when hit then page end) as relevant_at_k, min(case when hit then rank end) as first_relevant_rank, count(*) filter (not hit) as false_positives from j group by query_id),
scored as (select query_id, expected_count, coalesce(retrieved_count, 0) as retrieved_count, coalesce(relevant_at_1, 0) as relevant_at_1, coalesce(relevant_at_k, 0) as relevant_at_k,
  first_relevant_rank, coalesce(false_positives, 0) as false_positives, case when first_relevant_rank = 1 then 1.0::double else 0.0::double end as hit_at_1,
  case when first_relevant_rank is not null then 1.0::double else 0.0::double end as hit_at_k, round(coalesce(relevant_at_1, 0)::double / expected_count, 9) as recall_at_1,
  round(coalesce(relevant_at_k, 0)::double / expected_count, 9) as recall_at_k, round(coalesce(relevant_at_k, 0)::double / 5, 9) as precision_at_k,
  round(coalesce(1.0::double / first_relevant_rank, 0.0::double), 9) as mrr_at_k, first_relevant_rank is null as failure from ec left join f using (query_id))"""
SQL["score_retrieval"] = f"with {_SCORED} select * replace (first_relevant_rank::double as first_relevant_rank) from scored"
SQL["aggregate_metrics"] = f"""
with {_SCORED} select count(*) as questions, {', '.join(f'round(avg({m}), 6) as {m}' for m in ('hit_at_1', 'hit_at_k', 'recall_at_1', 'recall_at_k', 'precision_at_k', 'mrr_at_k'))},
sum(false_positives)::bigint as false_positives, count(*) filter (failure) as failures, 0::bigint as errors, round(avg((query_id % 997)::double), 6) as mean_latency_ms,
quantile_disc((query_id % 997)::double, 0.95) as p95_latency_ms from scored"""
SQL["latency_percentiles"] = "select event_type, count(*) as n, round(avg(value), 6) as mean_value, quantile_disc(value, 0.95) as p95_value from events group by event_type"
_QP = """
q as (select conv_id * 1000 + turn as id, conv_id, text as question from conversations where role = 'user'),
p as (select distinct id, conv_id::varchar as document_id, (c.turn + 1)::int as page from q join conversations c using (conv_id) where c.role = 'assistant')"""
SQL["questions_with_pages"] = f"""
with {_QP} select id, question, coalesce(string_agg(document_id || ':' || page || ':/c' || document_id, ',' order by document_id, page), '') as pages from q left join p using (id) group by id, question"""
_ESC = r"""replace(replace(replace(replace(replace({}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
_ITEMS = f"""
{_QP}, g as (select id, question, coalesce(string_agg('{{"document_id": "' || document_id || '", "page": ' || page || '}}', ', ' order by document_id, page), '') as pages from q left join p using (id) group by id, question),
i as (select id, '{{"id": ' || id || ', "question": "' || {_ESC.format('question')} || '", "relevant_pages": [' || pages || ']}}' as item from g)"""
SQL["active_dataset_hash"] = f"with {_ITEMS} select id, sha256(item) as item_sha256 from i"
SQL["dataset_hash"] = f"with {_ITEMS} select sha256('[' || string_agg(item, ', ' order by id) || ']') as dataset_hash from i"
SQL["unique_name_antijoin"] = """
with w as (select distinct upper(source) || case when lang = 'en' then ' ' else '-' || lang end as name from documents)
select name from w where lower(trim(name)) not in (select lower(trim(source)) from documents where lang = 'en')"""
SQL["variants_upsert"] = """
select question_sha256, prompt_version, variants, created_at from (
  select sha256(role) as question_sha256, turn::varchar as prompt_version, text as variants, conv_id as created_at, row_number() over (partition by role, turn order by conv_id desc) as n from conversations) where n = 1"""
SQL["delete_cascade"] = "select l_orderkey as evaluation_id, count(*) as results from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey"
SQL["results_csv_rows"] = f"""
with {_SCORED}, shown as (select query_id, string_agg('c' || document_id || ' p.' || page, '; ' order by page) as e from e group by query_id),
got as (select query_id, string_agg('c' || document_id || ' p.' || page, '; ' order by rank) as r from h group by query_id)
select query_id as id_pregunta, query as pregunta, e as "páginas_esperadas", coalesce(r, '') as "páginas_recuperadas", first_relevant_rank::double as "posición_primer_relevante",
  recall_at_1 as recall_1, recall_at_k as recall_k, precision_at_k as "precisión_k", mrr_at_k as mrr_k, false_positives as falsos_positivos, failure as fallo,
  (query_id % 997)::double as latencia_ms, '' as error
from scored join shown using (query_id) left join got using (query_id) join ({_EQ}) using (query_id)"""
_NM = f"select conv_id, turn, {_strip('role')} as role, {_strip('text')} as text from conversations where {_strip('role')} <> '' and {_strip('text')} <> ''"
SQL["query_build_contextual"] = f"""
with u as (select *, lag(text) over (partition by conv_id order by turn) as previous from ({_NM}) where role = 'user')
select conv_id, turn, 'Previous user question: ' || previous || chr(10) || 'Latest follow-up question: ' || text as query from u where previous is not null"""
SQL["normalize_messages"] = _NM
SQL["context_blocks"] = f"""
with {_bm25('', _QUESTIONS, _CHUNKS, 8)},
blocks as (select query_id, string_agg('[S' || rank || '] ' || source || ' p.1' || chr(10) || text, chr(10) || chr(10) order by rank) as context from hits join documents on doc_id = chunk_index group by query_id)
select query_id, sha256(context) as context_sha256, length(context)::bigint as n_chars from blocks"""
SQL["citations_semi"] = f"""
with {_bm25('', _QUESTIONS, _CHUNKS, 8)} select query_id, 'S' || rank as source_id, chunk_index from hits where rank in (1, 3, query_id % 9)"""
SQL["grounded_answer"] = f"""
with a as (select conv_id, turn, case when turn % 3 = 0 then text || ' [S' || turn || ']' else text end as t from conversations)
select conv_id, turn, case when {_strip('t')} <> '' and len(list_intersect(regexp_extract_all(t, '\\bS\\d+\\b'), ['S1', 'S2', 'S3'])) > 0 then {_strip('t')}
  else 'No consta en los documentos recuperados.' end as answer from a""".replace("\\\\", "\\")
SQL["parse_source_ids"] = """
select conv_id, turn, case when turn % 2 = 0 then 'S' || turn || ',S2,S2' else case when turn = 9 then 'S9' else 'S' || turn || ',S9' end end as ids from conversations"""
_LOSSY = "array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 3 <> 0), chr(10))"
SQL["reference_coverage"] = f"""
with r as (select doc_id, t, count(*) as r from (select doc_id, unnest(list_filter({_terms('text')}, lambda w: length(w) >= 3)) as t from documents) group by all),
m as (select doc_id, t, count(*) as m from (select doc_id, unnest(list_filter({_terms(_LOSSY)}, lambda w: length(w) >= 3)) as t from documents) group by all),
s as (select doc_id, sum(r)::bigint as tokens, sum(least(r, coalesce(m, 0)))::bigint as found from r left join m using (doc_id, t) group by doc_id),
c as (select doc_id, coalesce(tokens, 0) as tokens, coalesce(found, 0) as found from documents left join s using (doc_id))
select doc_id, tokens, found, case when tokens >= 40 then round(found::double / tokens, 6) end as coverage,
       coalesce(case when tokens >= 40 then round(found::double / tokens, 6) end < 0.65, false) as issue from c"""
SQL["cache_pending_antijoin"] = "select distinct conv_id from conversations where not (conv_id % 5 <> 0 and conv_id % 3 <> 0)"
SQL["cache_prefix_resume"] = """
with g as (select conv_id, count(*) as n, list(turn + 1 order by turn) as p from conversations group by conv_id)
select conv_id, n + 1 as next_page from g where conv_id % 3 = 0 and p = range(1, n + 1)"""
SQL["viewer_filter"] = "select doc_id as chunk_index, lang as tag from documents where lang in ('en', 'de') and (contains(lower(text), 'the and') or contains(lower(source), 'the and'))"
SQL["viewer_search"] = SQL["viewer_filter"]
SQL["viewer_page"] = "select doc_id as chunk_index, lang as tag, source from documents order by doc_id limit 25 offset 50"
SQL["facets"] = "select distinct 'source' as facet, source as value from documents where source <> '' union all select distinct 'tag', lang from documents where lang <> ''"
SQL["document_options"] = """
select conv_id::varchar as document_id, case when role <> '' then '[' || role || '] ' else '' end || 'conversation · c/' || conv_id as label
from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n = 1"""
SQL["expected_chunks"] = """
select conv_id::varchar as document_id, (turn // 2 + 1)::int as page_start, sha256(string_agg(text, chr(10) || chr(10) order by turn)) as text_sha256 from conversations group by conv_id, turn // 2"""

SQL["bm25_index_topk"] = SQL["bm25_topk"]


def _retrieved(where: str) -> str:
    """Both lists of a question have its vector, so each vector hit counts once for each list."""
    first8 = f"array_to_string(list_slice({_WORDS}, 1, 8), ' ')"
    asked = f"select item_id as query_id, n as list_no, q as query from (select item_id, {_strip('text')} as a, {_strip(first8)} as b from benchmark join embeddings on vec_id = item_id), lateral (select 0 as n, a as q union all select 1, b where a <> b)"
    chunks = "select doc_id as chunk_index, text, lang as tag from documents"
    lists = f"select query_id * 64 + list_no as query_id, query from ({asked})"
    return f"""
with {_bm25('', lists, chunks, 40, where)},
v as (select vec_id, embedding::double[] as e from embeddings join ({chunks}) c on chunk_index = vec_id where {where}),
q as (select vec_id as query_id, embedding::double[] as e from embeddings join benchmark on vec_id = item_id),
d as (select query_id, vec_id, round({_L2}, 9) as distance from q, v),
near as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) where rank <= 40),
lists as (select query_id, vec_id as key, rank, rank as vr, null::bigint as br from near join (select query_id, list_no from ({asked})) using (query_id)
  union all select query_id // 64, chunk_index, rank, null, rank from hits),
m as (select query_id, key, {_FUSE}, min(vr) as vector_rank, min(br) as bm25_rank from lists group by query_id, key),
o as (select *, row_number() over (partition by query_id order by rrf desc, coalesce(vector_rank, 1000000000), coalesce(bm25_rank, 1000000000), key)::int as page_rank from m)
select query_id, key::varchar as document_id, 1 as page_start, page_rank, round(rrf, 9) as rrf_score from o where page_rank <= 8"""


SQL["retrieve_hybrid"], SQL["retrieve_tagged"] = _retrieved("true"), _retrieved("tag = 'de'")
SQL["retrieval_query_list"] = f"""
with u as (select conv_id * 1000 + turn as query_id, text as t, lag(text) over (partition by conv_id order by turn) as p from conversations where role = 'user'),
l as (select query_id, unnest([0, 1, 2, 3, 4]) as i, unnest([{_strip('t')}, {_strip("'x ' || t")}, {_strip("' ' || t")}, {_strip('lower(t)')},
  case when p is not null then {_strip("'Previous user question: ' || p || chr(10) || 'Latest follow-up question: ' || " + _strip('t'))} end]) as query from u),
f as (select query_id, query, min(i) as i from l where query is not null and query <> '' group by query_id, query)
select query_id, (row_number() over (partition by query_id order by i) - 1)::int as list_no, query from f"""
SQL["instructed_queries"] = "select item_id as query_id, 'Instruct: Find the page that answers' || chr(10) || 'Query: ' || text as query, text as plain from benchmark"
_EIGHT = f"""
{_bm25('', _QUESTIONS, _TURNS, 40)}, g as ({_PAGES}),
f as (select *, row_number() over (partition by query_id, document_id, page_start order by rank) as n from hits join g using (chunk_index)),
eight as (select * from (select *, row_number() over (partition by query_id order by rank)::int as page_rank from f where n = 1) where page_rank <= 8)"""
SQL["serialized_matches"] = f"""
with {_EIGHT} select query_id, page_rank as rank, document_id, 'c' || document_id as source, '' as source_path, page_start as page, 0 as page_chunk_index, '' as tag, 't' || chunk_index as text,
  null::double as distance, null::double as vector_score, round(score, 6) as bm25_score, null::double as rrf_score, 'bm25' as retrieval_sources from eight"""
SQL["matches_json"] = f"""
with {_EIGHT}, m as (select query_id, page_rank, struct_pack(rank := page_rank, document_id := document_id, source := 'c' || document_id, source_path := '', page := page_start, page_chunk_index := 0, tag := '', text := 't' || chunk_index,
  distance := null::double, vector_score := null::double, bm25_score := round(score, 6), rrf_score := null::double, retrieval_sources := ['bm25']) as m from eight)
select query_id, to_json(list(m order by page_rank))::varchar as matches from m group by query_id"""
SQL["source_options"] = f"""
with {_EIGHT} select query_id, 'S' || page_rank as source_id, document_id, 'c' || document_id as source, page_start, page_start as page_end, chunk_index, null::varchar as tag, 't' || chunk_index as text from eight"""
SQL["used_source_ids"] = """
select conv_id, turn, case when turn in (1, 4) then 'S' || turn || ',S2' else 'S2' end as ids from conversations"""
_TEXT = _strip("text")
SQL["truncated_text"] = rf"select doc_id, case when length({_TEXT}) > 2500 then regexp_replace(left({_TEXT}, 2500), '{_SP}+$', '') || '...' else {_TEXT} end as text from documents"
SQL["response_markdown"] = """
select doc_id, case when doc_id % 4 >= 2 then '"' || source || '" **' end as markdown, case when doc_id % 4 >= 2 and doc_id % 7 <> 0 then '"' || source || '"' end as accepted from documents"""
SQL["tag_choice"] = "select doc_id, case when doc_id % 3 = 0 then source else lang end as tag from documents"
SQL["vector_scores"] = "select vec_id, case when label = 9 then 0::double else round(1 / (1 + greatest(label - 3, 0)::double), 9) end as score from embeddings"
SQL["viewer_rows"] = f"""
with c as (select *, {_collapse('text')} as t, {SQL["token_count"].split(" as tokens")[0].removeprefix("select doc_id, ")} as n from documents)
select source as document, 'md' as source_type, lang as tag, 1 as page, 0 as page_chunk_index, n as tokens, 'direct-markdown' as model, '/' || doc_id as source_path,
  case when length(t) > 220 then left(t, 220) || '...' else t end as text from c"""
SQL["hit_diagnostics"] = f"""
with {_EIGHT} select query_id, page_rank, 'sources=bm25 · bm25 rank=' || rank || printf(' · bm25=%.6f', case when rank % 2 = 0 then 0 else round(score, 6) end) as scores from eight"""
SQL["question_rows"] = f"""
with {_QP} select id, true as active, question, '' as category, coalesce(string_agg('c' || document_id || ' p.' || page, ', ' order by document_id, page), '') as pages from q left join p using (id) group by id, question"""
SQL["question_counts"] = "select count(*) as questions, count(*) filter ((conv_id * 1000 + turn) % 3 <> 0) as active from conversations where role = 'user'"
SQL["failed_questions"] = f"with {_SCORED} select query_id, failure, case when query_id % 7 = 0 then 'x' else '' end as error from scored where failure or query_id % 7 = 0"
SQL["doctor_verdict"] = "select doc_id % 50 as report, bool_and(quality = 1 or toxic <> 1) as healthy from labels group by doc_id % 50"
SQL["event_lines"] = """
with a as (select 's' || (conv_id * 1000 + turn) as session_id, text, turn % 2 = 0 as f from conversations where role = 'assistant'),
l as (select session_id, unnest(list_concat([json_object('type', 'session', 'session_id', session_id)::varchar], list_concat(case when f then [json_object('type', 'fallback', 'reason', 'the model gave no answer')::varchar] else [] end,
  [json_object('type', 'answer', 'delta', text)::varchar, '{"type":"citations","citations":["S1","S2"]}', '{"type":"matches","matches":[{"rank":1}]}', '{"type":"done"}']))) as event,
  unnest(range(0, case when f then 6 else 5 end)) as seq from a)
select session_id, seq::int as seq, event from l"""
SQL["cache_manifests"] = """
select sha256(conv_id::varchar) as source_sha256, string_agg((turn + 1)::varchar, ',' order by turn) as page_numbers,
  coalesce(string_agg((turn + 1) || ':' || role, ',' order by (turn + 1)::varchar) filter (turn % 3 = 2), '') as failed, (4 + conv_id % 3)::int as total_pages, count(*) = 4 + conv_id % 3 as complete
from conversations group by conv_id"""
SQL["document_totals"] = "select count(distinct conv_id) as documents, count(*) as pages from conversations"
SQL["preview_requests"] = """
with n as (select conv_id, max(turn + 1) as n from conversations group by conv_id),
r as (select conv_id, n, unnest([n, 1, n, 99, 2]) as page_number, unnest([0, 1, 2, 3, 4]) as i from n),
f as (select conv_id, n, page_number, min(i) as i from r group by all),
o as (select *, (row_number() over (partition by conv_id order by i) - 1)::int as position from f)
select o.conv_id, position, page_number::int as page_number, exists (select 1 from conversations c where c.conv_id = o.conv_id and c.turn + 1 = o.page_number) as valid from o"""
SQL["iso_times"] = "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as iso from events"
SQL["answer_prompts"] = f"""
with t as (select conv_id, turn, {_strip('role')} as role, {_strip('text')} as content, text, max(turn) over (partition by conv_id) as last from conversations),
h as (select *, turn = last and role = 'user' as said from t where role <> '' and content <> ''),
g as (select conv_id, count(*) filter (not said) + 2 as messages, coalesce(string_agg(role || ':' || content, '|' order by turn) filter (not said), '') as past from h group by conv_id)
select g.conv_id, messages, sha256('system:' || '{SYSTEM["answer"].replace("'", "''")}' || '|' || case when past = '' then '' else past || '|' end || 'user:Context:' || chr(10) || '[S1] a p.1' || chr(10) || chr(10) || 'Question:' || chr(10) || t.text) as prompt_sha256
from g join t on t.conv_id = g.conv_id and t.turn = t.last"""


def _bm25_pages() -> str:
    first8 = f"array_to_string(list_slice({_WORDS}, 1, 8), ' ')"
    asked = f"select item_id as query_id, n as list_no, q as query from (select item_id, {_strip('text')} as a, {_strip(first8)} as b from benchmark), lateral (select 0 as n, a as q union all select 1, b where a <> b)"
    return f"""
asked as ({asked}), {_bm25('', 'select query_id * 64 + list_no as query_id, query from asked', _CHUNKS, 40)},
m as (select query_id // 64 as query_id, chunk_index as key, {_FUSE}, min(rank) as br from hits group by query_id // 64, chunk_index),
o as (select *, row_number() over (partition by query_id order by rrf desc, br, key) as r from m),
pages as (select o.*, source, text from o join documents on doc_id = key where r <= 8),
blocks as (select query_id, string_agg('[S' || r || '] ' || source || ' p.1' || chr(10) || text, chr(10) || chr(10) order by r) as context, string_agg(key::varchar, ',' order by r) as documents from pages group by query_id)"""


SQL["generation_inputs"] = f"""
with {_bm25_pages()}, n as (select query_id, count(*) as queries from asked group by query_id)
select query_id, queries, sha256(coalesce(context, '')) as context_sha256, coalesce(documents, '') as documents from n left join blocks using (query_id)"""
SQL["asked"] = f"""
with {_bm25_pages()}, prompts as (select item_id as query_id, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || text as prompt, documents from benchmark left join blocks on query_id = item_id),
cites as (select prompts.query_id, string_agg('S' || r || '=' || key, ',' order by r) as cited from prompts join pages using (query_id) where length(prompt) % 2 = 1 and r in (1, 3) group by prompts.query_id)
select query_id, case when cited is not null then 'yes' else 'No consta en los documentos recuperados.' end as answer, coalesce(cited, '') as citations from prompts left join cites using (query_id)"""
_BULLET = r"regexp_replace(regexp_replace(x, '^" + _SP + r"*(?:[-*]|\d+[.)])" + _SP + r"*', ''), '^[ \t\"'']+|[ \t\"'']+$', '', 'g')"
SQL["parse_variants"] = f"""
with q as (select item_id as query_id, text as query, array_to_string(list_slice({_WORDS}, 1, 8), ' ') as a, array_to_string(list_slice({_WORDS}, greatest(len({_WORDS}) - 7, 1), len({_WORDS})), ' ') as b from benchmark),
l as (select query_id, query, regexp_split_to_array('- ' || query || chr(10) || '1. ' || a || chr(10) || '* ' || upper(a) || chr(10) || '- ' || b, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]') as l from q),
x as (select query_id, query, unnest(l) as x, unnest(range(len(l))) as i from l),
c as (select query_id, i, {_collapse(_BULLET)} as v, lower({_strip('query')}) as asked from x),
f as (select *, row_number() over (partition by query_id, lower(v) order by i) as n from c where v <> '' and lower(v) <> asked),
o as (select *, row_number() over (partition by query_id order by i) as r from f where n = 1)
select item_id as query_id, coalesce(string_agg(v, '|' order by r) filter (r <= 2), '') as variants from benchmark left join o on query_id = item_id group by item_id"""
_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
#: The chunking fold: a state for each page (lines i of n, held lines from s on, their tokens, new ones, chunks so far).
SQL["chunk_pages"] = rf"""
with recursive d as (
  select doc_id::varchar as document_id, sha256(text) as sha, regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85])$', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]') as l from documents where text <> ''
), t as (
  select document_id, sha, l, list_transform(l, lambda x: {_TOKENS.format('x')}) as n, list_transform(l, lambda x: {_strip('x')} = '') as blank, list_transform(l, lambda x: starts_with({_strip('x')}, '#')) as head from d
), c as (
  select *, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::bigint)) as upto from t
), f as (
  select document_id, 0::bigint as i, 1::bigint as s, 0::bigint as fresh, 0::bigint as done, []::struct(a bigint, b bigint, big boolean)[] as out from c
  union all
  select document_id, i, s, fresh, done + len(out), out from (
    select document_id, i, big, blank,
      case when big then i + 1 when closes_after then t3 else s2 end as s, case when big or closes_after then 0 else fresh2 + 1 end as fresh, done,
      list_filter([case when big and i > s0 and not b0 and (fresh0 > 0 or done = 0) then struct_pack(a := s0, b := i - 1, big := false) end,
        case when closes1 and not b0 and (fresh0 > 0 or done = 0) then struct_pack(a := s0, b := i - 1, big := false) end,
        case when closes2 and not b1 and (fresh1 > 0 or done + (closes1 and not b0 and (fresh0 > 0 or done = 0))::int = 0) then struct_pack(a := s1, b := i - 1, big := false) end,
        case when big then struct_pack(a := i, b := i, big := true) end,
        case when closes_after and not b2 then struct_pack(a := s2, b := i, big := false) end], lambda x: x is not null) as out
    from (
      select *, not big and blank and upto[i + 1] - upto[s2] >= 700 as closes_after, list_bool_and(blanks[s2:i]) as b2,
        coalesce(list_filter(range(s2, i + 1), lambda x: upto[i + 1] - upto[x] <= 100)[1], i + 1) as t3
      from (
        select *, case when closes2 then case when upto[i + 1] - upto[t2] > 900 then i else t2 end else s1 end as s2, case when closes2 then 0 else fresh1 end as fresh2
        from (
          select *, not big and i > s1 and upto[i + 1] - upto[s1] > 900 as closes2, i = s1 or list_bool_and(blanks[s1:i - 1]) as b1,
            coalesce(list_filter(range(s1, i), lambda x: upto[i] - upto[x] <= 100)[1], i) as t2
          from (
            select *, case when closes1 then t1 else s0 end as s1, case when closes1 then 0 else fresh0 end as fresh1
            from (
              select c.document_id, f.i + 1 as i, f.s as s0, f.fresh as fresh0, f.done, c.upto, c.blank as blanks, c.blank[f.i + 1] as blank, c.n[f.i + 1] > 900 as big,
                c.n[f.i + 1] <= 900 and f.i + 1 > f.s and c.head[f.i + 1] and c.upto[f.i + 1] - c.upto[f.s] >= 700 as closes1, f.i + 1 = f.s or list_bool_and(c.blank[f.s:f.i]) as b0,
                coalesce(list_filter(range(f.s, f.i + 1), lambda x: c.upto[f.i + 1] - c.upto[x] <= 100)[1], f.i + 1) as t1
              from f join c using (document_id) where f.i < len(c.l)))))))
), e as (
  select document_id, i, unnest(out) as o, unnest(range(len(out))) as k from f
  union all select f.document_id, f.i + 1, struct_pack(a := f.s, b := f.i, big := false), 0 from f join c using (document_id)
  where f.i = len(c.l) and f.s <= f.i and not list_bool_and(c.blank[f.s:f.i]) and (f.fresh > 0 or f.done = 0)
), r as (
  select e.document_id, sha, (row_number() over (partition by e.document_id order by e.i, k) - 1)::int as page_chunk_index, {_strip("array_to_string(l[o.a:o.b], chr(10))")} as text, (upto[o.b + 1] - upto[o.a])::int as token_count, o.big as oversize
  from e join c using (document_id)
)
select sha256('{{"document_id": "' || document_id || '", "page": 1, "page_chunk_index": ' || page_chunk_index || ', "schema_version": 3, "source_sha256": "' || sha || '", "text": "' || {_ESC.format('text')} || '"}}') as chunk_id,
  document_id, 1 as page_start, page_chunk_index, text, token_count, oversize from r"""

SQL["index_of_a_tag"] = "select doc_id as chunk_index, doc_id::varchar as document_id, lang as tag, sha256(text) as source_sha256, 3 as schema_version from documents where lang = 'de'"

SQL["streamed_terms"] = f"""
select term, count(*) as df from (
  select distinct doc_id, unnest({_terms("case when lang = 'de' then source || chr(10) || text else text end")}) as term from documents where lang <> 'fr'
) group by term"""

SQL["extraction_rounds"] = f"""
with t as (select conv_id::varchar as document_id, (row_number() over (partition by conv_id order by turn))::int as page_number, text, count(*) over (partition by conv_id) as n from conversations)
select document_id, page_number, length(text) % 7 = 0 as failed, sha256(case when length(text) % 7 = 0 then '' else {_strip('text')} end) as markdown_sha256 from t"""

SQL["contextual_flags"] = f"""
select conv_id, turn, contains(text, 'Previous user question:') or contains(text, 'Latest follow-up question:') as plain, true as with_previous from conversations
where (conv_id, turn) in (select (conv_id, turn) from ({SQL["query_build_contextual"]}))"""

SQL["embedded_chunks"] = "select doc_id as chunk_index, length(text)::double as characters, (length(text) - length(replace(text, ' ', '')))::double as blanks from documents"

SQL["over_budget_documents"] = "select conv_id::varchar as document_id, count(*) as pages from conversations group by conv_id having count(*) > 5"

SQL["imported_questions"] = f"""
with {_QP} select id as query_id, {_strip('question')} as question, true as active, string_agg(document_id || ':' || page, ',' order by document_id, page) as pages
from q join p using (id) group by id, question"""

SQL["evaluation_run"] = SQL["score_retrieval"]
