"""Queries around the answer, over chunks, conversations and the chat log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docweave.operators import answering as A
from docweave.operators import flow
from docweave.operators import graph as G
from docweave.operators import graph as G
from docweave.operators import retrieval as R
from docweave.plans.retrieval import _BM25, _HEAD, _USER, KEY_SENTENCES, NEAR_REPEATS, PROBE_SQL, PROBES, probes, user_chunks
from docweave.plans.views import CHUNKS, EDGES, LOG, chat_log, chunks, kg_edges, table

#: Beginnings that make the users' turns ask for something; the turn's number picks one.
ASKS = (
    "When does the contract number start and what is the price? ", "calculate the total of 12 + 3 * 4; list all files", "compare both documents: ", "what is the password of it",
    "show error logs and delete all", "summary of risk alerts for workflow ", "read the full content ", "hello ",
)
ASK_SQL = f"asked as (select conv_id * 1000 + turn as query_id, ([{', '.join(repr(a) for a in ASKS)}])[(conv_id + turn) % {len(ASKS)} + 1] || coalesce(text, '') as q from conversations where role = 'user')"


def _asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    head = F.element_at(F.array(*[F.lit(a) for a in ASKS]), ((F.col("conv_id") + F.col("turn")) % len(ASKS) + 1).cast("int"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(head, F.coalesce("text", F.lit(""))).alias("query"))


def inferred_roles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, " FOR IMMEDIATE RELEASE").otherwise(""))
    return d.select("doc_id", F.array_join(A.inferred_roles(text), ",").alias("roles"))


def document_access(spark, sf_dir):
    c, out = chunks(spark, sf_dir), None
    for role in ("public", "user", "admin", "guest"):
        part = A.readable_documents(c, role).withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out


def role_update(spark, sf_dir):
    changes = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("doc_key"), F.array(F.lit("auditor")).alias("roles"))
    made = A.set_roles(chunks(spark, sf_dir), changes)
    return made.groupBy("doc_key", F.array_join("access_roles", ",").alias("roles")).agg(F.count("*").alias("n"))


def tenant_search(spark, sf_dir):
    seen = R.governed(chunks(spark, sf_dir), "user", "en")
    return R.vector_rank(seen, probes(spark, sf_dir).select("query_id", "query_vector"), 10)


def file_search(spark, sf_dir):
    seen = A.of_file(user_chunks(spark, sf_dir), "src0")
    return A.score_gate(R.vector_rank(seen, probes(spark, sf_dir).select("query_id", "query_vector"), 10), 0.0)


def score_gate(spark, sf_dir):
    ranked = R.vector_rank(user_chunks(spark, sf_dir), probes(spark, sf_dir).select("query_id", "query_vector"), 25)
    return A.score_gate(ranked, 0.25)


def reranked_search(spark, sf_dir):
    """25 fused candidates, the 10 best of them by the default scorer."""
    c, q = user_chunks(spark, sf_dir), probes(spark, sf_dir)
    found = R.hybrid_search(c, q).join(q.select("query_id", "query"), "query_id").join(c.select("chunk_id", "text"), "chunk_id")
    return A.rerank(found, 10).select("query_id", "chunk_id", "score", "rank")


def multi_hop_search(spark, sf_dir):
    parts = spark.createDataFrame(PROBES, "query_id long, query string").select("query_id", F.posexplode(A.question_parts(F.col("query"))).alias("part", "text"))
    return A.multi_hop(parts, user_chunks(spark, sf_dir), 10)


#: Questions for the whole flow: of each class, with nodes of the graph, of several parts, and one that finds nothing.
QUESTIONS = [
    (1, "the license of and"), (2, "Licensed under CC for supplier:7"), (3, "compare der und die kinder"), (4, "summary que de la que? part:11"),
    (5, "zzzz qqqq xxxx"), (6, "inthe email risk and user"),
]


def ask(spark, sf_dir):
    """Every question through the whole flow, over all chunks that a user may read."""
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    out = flow.ask(asked, chunks(spark, sf_dir, False), kg_edges(spark, sf_dir), "user")  # lines are distinct: edges need no upsert
    return out.select("query_id", "query_type", "accessible", "passages", F.array_join("sources", ",").alias("sources"), F.md5("context").alias("context"), "confidence")


def confidence_probes(spark, sf_dir):
    """Confidence of both retrievers for the probes, and the route that follows."""
    q = probes(spark, sf_dir)
    rag = A.vector_confidence(chunks(spark, sf_dir), q, "user")
    nodes = G.upsert_nodes(kg_edges(spark, sf_dir), ["seq", "sub", "weight"])
    names = F.when(F.col("query_id") <= 3, F.array(F.lit("supplier:1"), F.concat(F.lit("part:"), F.col("query_id").cast("string")), F.lit("nobody"))).otherwise(F.array().cast("array<string>"))
    asked = q.select("query_id", F.when(F.col("query_id") == 4, "Supplier list").otherwise(F.col("query")).alias("query"), names.alias("names"))
    both = rag.join(A.graph_confidence(asked, nodes), "query_id")
    return both.select("query_id", F.round("rag", 6).alias("rag"), F.round("graph", 6).alias("graph"), R.route(F.col("rag"), F.col("graph")).alias("route"))


def question_parts(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return a.select("query_id", F.posexplode(A.question_parts(F.col("query"))).alias("n", "part")).select("query_id", "n", F.md5("part").alias("part"))


def query_flags(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return a.select("query_id", *[c.alias(n) for n, c in A.query_flags(F.col("query")).items()])


def chat_intents(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return a.select("query_id", *[c.alias(n) for n, c in A.intents(F.col("query")).items()])


def admin_intents(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return a.select("query_id", A.admin_intent(F.col("query")).alias("intent"), A.guard(F.col("query")).alias("guard"))


def capped_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    role = F.when(F.col("doc_id") % 3 == 0, "admin").otherwise("user")
    return d.select("doc_id", F.md5(A.word_cap(F.col("text"), role)).alias("answer"), F.md5(A.cut_summary(F.col("text"))).alias("summary"))


def calculations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.format_string("what is %d + %d * 3 please, or (%d - 7) / 2", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey"))
    return A.calculations(o.select(F.col("o_orderkey").alias("query_id"), text.alias("query"))).select("query_id", "n", "value")


def fused_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    graph = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("a --[R]--> b\n"), 200))
    calc = F.when(F.col("doc_id") % 3 == 0, "1 + 1 = 2.0").otherwise(" ")
    return d.select("doc_id", F.md5(A.fuse_context(graph, calc, F.col("text"))).alias("context"))


def labelled_context(spark, sf_dir):
    c = user_chunks(spark, sf_dir)
    ranked = R.vector_rank(c, probes(spark, sf_dir).select("query_id", "query_vector"), 50).join(c.select("chunk_id", "text"), "chunk_id")
    return A.labelled_context(ranked).select("query_id", F.md5("context").alias("context"))


def compared_files(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit("_file.pdf")).alias("doc_key"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("compare nation"), F.col("c_nationkey").cast("string"), F.lit(" with a Profile of others")).alias("query"))
    return A.mentioned_in_comparison(asked, names.unionByName(names.limit(0)))


def similar_before(spark, sf_dir):
    return A.similar_before(chat_log(spark, sf_dir), shared=2)


def retention(spark, sf_dir):
    log = chat_log(spark, sf_dir)
    return A.keep_newest(log, ["user_id"], [F.desc("created_at"), F.desc("log_id")], 20).select("log_id")


def metadata_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("file_name"), F.col("lang").alias("doc_type"), F.array(F.concat(F.lit("E"), F.col("doc_id").cast("string"))).alias("entities"))
    e = table(spark, sf_dir, "embeddings")
    hits = R.vector_rank(e.select(F.col("vec_id").alias("chunk_id"), F.lit("x").alias("doc_key"), "embedding"), probes(spark, sf_dir).where("query_id = 1").select("query_id", "query_vector"), 100)
    return A.semantic_and_metadata(hits.select(F.col("chunk_id").alias("doc_id"), "score"), d, "e12")


def stale_indexes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select("s_suppkey", A.index_is_stale(k % 5 != 0, k * 21, k % 3 * 10 + 20 * k, k % 7 * 700).alias("stale"))


def question_feedback(spark, sf_dir):
    log = chat_log(spark, sf_dir).where("query_type is not null")
    q = F.concat(F.lit("  "), F.upper("question"), F.lit("  "), F.col("query_type"))
    return A.feedback_tally(log.select(q.alias("question"), (F.col("log_id") % 3 == 0).alias("positive")))


def transcripts(spark, sf_dir):
    return A.transcript(chat_log(spark, sf_dir), 3)


def available_files(spark, sf_dir):
    local = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    indexed = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return A.file_list(local, indexed)


def source_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", A.source_label(F.when(F.col("doc_id") % 4 != 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))).alias("label"))


def ingest_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "done").otherwise("queued")
    totals, _ = A.job_summary(o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 9).alias("n_done"), (F.col("o_custkey") % 2).alias("n_errors")))
    return totals


def _list(words) -> str:
    return "(" + " or ".join(f"contains(lower(q), '{w}')" for w in words) + ")"


#: What \\b means to the operators, spelled for an engine whose \\b knows ASCII only.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def _unicode(pattern: str) -> str:
    """The pattern with word boundaries as letter classes; white space of any kind, and no flag for Unicode."""
    flags, out = ("(?i)" if pattern.startswith(("(?i)", "(?iU)")) else ""), re.sub(r"^\(\?i?U?\)", "", pattern)
    out = out.replace(r"\b.*\b", f"[^{_WORD}](?:.*[^{_WORD}])?").replace(r"\s", r"[\s\p{Z}]")
    out = re.sub(r"\\b(?=[(\w])", lambda _: f"(?:^|[^{_WORD}])", out)
    return flags + out.replace(r"\b", f"(?:$|[^{_WORD}])")


def _re(pattern: str, text: str = "q") -> str:
    return f"regexp_matches({text}, '{_unicode(pattern).replace(chr(39), chr(39) * 2)}')"


def _without_and(text: str) -> str:
    return f"regexp_replace({text}, '(?i)(^|[^{_WORD}])and($|[^{_WORD}])', '\\1;\\2', 'g')"


_PARTS = rf"list_filter(list_transform(regexp_split_to_array({_without_and(_without_and('q'))}, '\?|;|\n'), lambda x: trim(x)), lambda x: x <> '')"
_CUT = r"""case when length(text) <= 6000 then text else case when contains(substring(text, 1, 6000), '.') and 6000 - strpos(reverse(substring(text, 1, 6000)), '.') > 4200
  then substring(text, 1, 6001 - strpos(reverse(substring(text, 1, 6000)), '.')) else substring(text, 1, 6000) end || chr(10) || '[Context truncated for LLM]' end"""
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

QUERIES = {
    f.__name__: f
    for f in (
        inferred_roles, document_access, role_update, tenant_search, file_search, score_gate, reranked_search, multi_hop_search, ask, confidence_probes,
        question_parts, query_flags, chat_intents, admin_intents, capped_answers, calculations, fused_context, labelled_context, compared_files,
        similar_before, retention, metadata_search, stale_indexes, question_feedback, transcripts, available_files, source_labels, ingest_jobs,
    )
}
_QUESTION_SQL = "asked_whole(query_id, query) as (values " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ")"
_HOPS = f"""cut as (select query_id, {_PARTS.replace('(q,', '(query,')}[1:3] as ps from asked_whole),
probes as (select query_id * 10 + generate_subscripts(ps, 1) as query_id, unnest(ps) as query from cut), {_USER}, {_BM25},
t as (select query_id, chunk_id, doc_key, rank as before, list_distinct({_TOK.format('substring(query, 1, 300)')}) as a, {_TOK.format('substring(text, 1, 600)')} as b
  from lex_ranked join probes using (query_id) join (select chunk_id, text from seen) using (chunk_id) where rank <= 20),
s as (select query_id, chunk_id, doc_key, before, round(len(list_intersect(a, b)) / cast(greatest(len(a), 1) as double), 9) as score from t),
best as (select query_id // 10 as query_id, chunk_id, doc_key, max(score) as score from (select * from s qualify row_number() over (partition by query_id order by score desc, before) <= 10) group by all)"""
#: The flow's passages: near repeats dropped by a fold, two of a document first; then key sentences by another.
_PASSAGES = f"""hits as (select * from (select query_id, chunk_id, doc_key, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from best) join (select chunk_id, text from seen) using (chunk_id) where rank <= 10),
unlike as (select query_id, unnest({NEAR_REPEATS}, recursive := true) from hits group by query_id),
tiers as (select h.*, row_number() over (partition by query_id, doc_key order by rank) > 2 as over from hits h join unlike u using (query_id, rank)),
places as (select *, row_number() over (partition by query_id order by over, rank) as place from tiers qualify place <= 8),
shares as (select *, cast(floor(8000 / count(*) over (partition by query_id)) as int) as most from places),
built as (select query_id, string_agg({KEY_SENTENCES.format(text='text', most='most')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as c, string_agg(doc_key, ',' order by place) as sources, count(*) as passages from shares group by 1)"""
ORACLES = {
    "ask": f"""with {CHUNKS}, {_QUESTION_SQL}, {_HOPS}, {_PASSAGES}, {EDGES},
lines as (select distinct query_id, from_node || ' --[' || relation || ']--> ' || to_node as line from asked_whole join raw_edges on contains(lower(query), from_node) or contains(lower(query), to_node)),
graph as (select query_id, string_agg(line, chr(10) order by line) as g from (select * from lines qualify row_number() over (partition by query_id order by line) <= 50) group by 1)
select query_id, case when contains(lower(query), 'summar') then 'summary' when contains(lower(query), 'compare') then 'comparison' when contains(lower(query), 'risk') then 'analytical' else 'fact' end as query_type,
  c is not null as accessible, coalesce(passages, 0) as passages, coalesce(sources, '') as sources,
  md5(case when c is null then '' else concat_ws(chr(10) || chr(10), '[Knowledge Graph]' || chr(10) || substring(g, 1, 1600), '[Documents]' || chr(10) || case when length(c) > 8000 then substring(c, 1, 8000) || chr(10) || '[Context truncated]' else c end) end) as context,
  cast(case when c is null then 0 else least(97, least(98, 70 + case when g is not null then 15 else 0 end + case when passages >= 3 then 8 else 0 end + case when query_type = 'fact' then 3 else 0 end) + case when g is not null then 5 else 0 end) end as int) as confidence
from asked_whole left join built using (query_id) left join graph using (query_id)""",
    "inferred_roles": f"""with t as (select doc_id, coalesce(text, '') || case when doc_id % 7 = 0 then ' FOR IMMEDIATE RELEASE' else '' end as q from documents)
select doc_id, case when {_list(A.PUBLIC_SIGNALS)} then 'public,user,admin' else 'admin' end as roles from t""",
    "document_access": f"""with {CHUNKS}, f as (select doc_key, min_by(access_roles, chunk_id) as roles from chunks group by 1)
select doc_key, role from f, (values ('public'), ('user'), ('admin'), ('guest')) r(role) where list_contains(roles, role)""",
    "role_update": f"""with {CHUNKS} select doc_key, case when doc_key in (select 'src' || n_nationkey from nation where n_nationkey < 5) then 'auditor' else array_to_string(access_roles, ',') end as roles, count(*) as n from chunks group by all""",
    "tenant_search": f"{_HEAD} select * from (select query_id, chunk_id, doc_key, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from vec join chunks c using (chunk_id, doc_key) where c.tenant_id = 'en') where rank <= 10",
    "file_search": f"""{_HEAD}, r as (select * from (select query_id, chunk_id, doc_key, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from vec where doc_key = 'src0' and trim(text) <> '') where rank <= 10)
select query_id, chunk_id, doc_key, score, rank from r where score >= 0 or not exists (select 1 from r r2 where r2.query_id = r.query_id and r2.score >= 0)""",
    "score_gate": f"""{_HEAD}, r as (select query_id, chunk_id, doc_key, score, rank from vec_ranked where rank <= 25)
select * from r where score >= 0.25 or not exists (select 1 from r r2 where r2.query_id = r.query_id and r2.score >= 0.25)""",
    "reranked_search": f"""{_HEAD}, {_BM25}, fused as (
  select query_id, chunk_id, round(sum(part), 12) as s from (select query_id, chunk_id, 0.65 / (60 + rank) as part from vec_ranked where rank <= 50 union all select query_id, chunk_id, 0.35 / (60 + rank) from lex_ranked where rank <= 50) group by all),
f as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as before from fused qualify before <= 25),
t as (select query_id, chunk_id, before, list_distinct({_TOK.format('substring(query, 1, 300)')}) as a, {_TOK.format('substring(text, 1, 600)')} as b from f join probes using (query_id) join seen using (chunk_id)),
s as (select *, round(len(list_intersect(a, b)) / cast(greatest(len(a), 1) as double), 9) as score from t)
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, before) as rank from s) where rank <= 10""",
    "multi_hop_search": f"""with {CHUNKS}, {PROBE_SQL.replace('probes(', 'asked_whole(')}, cut as (select query_id, {_PARTS.replace('(q,', '(query,')}[1:3] as ps from asked_whole),
probes as (select query_id * 10 + generate_subscripts(ps, 1) as query_id, unnest(ps) as query from cut), {_USER}, {_BM25},
t as (select query_id, chunk_id, doc_key, rank as before, list_distinct({_TOK.format('substring(query, 1, 300)')}) as a, {_TOK.format('substring(text, 1, 600)')} as b
  from lex_ranked join probes using (query_id) join (select chunk_id, text from seen) using (chunk_id) where rank <= 20),
s as (select query_id, chunk_id, doc_key, before, round(len(list_intersect(a, b)) / cast(greatest(len(a), 1) as double), 9) as score from t),
best as (select query_id // 10 as query_id, chunk_id, doc_key, max(score) as score from (select * from s qualify row_number() over (partition by query_id order by score desc, before) <= 10) group by all)
select * from (select query_id, chunk_id, doc_key, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from best) where rank <= 10""",
    "confidence_probes": f"""{_HEAD}, {EDGES}, nodes as (select from_node as name from raw_edges union select to_node from raw_edges),
rag as (select query_id, max(score) as rag from vec group by 1),
g as (select p.query_id, case when p.query_id <= 3 then (select count(*) from nodes where name in ('supplier:1', 'part:' || p.query_id)) / cast(3 as double)
  when exists (select 1 from nodes where contains(lower(name), lower(string_split(trim(case when p.query_id = 4 then 'Supplier list' else query end), ' ')[1]))) then cast(0.4 as double) else cast(0 as double) end as graph from probes p),
b as (select query_id, coalesce(rag, 0) as rag, graph from g left join rag using (query_id))
select query_id, round(rag, 6) as rag, round(graph, 6) as graph, case when graph > rag + cast(0.15 as double) then 'graph' when rag > graph + cast(0.15 as double) then 'rag' else 'hybrid' end as route from b""",
    "question_parts": f"""with {ASK_SQL}, p as (select query_id, case when len({_PARTS}) = 0 then [q] else ({_PARTS})[1:3] end as ps from asked)
select query_id, cast(generate_subscripts(ps, 1) - 1 as int) as n, md5(unnest(ps)) as part from p""",
    "query_flags": f"""with {ASK_SQL} select query_id, {_re(A.NEEDS_GRAPH)} as needs_graph, {_re(A.NEEDS_CALCULATOR)} as needs_calculator,
  {' or '.join(_re(p, 'lower(q)') for p in A.GRAPH_TRIGGERS)} as graph_trigger, {_re(A.COMPARES)} as compares from asked""",
    "chat_intents": f"""with {ASK_SQL}, t as (select query_id, {', '.join(f'{_list(w)} as {n}' for n, w in A.INTENTS.items())} from asked)
select query_id, {', '.join(f"{n} or not ({' or '.join(A.INTENTS)}) as {n}" for n in A.INTENTS)} from t""",
    "admin_intents": f"""with {ASK_SQL} select query_id, case when {_re(A.FILE_LIST)} and not {_re(A.DOCUMENT_READ)} then 'file_list' when {_re(A.LOG_VIEW)} then 'log_view' end as intent,
  case when {_list(A.SECRET_TERMS)} then 'secret' when {_list(A.DANGEROUS_TERMS)} then 'destructive' end as guard from asked""",
    "capped_answers": rf"""with w as (select doc_id, text, regexp_split_to_array(trim(text, ' '), '\s+') as w from documents where text is not null)
select doc_id, md5(case when doc_id % 3 <> 0 and len(w) > 150 then array_to_string(w[1:150], ' ') || '…' else text end) as answer, md5({_CUT}) as summary from w""",
    "calculations": "select o_orderkey as query_id, 0 as n, cast(o_orderkey + o_custkey * 3 as double) as value from orders",
    "fused_context": """select doc_id, md5(concat_ws(chr(10) || chr(10), case when doc_id % 2 = 0 then '[Knowledge Graph]' || chr(10) || substring(repeat('a --[R]--> b' || chr(10), 200), 1, 1600) end,
  case when doc_id % 3 = 0 then '[Calculations]' || chr(10) || '1 + 1 = 2.0' end, case when trim(coalesce(text, '')) <> '' then '[Documents]' || chr(10) || text end)) as context from documents""",
    "labelled_context": f"""{_HEAD}, k as (select *, row_number() over (partition by query_id, doc_key order by score desc, chunk_id) as r from vec_ranked where rank <= 50 qualify r <= 5),
p as (select query_id, doc_key, '=== ' || doc_key || ' ===' || chr(10) || string_agg(text, chr(10) order by r) as part from k group by 1, 2)
select query_id, md5(string_agg(part, chr(10) || chr(10) order by doc_key)) as context from p group by 1""",
    "compared_files": """with w as (select distinct lower(n_name) || '_file.pdf' as doc_key, unnest(list_concat(regexp_split_to_array(lower(n_name), '[\\s_\\-./\\\\]+'), ['file'])) as word from nation),
a as (select c_custkey as query_id, 'compare nation' || c_nationkey || ' with a profile of others' as q from customer)
select distinct query_id, doc_key from a join w on length(word) >= 3 and contains(q, word)""",
    "similar_before": f"""with {LOG}, o as (select *, row_number() over (partition by user_id order by created_at, log_id) as n, list_distinct(string_split(lower(question), ' ')) as w from log),
p as (select a.log_id, b.question as before, row_number() over (partition by a.log_id order by b.n desc) as r from o a join o b on a.user_id = b.user_id and b.n between a.n - 10 and a.n - 1
  where a.n >= 4 and a.question <> b.question and len(list_intersect(a.w, b.w)) >= 2)
select log_id, before from p where r = 1""",
    "retention": f"with {LOG} select log_id from log qualify row_number() over (partition by user_id order by created_at desc, log_id desc) <= 20",
    "metadata_search": f"""{_HEAD}, h as (select e.vec_id as doc_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))), 9) as score
  from embeddings e, embeddings q where q.vec_id = 1 order by 2 desc, 1 limit 100)
select doc_id, source || '.txt' as file_name, score from h join documents using (doc_id) union all
select doc_id, source || '.txt', 0.5 from documents where doc_id not in (select doc_id from h) and (contains(source || '.txt', 'e12') or contains(coalesce(lang, ''), 'e12') or contains('e' || doc_id, 'e12'))""",
    "stale_indexes": "select s_suppkey, not (s_suppkey % 5 <> 0) or s_suppkey * 21 > (s_suppkey % 3 * 10 + 20 * s_suppkey) * cast(1.05 as double) or s_suppkey % 7 * 700 > 3600 as stale from supplier",
    "question_feedback": f"""with {LOG}, t as (select lower(question) || ' ' || query_type as question, count(*) filter (where log_id % 3 = 0) as pos, count(*) filter (where log_id % 3 <> 0) as neg from log where query_type is not null group by 1)
select question, pos, neg, round((pos / (pos + neg) - 0.5) * cast(0.3 as double), 3) as modifier from t""",
    "transcripts": f"""with {LOG}, n as (select *, row_number() over (partition by session_id order by created_at desc, log_id desc) as r from log qualify r <= 3)
select session_id, row_number() over (partition by session_id order by created_at, log_id) as turn, question from n""",
    "available_files": "select n_name as name, 'local' as origin from nation union all select r_name, 'indexed' from region where lower(r_name) not in (select lower(n_name) from nation)",
    "source_labels": "select doc_id, case when doc_id % 4 <> 0 then coalesce(source, 'unknown') else 'unknown' end || case when doc_id % 3 = 0 and n_chars is not null then ' (line ' || n_chars || ')' else '' end as label from documents",
    "ingest_jobs": "select count(*) filter (where o_orderstatus <> 'O') as active, sum(o_custkey % 9) as done, sum(o_custkey % 2) as errors from orders",
}
