"""Queries for document reads, mentions, contexts and navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import context as C
from docweave.operators import documents as D
from docweave.operators import retrieval as R
from docweave.plans.retrieval import _HEAD, KEY_SENTENCES, probes, user_chunks
from docweave.plans.views import table

ASKS = ("show line 2 of it", "read lines 3 to 5", "give me the full document", "what is this", "show me all files", "the 4th line")


def _asked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ask = F.element_at(F.array(*[F.lit(a) for a in ASKS]), (F.col("doc_id") % len(ASKS) + 1).cast("int"))
    return d.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("doc_key"), ask.alias("query"), "text")


def exfiltration(spark, sf_dir):
    role = F.when(F.col("query_id") % 4 == 0, "admin").otherwise("user")
    return _asked(spark, sf_dir).where(C.exfiltrates(F.col("query"), role)).groupBy("query").agg(F.count("*").alias("n"))


def read_lines(spark, sf_dir):
    a = _asked(spark, sf_dir)
    requests = a.select("query_id", "doc_key", *[c.alias(n) for n, c in C.read_request(F.col("query")).items()])
    return C.read_lines(requests, a.select("doc_key", "text")).select("query_id", "line_no", F.md5("line_text").alias("md5"))


def mentioned_files(spark, sf_dir):
    """Files named after all parts, asked for by every part's name: as it is, with one of its words changed, or with underscores."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, "_v2").otherwise(""), F.lit(".pdf")).alias("doc_key")).distinct()
    names = names.unionByName(parts.select(F.concat(F.lit("p"), F.col("p_size").cast("string"), F.lit(".xml")).alias("doc_key")).distinct())
    k = F.col("p_partkey") % 4
    asked = (
        F.when(k == 0, F.concat(F.lit("Show "), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(" now")))
        .when(k == 1, F.concat(F.lit("open the "), F.col("p_name"), F.lit(" v2 please")))
        .when(k == 2, F.concat(F.substring_index("p_name", " ", 1), F.lit(" things")))
        .otherwise(F.concat(F.lit("sizes xP"), F.col("p_size").cast("string"), F.lit("?")))
    )
    found = C.mentioned_files(parts.select(F.col("p_partkey").alias("query_id"), asked.alias("query")), names)
    return found.select("query_id", "doc_key", F.round("score", 6).alias("score"))


def key_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(C.key_sentences(F.coalesce("text", F.lit("")), 400)).alias("md5"))


def context_assembly(spark, sf_dir):
    c = user_chunks(spark, sf_dir)
    top = R.vector_rank(c, probes(spark, sf_dir).select("query_id", "query_vector"), 8).drop("doc_key").join(c.select("chunk_id", "doc_key", "text"), "chunk_id")
    return C.assemble(top).select("query_id", F.md5("context").alias("md5"), F.array_join("sources", ",").alias("sources"))


def breadcrumbs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    nav = p.select(F.col("page_id").cast("string").alias("url"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") > 0, F.floor(F.col("page_id") / 4).cast("string")).alias("parent"))
    return C.breadcrumbs(nav)


def contact_details(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(C.contact_info(F.col("text"))["email"].alias("email")).where("email is not null").groupBy("email").agg(F.count("*").alias("n"))


def page_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(D.stats_in(F.col("text"))).alias("n")).where("n > 0")


def api_key_auth(spark, sf_dir):
    u = table(spark, sf_dir, "customer")
    keys = u.where("c_custkey % 3 <> 0").select(F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("key_hash"), F.col("c_custkey").alias("key_id"), F.when(F.col("c_nationkey") % 2 == 0, "admin").otherwise("read").alias("permission"), (F.col("c_custkey") % 5 != 0).alias("active"), F.lit(None).cast("timestamp").alias("expires_at"))
    calls = u.select(F.col("c_custkey").alias("call_id"), F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("api_key"))
    return C.authorised(calls, keys, F.current_timestamp())


_ASKS = "[" + ", ".join(f"'{a}'" for a in ASKS) + "]"
QUERIES = {
    f.__name__: f
    for f in (exfiltration, read_lines, mentioned_files, key_sentences, context_assembly, breadcrumbs, contact_details, page_stats, api_key_auth)
}
ORACLES = {
    "exfiltration": f"""with a as (select doc_id, {_ASKS}[doc_id % {len(ASKS)} + 1] as query from documents)
select query, count(*) as n from a where doc_id % 4 <> 0 and regexp_matches(lower(query), '{"|".join(C.EXFILTRATION)}') group by 1""",
    "read_lines": f"""with a as (select doc_id, doc_id % {len(ASKS)} as k, string_split(text, chr(10)) as l from documents),
w as (select doc_id, k, l, unnest(generate_series(1, len(l))) as n from a)
select doc_id as query_id, cast(n as int) as line_no, md5(l[n]) as md5 from w where case k when 0 then n = 2 when 1 then n between 3 and 5 when 2 then true when 5 then n = 4 else n <= 20 end""",
    "mentioned_files": r"""with n as (select distinct replace(p_name, ' ', '_') || case when p_partkey % 2 = 0 then '_v2' else '' end || '.pdf' as doc_key from part union select 'p' || p_size || '.xml' from part),
w as (select doc_key, regexp_replace(lower(doc_key), '\.[^.]+$', '') as stem, list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(doc_key), '\.[^.]+$', ''), '[\s_\-./\\]+')), lambda x: length(x) >= 3) as ws from n),
q as (select p_partkey as query_id, lower(case p_partkey % 4 when 0 then 'Show ' || replace(p_name, ' ', '_') || ' now' when 1 then 'open the ' || p_name || ' v2 please'
  when 2 then string_split(p_name, ' ')[1] || ' things' else 'sizes xP' || p_size || '?' end) as q from part),
kinds as (select q, list_filter(list_distinct(regexp_split_to_array(q, '[\s_\-./\\]+')), lambda x: length(x) >= 3) as qs from (select distinct q from q)),
s as (select q, doc_key, case when contains(q, stem) then 1.0 when len(ws) = 0 then 0.0 when len(list_intersect(ws, qs)) < 2 and len(ws) > 1 then 0.0 else len(list_intersect(ws, qs)) / len(ws) end as score from kinds, w),
best as (select q, doc_key, score from s where score >= cast(0.4 as double) qualify row_number() over (partition by q order by score desc, doc_key) = 1)
select query_id, doc_key, round(cast(score as double), 6) as score from q join best using (q)""",
    "key_sentences": f"with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, md5({KEY_SENTENCES.format(text='text', most='400')}) as md5 from t",
    "context_assembly": f"""{_HEAD}, top as (select * from vec_ranked where rank <= 8), part as (select query_id, rank, doc_key, '[' || doc_key || '] ' || substring(text, 1, cast(floor(8000 / count(*) over (partition by query_id)) as int)) as p from top),
src as (select query_id, doc_key, min(rank) as r from top group by 1, 2)
select query_id, md5(substring(string_agg(p, chr(10) || '---' || chr(10) order by rank), 1, 8000)) as md5, (select string_agg(doc_key, ',' order by r) from src where src.query_id = part.query_id) as sources from part group by query_id""",
    "breadcrumbs": """with recursive t(url, up, depth, trail) as (select page_id, case when page_id > 0 then page_id // 4 end, 0, 'p' || page_id from pages
  union all select t.url, case when t.up > 0 then t.up // 4 end, depth + 1, 'p' || t.up || ' > ' || trail from t join pages p on p.page_id = t.up where depth < 6)
select cast(url as varchar) as url, max_by(trail, depth) as breadcrumb from t group by 1""",
    "contact_details": r"select email, count(*) as n from (select nullif(trim(regexp_extract(text, '(?i)[\w.+-]+@[\w-]+\.[a-z]{2,}')), '') as email from documents) where email is not null group by 1",
    "api_key_auth": "select c_custkey as call_id, c_custkey as tenant_id, case when c_nationkey % 2 = 0 then 'admin' else 'public' end as role from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0",
}
