"""Retrieval queries over the chunks view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import postings as P
from docweave.operators import retrieval as R
from docweave.plans.views import CHUNKS, chunks, table
from docweave.sources.shared import new_folder

#: Probe queries: words of the corpus, one stop word, one repeated word.
PROBES = [(1, "the license of and"), (2, "Licensed under CC"), (3, "der und die kinder"), (4, "que de la que"), (5, "inthe email user")]
PROBE_SQL = "probes(query_id, query) as (values " + ", ".join(f"({i}, '{q}')" for i, q in PROBES) + ")"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: cast(x[1] as double) * cast(x[2] as double)))"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text queries, each with the vector of the embedding with its id."""
    text = spark.createDataFrame(PROBES, "query_id long, query string")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return text.join(vectors, "query_id")


def user_chunks(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    return R.governed(chunks(spark, sf_dir, with_vectors), "user")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid_search(user_chunks(spark, sf_dir), probes(spark, sf_dir), texts=user_chunks(spark, sf_dir, False)).select("query_id", "chunk_id", "doc_key", "score", "rank")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_rank(user_chunks(spark, sf_dir), probes(spark, sf_dir).select("query_id", "query_vector"), 25)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.bm25(user_chunks(spark, sf_dir, False), probes(spark, sf_dir))
    return R.top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 25)


def kept_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk from a kept index: built from a part of the chunks, then brought up to all of them by three increments, of which two take chunks away."""
    all_, path = user_chunks(spark, sf_dir, False), new_folder(spark, "postings")
    turn = F.col("chunk_id") % 4
    old = F.concat("text", F.lit(" outdated words of and"))
    P.refresh(spark, path, all_.where(turn == 0).withColumn("text", old).unionByName(all_.where(turn == 1)), buckets=16)
    P.refresh(spark, path, all_.where(turn == 0), all_.where(turn == 0).select("chunk_id"))
    P.refresh(spark, path, all_.where(turn >= 2).withColumn("chunk_id", -F.col("chunk_id") - 1))
    P.refresh(spark, path, all_.where(turn >= 2), all_.where(turn >= 2).select((-F.col("chunk_id") - 1).alias("chunk_id")))
    scored = P.search(spark, path, probes(spark, sf_dir).select("query_id", "query"))
    return R.top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 25)


def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    out = None
    for role in ("public", "user", "admin"):
        part = R.governed(c, role).groupBy("tenant_id").agg(F.count("*").alias("n")).withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out


def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = R.vector_rank(user_chunks(spark, sf_dir), probes(spark, sf_dir).select("query_id", "query_vector"), 50)
    return R.diverse(vector.drop("rank"), 10, cap=1).select("query_id", "chunk_id", "doc_key", "score", "tier", "rank")


def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", R.trigrams(F.col("text")).alias("g"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(R.jaccard(F.col("g"), F.col("h")), 9).alias("similarity"))


def context_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_chunks(spark, sf_dir)
    ranked = R.vector_rank(c, probes(spark, sf_dir).select("query_id", "query_vector"), 25).drop("doc_key", "score")
    return R.drop_near_repeats(ranked.join(c.select("chunk_id", "text"), "chunk_id")).select("query_id", "rank", "chunk_id")


def query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("summarize ", "compare ", "risk ", "what ")]), (F.col("turn") % 4 + 1).cast("int")), "text")
    return asked.groupBy(R.classify(text).alias("query_type")).agg(F.count("*").alias("n"))


def confidence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rag, graph = (F.col("event_id") % 11) / 10, (F.col("user_id") % 11) / 10
    return e.groupBy(R.route(rag, graph).alias("route")).agg(F.count("*").alias("n"))


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_chunks(spark, sf_dir)
    top = R.vector_rank(c, probes(spark, sf_dir).select("query_id", "query_vector"), 20).join(c.select("chunk_id", "text"), "chunk_id")
    relations = table(spark, sf_dir, "nation").select(
        F.lit(1).cast("long").alias("query_id"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("nation --[IN]--> "), F.col("n_regionkey").cast("string")).alias("text")
    )
    out = R.weighted_fusion(top.select("query_id", "text", "score"), relations)
    return out.select("query_id", "rank", F.round("score", 9).alias("score"), F.substring("text", 1, 80).alias("head"))


def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return R.decompose(asked).groupBy("query_id").agg(F.count("*").alias("parts"), F.max(F.length("text")).alias("longest"))


def feedback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    tally = rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))
    return tally.select("source", "pos", "neg", R.feedback_modifier(F.col("pos"), F.col("neg")).alias("modifier"), (F.col("neg") >= 2).alias("rewrite"))


def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    score = R.answer_confidence(kind == "view", F.col("event_id") % 5, F.col("event_id") % 2 == 0, kind == "click", kind == "error", F.col("event_id") % 3)
    return e.groupBy(score.cast("int").alias("confidence")).agg(F.count("*").alias("n"))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id")
    answers = c.where("role = 'assistant'").select(key, "text")
    contexts = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("answer_id"), F.lit(1).alias("rank"), F.col("text").alias("context"))
    return R.grounding(answers, contexts)


_USER = "seen as (select * from chunks where list_contains(access_roles, 'user'))"
_VECTOR = f"""vec as (
  select p.query_id, c.chunk_id, c.doc_key, c.text, round({DOT.format(a='c.embedding', b='e.embedding')}, 9) as score
  from seen c cross join probes p join embeddings e on e.vec_id = p.query_id where c.embedding is not null),
vec_ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from vec)"""
_BM25 = r"""doc_tokens as (select chunk_id, doc_key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as toks from seen),
postings as (select chunk_id, doc_key, length, term, count(*) as tf from (select chunk_id, doc_key, len(toks) as length, unnest(toks) as term from doc_tokens) group by all),
stats as (select count(*) as n_docs, avg(len(toks)) as mean_length from doc_tokens),
raw as (select term, ln((n_docs - df + 0.5) / (df + 0.5)) as raw from (select term, count(*) as df from postings group by term), stats),
asked as (select query_id, term, count(*) as asked from (select query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) as term from probes) group by all),
weights as (select query_id, asked, term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw join asked using (term)),
lex as (select query_id, chunk_id, doc_key, round(sum(asked * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) as score
        from postings join weights using (term), stats group by all having round(sum(asked * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) > 0),
lex_ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from lex)"""
_HEAD = f"with {CHUNKS}, {PROBE_SQL}, {_USER}, {_VECTOR}"
_GRAMS = """case when length(t) < 3 then [] else list_distinct(list_transform(generate_series(1, length(t) - 2), lambda i: substring(t, i, 3))) end"""

QUERIES = {
    "hybrid_search": hybrid_search, "vector_topk": vector_topk, "bm25_topk": bm25_topk, "kept_index_search": kept_index_search, "role_filter": role_filter,
    "diverse_topk": diverse_topk, "trigram_similarity": trigram_similarity, "context_dedupe": context_dedupe,
    "query_classes": query_classes, "confidence_route": confidence_route, "weighted_fusion": weighted_fusion,
    "query_decompose": decompose, "feedback_scores": feedback_scores, "answer_confidence": answer_confidence, "grounding": grounding,
}
#: Folds as DuckDB expressions: the rows (rank, chunk_id) of a query that are unlike all kept before, and the key sentences of a text.
_HEAD_GRAMS = "list_distinct(list_transform(range(1, greatest(1, least(500, length(text)) - 1)), lambda i: substring(lower(substring(text, 1, 500)), i, 3)))"
NEAR_REPEATS = f"""list_transform(list_reduce(list([{{'rank': rank, 'chunk_id': chunk_id, 'g': {_HEAD_GRAMS}}}] order by rank),
  lambda a, x: case when len(list_filter(a, lambda k: len(k.g) > 0 and len(x[1].g) > 0 and len(list_intersect(k.g, x[1].g)) / (len(k.g) + len(x[1].g) - len(list_intersect(k.g, x[1].g))) > cast(0.85 as double))) > 0 then a else list_concat(a, x) end),
  lambda k: {{'rank': k.rank, 'chunk_id': k.chunk_id}})"""
_SENTENCES = r"string_split(regexp_replace(trim({text}, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
KEY_SENTENCES = rf"""case when length({{text}}) <= {{most}} then {{text}} else array_to_string(list_transform(list_sort(list_reduce(list_prepend({{{{'left': cast({{most}} - length({_SENTENCES}[1]) as bigint), 'kept': [{{{{'at': cast(-1 as bigint), 's': {_SENTENCES}[1]}}}}]}}}},
  list_transform(list_sort(list_transform({_SENTENCES}[2:], lambda s, i: {{{{'size': -length(s), 'at': cast(i as bigint), 's': s}}}})), lambda r: {{{{'left': cast(-r.size as bigint), 'kept': [{{{{'at': r.at, 's': r.s}}}}]}}}})),
  lambda a, r: case when a.left > 0 and r.left <= a.left then {{{{'left': a.left - r.left - 1, 'kept': list_concat(a.kept, r.kept)}}}} else a end).kept), lambda k: k.s), ' ') end"""
ORACLES = {
    "context_dedupe": f"{_HEAD} select query_id, unnest({NEAR_REPEATS}, recursive := true) from vec_ranked where rank <= 25 group by query_id",
    "grounding": rf"""with a as (select conv_id * 1000 + turn as answer_id, coalesce(text, '') as text from conversations where role = 'assistant'),
c as (select conv_id * 1000 + turn + 1 as answer_id, coalesce(text, '') as context from conversations where role = 'user'),
s as (select answer_id, unnest(list_filter(regexp_split_to_array(text, '[.!?]\s+'), lambda x: length(trim(x, ' ')) > 15)) as s from a where text <> '' and answer_id in (select answer_id from c)),
t as (select answer_id, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+')) as own, regexp_extract_all(lower(context), '[\p{{L}}\p{{N}}_]+') as ctx from s join c using (answer_id)),
m as (select answer_id, count(*) as sentences, round(avg(len(list_intersect(own, ctx)) / greatest(len(own), 1)), 6) as score from t group by 1)
select answer_id, coalesce(sentences, 0) as sentences, coalesce(score, case when text <> '' and answer_id in (select answer_id from c) then 1.0 else 0.0 end) as score,
  coalesce(score, case when text <> '' and answer_id in (select answer_id from c) then 1.0 else 0.0 end) >= 0.4 as grounded from a left join m using (answer_id)""",
    "hybrid_search": f"""{_HEAD}, {_BM25}, fused as (
  select query_id, chunk_id, doc_key, round(sum(part), 12) as score from (
    select query_id, chunk_id, doc_key, 0.65 / (60 + rank) as part from vec_ranked where rank <= 50
    union all select query_id, chunk_id, doc_key, 0.35 / (60 + rank) from lex_ranked where rank <= 50) group by all)
select query_id, chunk_id, doc_key, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused) where rank <= 25""",
    "vector_topk": f"{_HEAD} select query_id, chunk_id, doc_key, score, rank from vec_ranked where rank <= 25",
    "bm25_topk": f"{_HEAD}, {_BM25} select query_id, chunk_id, doc_key, score, rank from lex_ranked where rank <= 25",
    "kept_index_search": f"{_HEAD}, {_BM25} select query_id, chunk_id, doc_key, score, rank from lex_ranked where rank <= 25",
    "role_filter": f"""with {CHUNKS} select tenant_id, count(*) as n, role from chunks, (values ('public'), ('user'), ('admin')) r(role)
where role = 'admin' or list_contains(access_roles, role) group by tenant_id, role""",
    "diverse_topk": f"""{_HEAD}, tiers as (
  select query_id, chunk_id, doc_key, score, cast(row_number() over (partition by query_id, doc_key order by score desc, chunk_id) > 1 as int) as tier from vec_ranked where rank <= 50)
select * from (select *, row_number() over (partition by query_id order by tier, score desc, chunk_id) as rank from tiers) where rank <= 10""",
    "trigram_similarity": f"""with g as (select doc_id, {_GRAMS} as g from (select doc_id, lower(substring(text, 1, 500)) as t from documents))
select a.doc_id, round(case when len(a.g) = 0 or len(b.g) = 0 then 0.0 else len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) end, 9) as similarity
from g a join g b on b.doc_id = a.doc_id + 1""",
    "query_classes": """with q as (select lower(['summarize ', 'compare ', 'risk ', 'what '][turn % 4 + 1] || text) as q from conversations where role = 'user')
select case when q like '%summarize%' or q like '%summary%' then 'summary' when q like '%compare%' or q like '%difference%' then 'comparison'
            when q like '%risk%' or q like '%analysis%' then 'analytical' else 'fact' end as query_type, count(*) as n from q group by 1""",
    "confidence_route": """with c as (select (event_id % 11) / 10 as rag, (user_id % 11) / 10 as graph from events)
select case when graph > rag + cast(0.15 as double) then 'graph' when rag > graph + cast(0.15 as double) then 'rag' else 'hybrid' end as route, count(*) as n from c group by 1""",
    "weighted_fusion": f"""{_HEAD}, both_lists as (
  select query_id, text, score * 0.7 as score, 0 as kind, 0 as seq from vec_ranked where rank <= 20
  union all select 1, 'nation --[IN]--> ' || cast(n_regionkey as varchar), cast(0.18 as double), 1, n_nationkey from nation qualify row_number() over (order by n_nationkey) <= 10),
once as (select * from both_lists qualify row_number() over (partition by query_id, substring(text, 1, 80) order by score desc, kind, seq, text) = 1)
select query_id, row_number() over (partition by query_id order by score desc, kind, seq, text) as rank, round(score, 9) as score, substring(text, 1, 80) as head from once""",
    "query_decompose": """with q as (select conv_id * 1000 + turn as query_id, text from conversations where role = 'user'),
parts as (select query_id, unnest(case when contains(lower(text), ' and ') then list_concat([text], string_split(lower(text), ' and ')) else [text] end) as t from q)
select query_id, count(*) as parts, max(length(t)) as longest from parts group by query_id""",
    "feedback_scores": """with t as (select source, count(*) filter (where quality = 1) as pos, count(*) filter (where quality = 0) as neg from labels join documents using (doc_id) group by source)
select source, pos, neg, case when pos + neg = 0 then 0.0 else round((pos / (pos + neg) - 0.5) * cast(0.3 as double), 3) end as modifier, neg >= 2 as rewrite from t""",
    "answer_confidence": """with s as (select event_type, event_id, least(98, 70 + case when event_type = 'view' then 15 else 0 end + case when event_id % 5 >= 3 then 8 else 0 end
    + case when event_id % 2 = 0 then 5 else 0 end + case when event_type = 'click' then 3 else 0 end) as base from events)
select cast(least(97, base + case when event_type = 'error' then 8 else 0 end + case when event_type = 'view' then 5 else 0 end + 3 * (event_id % 3)) as int) as confidence, count(*) as n from s group by 1""",
}
