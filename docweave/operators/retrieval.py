"""Retrieval: governed reads, vector and BM25 ranking, fusion, diversity, context selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Query terms that are sent to every task; more are joined.
BROADCAST_TERMS = 10_000


def governed(chunks: DataFrame, role: str, tenant: str | None = None) -> DataFrame:
    """Chunks that a role (and tenant) may read; admins read all roles. Always the first step of a search."""
    seen = chunks if role == "admin" else chunks.where(F.array_contains("access_roles", role))
    return seen if tenant is None else seen.where(F.col("tenant_id") == tenant)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_rank(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, doc_key, score, rank): top k by cosine of unit vectors; no vector, no rank.

    queries(query_id, query_vector) is the stated query set; every chunk meets each of its rows. The
    k best of each partition are kept before the shuffle, so a query's window sees k rows a task.
    """
    scored = (
        chunks.where("embedding is not null").select("chunk_id", "doc_key", "embedding").crossJoin(queries)
        .select("query_id", "chunk_id", "doc_key", F.round(dot("embedding", "query_vector"), 9).alias("score"))
    )
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key as column rank; Spark limits each partition first."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, chunk_id, doc_key, score) of chunks with a positive score for queries(query_id, query).

    Okapi weights; a negative idf becomes epsilon x the mean idf of the vocabulary. Query tokens
    count as often as they stand in the query. Only the queries' own tokens leave the rows: document
    frequencies are counted before the shuffle, and the chunks' tokens meet the asked terms (the
    stated query set) by a broadcast while those are few, so that no other token is moved.
    """
    docs = chunks.select("chunk_id", "doc_key", tokens(F.col("text")).alias("tokens"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("mean_length"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(stats).withColumn("raw", F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("asked")
    )
    terms = asked.select("term").distinct()
    few = F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms
    tf = (
        docs.select("chunk_id", "doc_key", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(few, "term")
        .groupBy("chunk_id", "doc_key", "length", "term").agg(F.count("*").alias("tf"))
    )
    weights = raw.join(asked, "term").crossJoin(mean).withColumn(
        "idf", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    )
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    part = F.col("asked") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    scored = tf.join(weights, "term").groupBy("query_id", "chunk_id", "doc_key").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.where("score > 0")


def rrf(vector: DataFrame, lexical: DataFrame, k: int = 60, vector_weight: float = 0.65, lexical_weight: float = 0.35) -> DataFrame:
    """(query_id, chunk_id, doc_key, score): weighted reciprocal ranks of two ranked lists, summed."""
    part = lambda rows, w: rows.select("query_id", "chunk_id", "doc_key", (F.lit(w) / (k + F.col("rank"))).alias("part"))
    both = part(vector, vector_weight).unionByName(part(lexical, lexical_weight))
    return both.groupBy("query_id", "chunk_id", "doc_key").agg(F.round(F.sum("part"), 12).alias("score"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = 25, texts: DataFrame | None = None) -> DataFrame:
    """Top k by fused rank for queries(query_id, query, query_vector); both lists give 2k candidates.

    Where one list has nothing the other decides alone. texts are the chunks without their vectors,
    where those come from another table.
    """
    order = [F.desc("score"), F.asc("chunk_id")]
    vector = vector_rank(chunks, queries.select("query_id", "query_vector"), 2 * k)
    lexical = top_k(bm25(chunks if texts is None else texts, queries.select("query_id", "query")), ["query_id"], order, 2 * k)
    return top_k(rrf(vector, lexical), ["query_id"], order, k)


def diverse(ranked: DataFrame, k: int, cap: int = 2) -> DataFrame:
    """The k best of each query with at most cap per document, filled up by score where too few remain.

    Greedy choice and backfill as one order: rows within their document's cap first, then by score.
    """
    of_doc = W.partitionBy("query_id", "doc_key").orderBy(F.desc("score"), F.asc("chunk_id"))
    tier = ranked.withColumn("tier", (F.row_number().over(of_doc) > cap).cast("int"))
    return top_k(tier, ["query_id"], [F.asc("tier"), F.desc("score"), F.asc("chunk_id")], k)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the first 500 characters, lower-cased; none below three."""
    # one pass with a look-ahead: a substring per place would lower the text again for each
    t = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500))
    return F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(...))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def drop_near_repeats(ranked: DataFrame, most: float = 0.85) -> DataFrame:
    """Per query, walk the ranked rows and keep one only if it is unlike all kept before it.

    An ordered fold over the few candidates of a query: kept rows decide, dropped ones do not.
    """
    rows = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text", trigrams(F.col("text")).alias("grams")))).alias("rows")
    )
    kind = rows.schema["rows"].dataType.simpleString()
    kept = F.aggregate(
        "rows",
        F.expr(f"cast(array() as {kind})"),
        lambda acc, row: F.when(F.exists(acc, lambda k: jaccard(k["grams"], row["grams"]) > most), acc).otherwise(
            F.array_append(acc, row)
        ),
    )
    return rows.select("query_id", F.explode(kept).alias("r")).select("query_id", "r.rank", "r.chunk_id", "r.text")


def classify(query: Column) -> Column:
    """Query class by the first family of words that occurs."""
    q = F.lower(query)
    return (
        F.when(q.contains("summarize") | q.contains("summary"), "summary")
        .when(q.contains("compare") | q.contains("difference"), "comparison")
        .when(q.contains("risk") | q.contains("analysis"), "analytical")
        .otherwise("fact")
    )


def route(rag: Column, graph: Column, margin: float = 0.15) -> Column:
    """Which retriever to trust: the one whose confidence leads by more than the margin."""
    return F.when(graph > rag + margin, "graph").when(rag > graph + margin, "rag").otherwise("hybrid")


def weighted_fusion(passages: DataFrame, relations: DataFrame, weight: float = 0.7, relation_score: float = 0.6 * 0.3, most: int = 10) -> DataFrame:
    """Passages (query_id, text, score) at weight x score and the first relations (query_id, seq, text) at a fixed score.

    Best first; of texts with the same first 80 characters the first stays.
    """
    first = relations.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("seq"))).where(F.col("n") <= most)
    both = passages.select("query_id", "text", (F.col("score") * weight).alias("score"), F.lit(0).alias("kind"), F.lit(0).alias("seq")).unionByName(
        first.select("query_id", "text", F.lit(relation_score).alias("score"), F.lit(1).alias("kind"), F.col("seq").cast("int").alias("seq"))
    )
    order = [F.desc("score"), F.asc("kind"), F.asc("seq"), F.asc("text")]
    same = W.partitionBy("query_id", F.substring("text", 1, 80)).orderBy(*order)
    once = both.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def decompose(queries: DataFrame) -> DataFrame:
    """(query_id, part, text): the query itself, and where it holds " and " its lower-cased parts."""
    q = F.lower("query")
    parts = F.when(q.contains(" and "), F.concat(F.array("query"), F.split(q, " and "))).otherwise(F.array("query"))
    return queries.select("query_id", F.posexplode(parts).alias("part", "text"))


def answer_confidence(graph: Column, chunks: Column, cached: Column, fact: Column, hybrid: Column, compared: Column) -> Column:
    """Confidence in percent: 70 and what speaks for the answer, within the two caps."""
    base = F.least(
        F.lit(98),
        F.lit(70) + F.when(graph, 15).otherwise(0) + F.when(chunks >= 3, 8).otherwise(0)
        + F.when(cached, 5).otherwise(0) + F.when(fact, 3).otherwise(0),
    )
    return F.least(F.lit(97), base + F.when(hybrid, 8).otherwise(0) + F.when(graph, 5).otherwise(0) + 3 * compared)


def feedback_modifier(positive: Column, negative: Column) -> Column:
    """(positive share - 1/2) x 0.3, three decimals; 0 without feedback."""
    total = positive + negative
    return F.when(total == 0, 0.0).otherwise(F.round((positive / total - 0.5) * 0.30, 3))


def token_overlap(sentence: Column, context: Column) -> Column:
    """Share of the sentence's different tokens that the context has: the default scorer."""
    own = F.array_distinct(tokens(sentence))
    return F.size(F.array_intersect(own, tokens(context))) / F.greatest(F.size(own), F.lit(1))


def grounding(answers: DataFrame, contexts: DataFrame, least_chars: int = 15, most: int = 3, scorer=token_overlap) -> DataFrame:
    """(answer_id, sentences, score, grounded): mean over sentences of the best score with the first contexts.

    answers(answer_id, text), contexts(answer_id, rank, context); sentences of up to least_chars do
    not count, and an answer of only such sentences scores 1. No context, or no answer: score 0.
    Below 0.4 the answer is not grounded. A scorer of None stands for no model: score 1.
    """
    first = contexts.withColumn("_n", F.row_number().over(W.partitionBy("answer_id").orderBy("rank", "context"))).where(F.col("_n") <= most).select("answer_id", "context")
    some = answers.where("text <> ''").join(first.select("answer_id").distinct(), "answer_id", "left_semi")
    sentences = some.select("answer_id", F.posexplode(F.split("text", r"[.!?]\s+")).alias("n", "sentence")).where(
        F.length(F.trim("sentence")) > least_chars
    )
    share = F.lit(1.0) if scorer is None else scorer(F.col("sentence"), F.col("context"))
    best = sentences.join(first, "answer_id").withColumn("s", share).groupBy("answer_id", "n").agg(F.max("s").alias("best"))
    means = best.groupBy("answer_id").agg(F.count("*").alias("sentences"), F.round(F.avg("best"), 6).alias("score"))
    out = answers.select("answer_id").join(some.select("answer_id", F.lit(1.0).alias("told")), "answer_id", "left").join(means, "answer_id", "left")
    out = out.select("answer_id", F.coalesce("sentences", F.lit(0)).alias("sentences"), F.coalesce("score", "told", F.lit(0.0)).alias("score"))
    return out.withColumn("grounded", F.col("score") >= 0.4)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
