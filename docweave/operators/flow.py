"""Composed question answering: from a question to its passages, context, sources and confidence.

Everything runs for all questions of a table at once. A question has few passages, so what is folded per
question is bounded by the passages asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import answering as A
from docweave.operators import retrieval as R
from docweave.operators.containment import contained
from docweave.operators.context import key_sentences
from docweave.operators.graph import checkpoint

#: Passages and characters of a context, passages of a document and of a page, the line between passages and the mark of a cut.
PASSAGES, CHARACTERS, OF_DOCUMENT, OF_PAGE = 8, 8000, 2, 1
BETWEEN, CUT = "\n\n---\n\n", "\n[Context truncated]"
#: What stands above a page's passage, where the page has it.
PAGE_LINES = (("url", "URL: "), ("page_type", "Page type: "), ("nav_links", "Navigation: "), ("stats", "Key stats: "), ("people", "Key people: "))
PAGE_COLUMNS = ("source_type", "url", "title", "org_name", "page_type", "nav_links", "stats", "people", "phone", "email", "line_start")


def filled(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column))


def page_header(page: Column) -> Column:
    """The lines above a page's passage; empty for other sources and for pages that nothing is known of."""
    label = F.concat(F.lit("[Website] "), F.coalesce(F.concat(filled("org_name"), F.lit(": ")), F.lit("")), filled("title"))
    lines = [label, *[F.concat(F.lit(head), filled(c)) for c, head in PAGE_LINES]]
    contact = F.concat_ws(" | ", F.concat(F.lit("Phone: "), filled("phone")), F.concat(F.lit("Email: "), filled("email")))
    lines.append(F.when(contact != "", F.concat(F.lit("Contact: "), contact)))
    text = F.concat_ws("\n", *lines)
    return F.when(page & (text != ""), F.concat(text, F.lit("\n\n"))).otherwise("")


def select_passages(ranked: DataFrame, most: int = PASSAGES) -> DataFrame:
    """The passages of a context from ranked(query_id, rank, chunk_id, doc_key, text, score): gated, without near repeats, of different sources.

    Passages with a negative score go unless all have one. A passage much like one kept before it goes. Two of
    a document (one of a page, told by source_type and url where those columns are there) come first, then the
    others in order, until there are enough; place counts them from 1.
    """
    for c in PAGE_COLUMNS:
        if c not in ranked.columns:
            ranked = ranked.withColumn(c, F.lit(None).cast("string"))
    good = F.max(F.col("score")).over(W.partitionBy("query_id")) < 0
    gated = ranked.withColumn("_none", good).where(F.col("_none") | (F.col("score") >= 0)).drop("_none")
    kept = R.drop_near_repeats(gated.select("query_id", "rank", "chunk_id", "text")).select("query_id", "chunk_id")
    page = F.coalesce(F.col("source_type") == "website", F.lit(False))
    key = F.struct(page, F.when(page, F.coalesce("url", "doc_key")).otherwise(F.col("doc_key")))
    rows = gated.join(kept, ["query_id", "chunk_id"], "left_semi")
    nth = F.row_number().over(W.partitionBy("query_id", key).orderBy("rank"))
    tier = rows.withColumn("_over", (nth > F.when(page, OF_PAGE).otherwise(OF_DOCUMENT)).cast("int"))
    return R.top_k(tier.withColumnRenamed("rank", "_rank"), ["query_id"], [F.asc("_over"), F.asc("_rank")], most).withColumnRenamed("rank", "place").drop("_over", "_rank")


def build_context(passages: DataFrame, budget: int = CHARACTERS) -> DataFrame:
    """(query_id, context, sources, passages) of select_passages(): each passage cut to key sentences within its share of the budget.

    A page's passage stands under what is known of the page. Sources are the documents with their line, or the
    pages' addresses; a passage without either is named by its place.
    """
    page = F.coalesce(F.col("source_type") == "website", F.lit(False))
    share = F.floor(budget / F.count("*").over(W.partitionBy("query_id"))).cast("int")
    line = F.coalesce(F.concat(F.lit(" (line "), F.col("line_start").cast("string"), F.lit(")")), F.lit(""))
    name = F.when(page & filled("url").isNotNull(), F.col("url")).when(F.coalesce("doc_key", F.lit("unknown")) != "unknown", F.concat("doc_key", line)).otherwise(F.concat(F.lit("Document chunk "), "place"))
    rows = passages.withColumn("_share", share).withColumn("part", F.concat(page_header(page), key_sentences(F.col("text"), F.col("_share")))).withColumn("name", name)
    ordered = F.array_sort(F.collect_list(F.struct("place", "part", "name")))
    whole = rows.groupBy("query_id").agg(ordered.alias("o"), F.count("*").alias("passages"))
    text = F.array_join(F.transform("o", lambda r: r["part"]), BETWEEN)
    return whole.select(
        "query_id", F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget), F.lit(CUT))).otherwise(text).alias("context"),
        F.transform("o", lambda r: r["name"]).alias("sources"), "passages",
    )


def graph_lines(queries: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, graph): the first relations of the nodes that a question names, one a line.

    A node is named if its name stands in the question, without regard to case (a containment join).
    """
    ends = edges.select(F.col("from_node").alias("name")).unionByName(edges.select(F.col("to_node").alias("name"))).distinct()
    edges = edges.select("from_node", "relation", "to_node")
    named = contained(ends.select(F.col("name").alias("short_id"), F.lower("name").alias("s")), queries.select(F.col("query_id").alias("long_id"), F.lower("query").alias("t")))
    named = checkpoint(named)  # small where questions are few: then the edges stay where they are
    line = F.concat("from_node", F.lit(" --["), "relation", F.lit("]--> "), "to_node")
    at = lambda end: edges.select(F.col(end).alias("short_id"), line.alias("line"))
    lines = named.join(at("from_node").unionByName(at("to_node")), "short_id").select(F.col("long_id").alias("query_id"), "line").distinct()
    first = R.top_k(lines, ["query_id"], [F.asc("line")], most)
    return first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x), "\n").alias("graph"))


def ask(queries: DataFrame, chunks: DataFrame, edges: DataFrame, role: str, k: int = 10) -> DataFrame:
    """(query_id, query_type, accessible, passages, sources, context, confidence) of queries(query_id, query), one row a question.

    Classified; retrieved and re-ranked for each of its parts among what the role may read; passages chosen and
    assembled; what the graph knows of the named nodes put before them. A question that finds nothing has no
    context and is not accessible, whatever the graph knows.
    """
    parts = queries.select("query_id", F.posexplode(A.question_parts(F.col("query"))).alias("part", "text"))
    readable = R.governed(chunks, role)
    hits = checkpoint(A.multi_hop(parts, readable, k))  # read more than once, and k rows a question: texts need not move
    texts = readable.select("chunk_id", "text", *[c for c in PAGE_COLUMNS if c in readable.columns])
    found = build_context(select_passages(checkpoint(hits.join(texts, "chunk_id"))))
    rows = queries.join(found, "query_id", "left").join(graph_lines(queries, edges), "query_id", "left")
    some, kind = F.col("passages").isNotNull(), R.classify(F.col("query"))
    no = F.lit(False)
    score = R.answer_confidence(F.col("graph").isNotNull(), F.col("passages"), no, kind == "fact", no, F.lit(0))
    return rows.select(
        "query_id", kind.alias("query_type"), some.alias("accessible"), F.coalesce("passages", F.lit(0)).cast("long").alias("passages"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.when(some, A.fuse_context(F.col("graph"), F.lit(None).cast("string"), F.col("context"))).otherwise("").alias("context"),
        F.when(some, score).otherwise(0).cast("int").alias("confidence"),
    )
