"""Around the answer: access, routing flags, re-ranking, probes, contexts, history and small text rules."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import retrieval as R
from docweave.operators.containment import contained
from docweave.operators.graph import checkpoint

# fixed values: phrases by which a text says that it is public
PUBLIC_SIGNALS = ("public release", "press release", "for immediate release", "open source", "publicly available")
# fixed values: what makes a question need the graph or the calculator (the latter in lower case only)
NEEDS_GRAPH = r"(?iU)\b(when|date|start|end|expir|relationship|connect|link|associat|contract.?number|agree|issu|compan|organiz|provider|vendor|amount|price|cost|value)\b"
NEEDS_CALCULATOR = r"(?U)(\bcalculat|\bhow\s+much|\btotal|\bsum\b|\baverage|\bpercent|\d+\s*[\+\-\*\/])"
# fixed values: what sends a question to the graph, in lower case
GRAPH_TRIGGERS = (
    r"\bwhen\b", r"\bdate\b", r"\bstart\b", r"\bend\b", r"\bexpir", r"\brelationship\b", r"\bconnect", r"\blink\b", r"\bassociat", r"\bcontract\s*number\b",
    r"\bagree", r"\bissu", r"\bcompan", r"\borganiz", r"\bprovider\b", r"\bvendor\b", r"\bamount\b", r"\bprice\b", r"\bcost\b", r"\bvalue\b",
    r"\band\b.*\bdate\b", r"\band\b.*\bnumber\b",
)
# fixed values: what asks for a comparison
COMPARES = (
    r"(?iU)\b(?:compare|contrast|difference|similar|both|between|versus|vs\.?|across\s+(?:documents?|files?)|multiple\s+(?:documents?|files?)|"
    r"from\s+(?:both|all|different)\s+(?:documents?|files?))\b"
)
# fixed values: words that tell what a question is about
INTENTS = {
    "document": ("document", "file", "upload", "content", "text", "pdf", "invoice", "order", "report", "contract"),
    "lifecycle": ("lifecycle", "process", "workflow", "status", "stage", "phase"),
    "risk": ("risk", "danger", "alert", "warning", "threat", "vulnerability", "score", "prediction"),
    "outcome": ("outcome", "result", "conclusion", "final", "end result", "achievement"),
    "event": ("event", "activity", "action", "occurrence", "incident", "happened", "when"),
    "relationship": ("related", "connected", "linked", "relationship", "association", "graph", "network"),
    "statistics": ("how many", "count", "number", "total", "statistics", "stats", "summary", "overview"),
    "tech_stack": ("tech stack", "architecture", "database", "neo4j", "qdrant", "postgres", "system", "infrastructure"),
}
# fixed values: requests of administrators, and what the assistant does not answer
FILE_LIST = (
    r"(?iU)\b(list|show|display|what|which|all|get|give|tell).{0,30}(file|document|upload|doc)s?\b|\b(uploaded|available)\s+(file|document|doc)s?\b|\bfile\s*(list|name)s?\b"
)
DOCUMENT_READ = (
    r"(?iU)\b(show|display|read|print|give|fetch|get)\b.{0,50}\.(pdf|xml|txt|docx|json|csv|html|pptx|md)\b|whole\s+document|entire\s+document|every\s+line|as\s+it\s+is|full\s+content"
    r"|contents?\s+of\s+\w"
)
LOG_VIEW = (
    r"(?iU)\b(error|system|access|recent|latest|last|show|get)\s+(log|error|warning)s?\b|\blog\s+(entry|entries|file)\b|\b(what|show|get|access)\s+.{0,20}log\b"
)
SECRET_TERMS = ("password", "api key", "secret", "access token", "private key", "jwt")
DANGEROUS_TERMS = ("drop database", "delete all", "wipe data", "bypass auth")
# fixed values: an arithmetic expression in a question
EXPRESSION = r"(\d[\d\s\+\-\*\/\.\(\)%]{1,50}\d)"


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return R.any_of([F.contains(text, F.lit(w)) for w in words])


def inferred_roles(text: Column) -> Column:
    """Who may read an upload: all if the text says that it is public, else administrators."""
    return F.when(holds_any(F.lower(text), PUBLIC_SIGNALS), F.array(F.lit("public"), F.lit("user"), F.lit("admin"))).otherwise(F.array(F.lit("admin")))


def readable_documents(chunks: DataFrame, role: str) -> DataFrame:
    """(doc_key): documents whose first chunk (by id) names the role; a document without roles is closed."""
    first = chunks.groupBy("doc_key").agg(F.min_by("access_roles", "chunk_id").alias("roles"))
    return first.where(F.array_contains("roles", role)).select("doc_key")


def set_roles(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """chunks with the roles of changes(doc_key, roles) where the document has some; all other rows as they are."""
    new = changes.groupBy("doc_key").agg(F.max("roles").alias("_roles"))
    return chunks.join(new, "doc_key", "left").withColumn("access_roles", F.coalesce("_roles", "access_roles")).drop("_roles")


def rename_files(chunks: DataFrame, renames: DataFrame) -> DataFrame:
    """chunks with the new names of renames(doc_key, new_key); of several for a document the least counts, chains are not followed."""
    new = renames.where("new_key <> ''").groupBy("doc_key").agg(F.min("new_key").alias("_new"))
    return chunks.join(new, "doc_key", "left").withColumn("doc_key", F.coalesce("_new", "doc_key")).drop("_new").select(*chunks.columns)


def of_file(chunks: DataFrame, doc_key: str | None) -> DataFrame:
    """Chunks of one document, or all, that are not blank."""
    rows = chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows if doc_key is None else rows.where(F.col("doc_key") == doc_key)


def score_gate(ranked: DataFrame, least: float) -> DataFrame:
    """Rows of each query that score at least that much; all of a query where none does."""
    passes = F.max((F.col("score") >= least).cast("int")).over(W.partitionBy("query_id"))
    return ranked.withColumn("_some", passes).where((F.col("score") >= least) | (F.col("_some") == 0)).drop("_some")


def overlap_score(query: Column, text: Column) -> Column:
    """The default scorer: share of the query's different tokens that the text has."""
    asked = F.array_distinct(R.tokens(query))
    return F.size(F.array_intersect(asked, R.tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(ranked: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """The k best of ranked(query_id, query, chunk_id, doc_key, text, rank) by a scorer of the query's first 300 and the text's first 600 characters.

    Ties keep the order given; without a scorer that order is kept. A scorer may be a pandas UDF.
    """
    cut = lambda c, n: F.substring(c, 1, n)
    score = F.lit(0.0) if scorer is None else F.round(scorer(cut("query", 300), cut("text", 600)), 9)
    rows = ranked.withColumn("score", score).withColumnRenamed("rank", "before")
    return R.top_k(rows, ["query_id"], [F.desc("score"), F.asc("before")], k)


def multi_hop(parts: DataFrame, chunks: DataFrame, k: int, per_part: int = 10) -> DataFrame:
    """(query_id, chunk_id, doc_key, score, rank): every part of a question retrieves and re-ranks; a chunk keeps its best score.

    parts(query_id, part, text). Retrieval is lexical: vectors of the parts are the caller's business.
    """
    asked = parts.select(F.struct("query_id", "part").alias("query_id"), F.col("text").alias("query"))
    hits = R.top_k(R.bm25(chunks, asked), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 2 * per_part).drop("score")
    hits = checkpoint(hits)  # a few rows a part: their texts are then looked up without moving the others
    rows = hits.join(asked, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    best = rerank(rows, per_part).groupBy("query_id.query_id", "chunk_id", "doc_key").agg(F.max("score").alias("score"))
    return R.top_k(best, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def vector_confidence(chunks: DataFrame, queries: DataFrame, role: str) -> DataFrame:
    """(query_id, rag): cosine of the best chunk that names the role, administrators included; 0 without one."""
    seen = chunks.where(F.array_contains("access_roles", role))
    best = R.vector_rank(seen, queries.select("query_id", "query_vector"), 1).select("query_id", "score")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("rag"))


def graph_confidence(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, graph): share of the names that the graph knows; without names 0.4 if the first word stands in a node's name.

    asked(query_id, query, names), nodes(name). The names are few and joined by equality; first
    words are matched inside names for the questions without any.
    """
    per = asked.select("query_id", F.explode("names").alias("name")).join(nodes.select("name", F.lit(1).alias("hit")).distinct(), "name", "left")
    share = per.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share"))
    word = F.lower(F.split(F.trim("query"), r"\s+")[0])
    bare = asked.where(F.size("names") == 0).select("query_id", word.alias("word"))
    known = bare.join(nodes, F.contains(F.lower(nodes["name"]), bare["word"]), "left_semi").select("query_id", F.lit(0.4).alias("found"))
    rows = asked.select("query_id").join(share, "query_id", "left").join(known, "query_id", "left")
    return rows.select("query_id", F.coalesce("share", "found", F.lit(0.0)).alias("graph"))


def question_parts(question: Column) -> Column:
    """Up to three parts of a question, cut at question marks, "and", semicolons and line ends; the question where nothing is left."""
    parts = F.filter(F.transform(F.split(question, r"(?iU)\?|\band\b|;|\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(question)).otherwise(F.slice(parts, 1, 3))


def query_flags(query: Column) -> dict[str, Column]:
    """What a question needs: graph, calculator, graph triggers, comparison."""
    return {
        "needs_graph": query.rlike(NEEDS_GRAPH), "needs_calculator": query.rlike(NEEDS_CALCULATOR),
        "graph_trigger": R.any_of([F.lower(query).rlike("(?U)" + p) for p in GRAPH_TRIGGERS]), "compares": query.rlike(COMPARES),
    }


def intents(question: Column) -> dict[str, Column]:
    """What a question is about; where no word tells, everything."""
    q = F.lower(question)
    told = {name: holds_any(q, words) for name, words in INTENTS.items()}
    none = ~R.any_of(list(told.values()))
    return {name: c | none for name, c in told.items()}


def admin_intent(question: Column) -> Column:
    """file_list, log_view or null: lists of files unless a document is to be read, then logs."""
    return F.when(question.rlike(FILE_LIST) & ~question.rlike(DOCUMENT_READ), "file_list").when(question.rlike(LOG_VIEW), "log_view")


def guard(question: Column) -> Column:
    """secret, destructive or null: what the assistant does not answer."""
    q = F.lower(question)
    return F.when(holds_any(q, SECRET_TERMS), "secret").when(holds_any(q, DANGEROUS_TERMS), "destructive")


def word_cap(answer: Column, role: Column, most: int = 150) -> Column:
    """Answers of more words are cut to the first, with an ellipsis, for all but administrators."""
    words = F.split(F.trim(answer), r"\s+")
    return F.when((role != "admin") & (F.size(words) > most), F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("…"))).otherwise(answer)


def cut_summary(text: Column, most: int = 6000) -> Column:
    """Longer texts are cut, back to the last full stop if that is beyond 70 %, and marked."""
    head = F.substring(text, 1, most)
    last = most - F.locate(".", F.reverse(head)) + 1  # characters up to the last full stop
    kept = F.when(head.contains(".") & (last - 1 > most * 0.7), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(kept, F.lit("\n[Context truncated for LLM]")))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}


def evaluate(expression: str) -> float | None:
    """Value of an expression of numbers, + - * / % and brackets; None for anything else."""

    def of(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return of(node.operand) if isinstance(node.op, ast.UAdd) else -of(node.operand)
        raise ValueError(expression)

    try:
        return float(of(ast.parse(expression.strip(), mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return None


def calculations(queries: DataFrame) -> DataFrame:
    """(query_id, n, expression, value) of the arithmetic in queries(query_id, query); what cannot be evaluated is left out."""
    value = F.pandas_udf(lambda s: s.map(evaluate).astype("float64"), "double")
    rows = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(EXPRESSION), F.lit(1))).alias("n", "expression"))
    return rows.select("query_id", "n", F.trim("expression").alias("expression"), value("expression").alias("value")).where("value is not null and not isnan(value)")


def fuse_context(graph: Column, calculations: Column, documents: Column, most_graph: int = 1600) -> Column:
    """Graph text (cut), calculations and documents, those that there are, apart by blank lines."""
    some = lambda head, text: F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit(head), text))
    return F.concat_ws("\n\n", some("[Knowledge Graph]\n", F.substring(graph, 1, most_graph)), some("[Calculations]\n", calculations), some("[Documents]\n", documents))


def labelled_context(ranked: DataFrame, per_document: int = 5) -> DataFrame:
    """(query_id, context): the best chunks of every document under its name, documents by name."""
    kept = R.top_k(ranked.drop("rank"), ["query_id", "doc_key"], [F.desc("score"), F.asc("chunk_id")], per_document)
    own = F.array_sort(F.collect_list(F.struct("rank", "text")))
    docs = kept.groupBy("query_id", "doc_key").agg(F.concat(F.lit("=== "), F.first("doc_key"), F.lit(" ===\n"), F.array_join(F.transform(own, lambda r: r["text"]), "\n")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("doc_key", "part")))
    return docs.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"))


def mentioned_in_comparison(queries: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, doc_key): files one of whose stem's words (of three characters or more) stands inside the query.

    A word stands inside a query if it is a piece of one of its words or of several in a row. Words
    meet the queries through their rarest pieces; a word that all queries hold gives all its rows, as it must.
    """
    stem = F.regexp_replace(F.lower("doc_key"), r"\.[^.]+$", "")
    words = names.select("doc_key", F.explode(F.array_distinct(F.split(stem, r"[\s_\-./\\]+"))).alias("word")).where(F.length("word") >= least)
    asked = queries.select(F.col("query_id").alias("long_id"), F.lower("query").alias("t"))
    found = contained(words.select(F.col("word").alias("short_id"), F.col("word").alias("s")).distinct(), asked)
    return found.join(words, F.col("short_id") == F.col("word")).select(F.col("long_id").alias("query_id"), "doc_key").distinct()


def similar_before(log: DataFrame, last: int = 10, shared: int = 3) -> DataFrame:
    """(log_id, before): the most recent of a user's last questions with that many words in common, not the same question.

    Users with fewer than three earlier questions get none. Only the last questions are held per row.
    """
    order = W.partitionBy("user_id").orderBy("created_at", "log_id")
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    past = F.collect_list("question").over(order.rowsBetween(-last, -1))
    rows = log.select("log_id", "question", past.alias("past"), (F.row_number().over(order) - 1).alias("n"))
    like = F.filter("past", lambda p: (F.size(F.array_intersect(words(p), words("question"))) >= shared) & (p != F.col("question")))
    return rows.where("n >= 3").select("log_id", F.try_element_at(like, F.lit(-1)).alias("before")).where("before is not null")


def keep_newest(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most that many rows of each key, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def semantic_and_metadata(hits: DataFrame, documents: DataFrame, text: str, fixed: float = 0.5) -> DataFrame:
    """(doc_id, file_name, score): semantic hits(doc_id, score), and documents whose metadata hold the text at a fixed score; best first.

    documents(doc_id, file_name, doc_type, entities). Order: score, then file name, both descending.
    """
    t = F.lit(text.lower())
    held = F.contains(F.lower("file_name"), t) | F.contains(F.lower("doc_type"), t) | F.exists("entities", lambda e: F.contains(F.lower(e), t))
    other = documents.where(held).join(hits, "doc_id", "left_anti").select("doc_id", "file_name", F.lit(fixed).alias("score"))
    return hits.join(documents.select("doc_id", "file_name"), "doc_id").select("doc_id", "file_name", "score").unionByName(other).orderBy(F.desc("score"), F.desc("file_name"))


def index_is_stale(has_index: Column, size: Column, indexed: Column, age_seconds: Column) -> Column:
    """Whether a lexical index is to be built: none yet, more than 5 % larger, or older than an hour."""
    return ~has_index | (size > indexed * 1.05) | (age_seconds > 3600)


def normal_question(question: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(question)), r"\s+", " ")


def feedback_tally(feedback: DataFrame) -> DataFrame:
    """(question, pos, neg, modifier): tallies of feedback(question, positive) by normalised question."""
    rows = feedback.groupBy(normal_question(F.col("question")).alias("question")).agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    return rows.withColumn("modifier", R.feedback_modifier(F.col("pos"), F.col("neg")))


def transcript(log: DataFrame, last: int | None = None) -> DataFrame:
    """(session_id, turn, question): a session's questions in order of time, all or the last few."""
    newest = log if last is None else keep_newest(log, ["session_id"], [F.desc("created_at"), F.desc("log_id")], last)
    return newest.withColumn("turn", F.row_number().over(W.partitionBy("session_id").orderBy("created_at", "log_id"))).select("session_id", "turn", "question")


def file_list(local: DataFrame, indexed: DataFrame) -> DataFrame:
    """(name, origin): names of both lists, once without regard to case; a local name goes before an indexed one."""
    both = local.select("name", F.lit(0).alias("o")).unionByName(indexed.select("name", F.lit(1).alias("o")))
    first = both.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("o", "name")).alias("f"))
    return first.select("f.name", F.when(F.col("f.o") == 0, "local").otherwise("indexed").alias("origin"))


def source_label(name: Column, line: Column) -> Column:
    """What a chunk is cited as: its file, "unknown" without one, and its line."""
    return F.concat(F.coalesce(name, F.lit("unknown")), F.when(line.isNotNull(), F.format_string(" (line %d)", line)).otherwise(""))


def job_summary(jobs: DataFrame, recent: int = 20) -> tuple[DataFrame, DataFrame]:
    """(totals, recent): ingest jobs(job_id, status, created_at, n_done, n_errors) that run, and the newest; sums of done and errors."""
    totals = jobs.agg(
        F.count_if(F.col("status").isin("queued", "running")).alias("active"), F.sum("n_done").alias("done"), F.sum("n_errors").alias("errors")
    )
    return totals, jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(recent)


def typed_scorer(function: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A scorer for rerank() and grounding() from a function over batches of queries and texts."""
    return F.pandas_udf(function, "double")
