"""Reading and assembling evidence: document reads, file mentions, compression, contexts, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators.containment import contained
from docweave.operators.graph import checkpoint

SENTENCE_END = r"(?<=[.!?])\s+"
# fixed values: requests for more than a passage, read in lower case
EXFILTRATION = (
    r"give me (the |all |the full |)document", r"show me (the |all |)document", r"list (all |the |)(document|file) name",
    r"what (are |is )(the |all )?(document|file) name", r"all file", r"full document", r"entire document", r"raw (document|file|text|content|data)",
    r"dump (the |all |)(document|file|data|content)", r"export (the |all |)(document|file|data)", r"print (the |all |full |)(document|file|content)",
    r"share (the |all |)(document|file|source)", r"send me (the |all |)(document|file)", r"leak", r"reveal (the |all |)(document|file|source|content)",
    r"background code", r"source code", r"backend code", r"system prompt", r"ignore (previous|above|all) instruction",
)


def exfiltrates(query: Column, role: Column) -> Column:
    """Whether a caller who is no admin asks for whole documents or internals."""
    return (role != "admin") & F.lower(query).rlike("|".join(EXFILTRATION))


def number_in(query: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(query, pattern, group), F.lit("")).cast("int")


def read_request(query: Column) -> dict[str, Column]:
    """range_start, range_end, line, full: what part of a document a query asks for; a range goes before a line."""
    span = r"(?i)\blines?\s+(\d+)\s*(?:to|-|–|through|and)\s*(\d+)\b"
    start, end = number_in(query, span, 1), number_in(query, span, 2)
    line = F.coalesce(number_in(query, r"(?i)\blines?\s*(?:number\s+)?[#:\-]?\s*(\d+)\b"), number_in(query, r"(?i)\b(\d+)(?:st|nd|rd|th)\s+lines?\b"))
    full = query.rlike(r"(?i)\b(?:full|complete|entire|whole|all\s+(?:lines|content|text)|everything\s+in|contents?\s+of)\b")
    return {"range_start": start, "range_end": end, "line": F.when(start.isNull(), line), "full": full & start.isNull() & line.isNull()}


def read_lines(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, line_no, line) of requests(query_id, doc_key, range_start, range_end, line, full) from docs(doc_key, text).

    A range is clamped to the document, a whole read gives all lines, anything else the first twenty.
    """
    lines = F.split("text", "\n")
    rows = requests.join(docs, "doc_key").select("query_id", "range_start", "range_end", "line", "full", F.posexplode(lines).alias("at", "content"))
    n = F.col("at") + 1
    wanted = (
        F.when(F.col("range_start").isNotNull(), n.between(F.greatest(F.lit(1), "range_start"), F.col("range_end")))
        .when(F.col("line").isNotNull(), n == F.col("line"))
        .when(F.col("full"), F.lit(True))
        .otherwise(n <= 20)
    )
    return rows.where(wanted).select("query_id", n.alias("line_no"), F.col("content").alias("line_text"))


def stem_words(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(name), r"\.[^.]+$", ""), r"[\s_\-./\\]+")), lambda w: F.length(w) >= 3)


def mentioned_files(queries: DataFrame, names: DataFrame, least: float = 0.4) -> DataFrame:
    """(query_id, doc_key, score): the file name that a query mentions best.

    The stem inside the query scores 1, otherwise the share of its words that the query has, two at
    least unless it is one word; ties by name. Word matches go through an equi-join on the words, stems through a
    containment join, so names without a word of three characters are found too. Queries of one wording and names
    of the same words are compared once. A row is given for each row of queries that mentions a name.
    """
    words = F.array_sort(F.filter(F.array_distinct(F.split(F.lower("query"), r"[\s_\-./\\]+")), lambda w: F.length(w) >= 3))
    queries = queries.where("query is not null").select("query_id", F.lower("query").alias("query"))
    kinds = queries.select("query").distinct()
    sets = kinds.select("query", words.alias("asked"))
    # names of the same words score alike, and the least of them counts
    of = names.select("doc_key", F.array_sort(stem_words(F.col("doc_key"))).alias("words")).groupBy("words").agg(F.min("doc_key").alias("doc_key"))
    asked = sets.select("asked").distinct().select("asked", F.explode("asked").alias("word"))
    hits = asked.join(of.select("doc_key", F.size("words").alias("n"), F.explode("words").alias("word")), "word").groupBy("asked", "doc_key", "n").agg(F.count("*").alias("k"))
    share = F.when((F.col("k") < 2) & (F.col("n") > 1), 0.0).otherwise(F.col("k") / F.col("n"))
    lead = lambda rows, key: rows.where(F.col("score") >= least).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_key")).alias("b"))
    by_words = sets.join(lead(hits.select("asked", "doc_key", share.alias("score")), "asked"), "asked").select("query", "b")
    stem = F.regexp_replace(F.lower("doc_key"), r"\.[^.]+$", "")
    inside = contained(names.select(F.col("doc_key").alias("short_id"), stem.alias("s")), kinds.select(F.col("query").alias("long_id"), F.col("query").alias("t")))
    whole = lead(inside.select(F.col("long_id").alias("query"), F.col("short_id").alias("doc_key"), F.lit(1.0).alias("score")), "query")
    best = by_words.unionByName(whole).groupBy("query").agg(F.min("b").alias("b"))
    return queries.join(best, "query").select("query_id", "b.doc_key", (-F.col("b.s")).alias("score"))


def key_sentences(text: Column, most: int | Column) -> Column:
    """The first sentence and the longest others that fit into most characters, in the text's order; short texts as they are."""
    sentences = F.split(F.trim(text), SENTENCE_END)
    rest = F.transform(F.slice(sentences, 2, 1_000_000), lambda s, i: F.struct((-F.length(s)).alias("size"), i.alias("at"), s.alias("s")))
    state = "struct<left int, kept array<struct<at int, s string>>>"
    start = F.struct((F.lit(most) - F.length(sentences[0])).alias("left"), F.array(F.struct(F.lit(-1).alias("at"), sentences[0].alias("s"))).alias("kept")).cast(state)
    add = lambda acc, r: F.when(
        (acc["left"] > 0) & (-r["size"] <= acc["left"]),
        F.struct((acc["left"] + r["size"] - 1).alias("left"), F.array_append(acc["kept"], F.struct(r["at"], r["s"])).alias("kept")),
    ).otherwise(acc)
    picked = F.aggregate(F.array_sort(rest), start, add, lambda acc: F.array_join(F.transform(F.array_sort(acc["kept"]), lambda k: k["s"]), " "))
    return F.when(F.length(text) <= most, text).otherwise(picked)


def assemble(ranked: DataFrame, budget: int = 8000, most: int = 8) -> DataFrame:
    """(query_id, context, sources): the best passages, each cut to its share of the budget, with their documents.

    ranked(query_id, rank, doc_key, text); passages are joined by a rule line and the whole is cut at the budget.
    """
    kept = ranked.where(F.col("rank") <= most)
    n = F.count("*").over(W.partitionBy("query_id"))
    part = F.substring(F.col("text"), F.lit(1), F.floor(budget / n).cast("int"))
    rows = kept.withColumn("part", F.concat(F.lit("["), F.col("doc_key"), F.lit("] "), part))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part", "doc_key")))
    whole = F.array_join(F.transform(ordered, lambda r: r["part"]), "\n---\n")
    return rows.groupBy("query_id").agg(F.substring(whole, 1, budget).alias("context"), F.array_distinct(F.transform(ordered, lambda r: r["doc_key"])).alias("sources"))


def navigation_match(queries: DataFrame, nav: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """(query_id, url, shared): the page whose title shares most words with the query, at least one; ties by url.

    Titles of one address count together. Each different set of asked words meets the pages by the rarest of its
    words, which sets a mark; a page that reaches the mark must have one of the rarest words, so only these are
    looked up, however common the others are.
    """
    split = lambda c: F.array_distinct(F.split(F.lower(c), r"\W+"))
    own = F.array_sort(F.array_except(split(F.col("query")), F.array(*[F.lit(w) for w in (*stop_words, "")])))
    rows = queries.select("query_id", own.alias("asked")).where(F.size("asked") > 0)
    counted = nav.select("url", F.explode(split(F.col("title"))).alias("word")).groupBy("url", "word").agg(F.count("*").alias("times"))
    bags = counted.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("word", "times"))).alias("bag"), F.max("times").alias("most"))
    bags = checkpoint(bags.groupBy("bag", "most").agg(F.min("url").alias("url")).withColumn("words", F.transform("bag", lambda b: b["word"])))
    common = bags.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    sets = rows.select("asked").distinct()
    by_rarity = sets.select("asked", F.explode("asked").alias("word")).join(common, "word").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("known"))
    sets = checkpoint(by_rarity.select("asked", F.transform("known", lambda k: k["word"]).alias("known")))
    pages = bags.select("most", "url", "bag", "words", F.explode("words").alias("word"))
    again = F.aggregate("bag", F.lit(0).cast("long"), lambda n, b: n + F.when(F.array_contains("asked", b["word"]), b["times"]).otherwise(0))
    shared = F.when(F.col("most") == 1, F.size(F.array_intersect("words", "asked")).cast("long")).otherwise(again)
    lead = lambda met: met.groupBy("asked").agg(F.min(F.struct((-shared).alias("less"), "url")).alias("best"))
    first = checkpoint(sets.join(lead(sets.select("asked", F.col("known")[0].alias("word")).join(pages, "word")), "asked"))
    # a page of repeats up to most that lacks the rarest words gets most times the others at best: below the mark where those are few
    depth = F.size("known") - F.floor((-F.col("best.less") - 1) / F.col("most")).cast("int")
    more = first.crossJoin(F.broadcast(bags.select("most").distinct())).select("asked", "most", F.explode(F.slice("known", F.lit(2), F.greatest(depth - 1, F.lit(0)))).alias("word"))
    best = first.select("asked", "best").unionByName(lead(more.join(pages, ["word", "most"]))).groupBy("asked").agg(F.min("best").alias("best"))
    return rows.join(best, "asked").select("query_id", "best.url", (-F.col("best.less")).alias("shared"))


def breadcrumbs(nav: DataFrame, deepest: int = 6) -> DataFrame:
    """(url, breadcrumb): titles from the root down, following parents at most deepest steps; cycles end there."""
    parents = nav.select(F.col("url").alias("up"), F.col("title").alias("up_title"), F.col("parent").alias("next"))
    rows = nav.select("url", F.col("parent").alias("up"), F.array("title").alias("trail"))
    for _ in range(deepest):
        rows = rows.join(parents, "up", "left").select(
            "url", F.col("next").alias("up"), F.when(F.col("up_title").isNull(), F.col("trail")).otherwise(F.concat(F.array("up_title"), F.col("trail"))).alias("trail")
        )
    return rows.select("url", F.array_join("trail", " > ").alias("breadcrumb"))


def contact_info(text: Column) -> dict[str, Column]:
    """First phone number, mail address and street address of a text; null without one."""
    first = lambda p, g=0: F.nullif(F.trim(F.regexp_extract(text, p, g)), F.lit(""))
    return {
        "phone": first(r"(?i)(?:tel:|phone:|call us:?)?\s*(\+?[\d\s\-().]{8,20}\d)", 1),
        "email": first(r"(?i)[\w.+-]+@[\w-]+\.[a-z]{2,}"),
        "address": first(r"\b\d{1,5}\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct)\b"),
    }


def authorised(calls: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Calls (call_id, api_key) with the tenant and role of the active, unexpired key whose SHA-256 they carry."""
    live = keys.where("active").where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key_hash", "key_id", "permission")
    role = F.when(F.col("permission") == "admin", "admin").when(F.col("permission") == "write", "user").otherwise("public")
    return calls.withColumn("key_hash", F.sha2("api_key", 256)).join(live, "key_hash").select("call_id", F.col("key_id").alias("tenant_id"), role.alias("role"))
