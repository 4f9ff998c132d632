"""Documents: reading files, chunking, classification, hashing and versions, pages and links."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators.automaton import family_counts
from docweave.operators.graph import checkpoint

# fixed values: keywords, document types and sensitivity of each domain
DOMAINS: dict[str, dict] = {
    "legal": {
        "keywords": (
            "contract", "agreement", "clause", "liability", "indemnification", "jurisdiction", "arbitration", "termination", "confidentiality",
            "intellectual property", "warranty", "governing law", "breach", "obligation", "party", "parties", "whereas", "herein", "hereof",
            "executed", "signatory", "notary", "affidavit", "deposition", "plaintiff", "defendant", "litigation", "subpoena", "injunction",
        ),
        "types": {
            "contract": ("contract", "agreement", "mou", "memorandum", "sla"),
            "policy": ("policy", "terms", "conditions", "guidelines"),
            "legal_brief": ("brief", "motion", "complaint", "petition"),
        },
        "entities": r"\b(?:contract|agreement|clause|section|article|amendment)\b",
        "boost": 0.3,
    },
    "finance": {
        "keywords": (
            "invoice", "revenue", "profit", "loss", "balance sheet", "income statement", "cash flow", "budget", "expense", "tax", "audit", "fiscal",
            "quarterly", "annual report", "dividend", "equity", "liability", "asset", "depreciation", "amortization", "accounts receivable",
            "accounts payable", "ebitda", "roi", "payroll", "salary", "compensation", "reimbursement", "billing", "payment", "ledger", "journal entry",
            "reconciliation",
        ),
        "types": {
            "report": ("report", "statement", "analysis", "summary"),
            "invoice": ("invoice", "receipt", "bill", "purchase order"),
            "budget": ("budget", "forecast", "projection", "plan"),
        },
        "entities": r"\$[\d,]+|(?:USD|EUR|GBP)\s*[\d,]+|\d+%\s*(?:tax|interest|rate)",
        "boost": 0.2,
    },
    "hr": {
        "keywords": (
            "employee", "salary", "leave", "resignation", "termination", "onboarding", "performance review", "appraisal", "benefits", "recruitment",
            "candidate", "interview", "offer letter", "job description", "workforce", "headcount", "attendance", "overtime", "human resources", "hr",
            "department", "manager", "promotion", "demotion", "disciplinary", "grievance", "handbook", "vacation", "sick leave", "maternity",
            "paternity",
        ),
        "types": {
            "policy": ("policy", "handbook", "guidelines", "code of conduct"),
            "letter": ("offer", "appointment", "resignation", "termination"),
            "review": ("review", "appraisal", "evaluation", "assessment"),
        },
        "entities": r"\b(?:employee|salary|leave|appraisal|recruitment)\b",
        "boost": 0.4,
    },
    "medical": {
        "keywords": (
            "patient", "diagnosis", "treatment", "prescription", "clinical", "hospital", "physician", "nurse", "medication", "dosage", "symptoms",
            "lab results", "radiology", "surgery", "procedure", "insurance", "claim", "discharge", "admission", "icd", "cpt", "hipaa",
            "medical record", "health", "disease", "therapy",
        ),
        "types": {
            "record": ("record", "report", "summary", "history"),
            "prescription": ("prescription", "rx", "medication"),
            "insurance": ("insurance", "claim", "authorization"),
        },
        "entities": r"\b(?:patient|diagnosis|medication|prescription|clinical)\b",
        "boost": 0.5,
    },
    "technical": {
        "keywords": (
            "api", "endpoint", "database", "server", "deployment", "docker", "kubernetes", "microservice", "architecture", "schema", "query",
            "function", "class", "module", "library", "framework", "sdk", "authentication", "authorization", "encryption", "ssl", "tls", "algorithm",
            "performance", "latency", "throughput", "pipeline", "ci/cd", "git", "repository", "branch", "merge", "pull request",
        ),
        "types": {
            "specification": ("spec", "specification", "requirement", "design"),
            "documentation": ("documentation", "readme", "guide", "manual"),
            "report": ("report", "analysis", "benchmark", "test"),
        },
        "entities": r"\b(?:api|function|class|database|server|endpoint)\b",
        "boost": 0.1,
    },
    "operations": {
        "keywords": (
            "logistics", "supply chain", "procurement", "vendor", "supplier", "delivery", "shipment", "inventory", "warehouse", "order", "purchase",
            "quotation", "rfp", "rfq", "bid", "tender", "quality", "compliance", "regulation", "standard", "audit", "process", "workflow", "sop",
            "procedure", "checklist",
        ),
        "types": {
            "sop": ("sop", "procedure", "process", "workflow"),
            "procurement": ("rfp", "rfq", "bid", "tender", "quotation"),
            "report": ("report", "summary", "log", "record"),
        },
        "entities": r"\b(?:vendor|procurement|shipment|logistics|inventory)\b",
        "boost": 0.15,
    },
}
# fixed values: words that make a document sensitive
HIGH = (
    "confidential", "private", "sensitive", "restricted", "secret", "classified", "do not distribute", "proprietary", "internal only", "ssn",
    "social security", "passport", "credit card", "bank account", "salary", "compensation", "medical", "patient", "hipaa", "gdpr",
)
MEDIUM = ("internal", "for internal use", "not for public", "draft", "preliminary", "pre-decisional", "deliberative")
# fixed values: page types by words of url, title, headings and the first 500 characters, first family wins
PAGE_TYPES = (
    ("about", ("about us", "who we are", "our story", "our mission", "company overview")),
    ("service", ("services", "solutions", "offerings", "what we do", "our services", "capabilities")),
    ("contact", ("contact us", "get in touch", "reach us", "our location", "contact page")),
    ("blog", ("blog", "news", "article", "insights", "press release", "latest posts")),
    ("team", ("team", "leadership", "our people", "executives", "management", "founders")),
    ("careers", ("careers", "jobs", "hiring", "join us", "open positions", "vacancies")),
    ("testimonials", ("testimonials", "reviews", "client stories", "case studies", "success stories")),
    ("product", ("product", "platform", "software", "tool", "application", "features")),
    ("pricing", ("pricing", "plans", "packages", "cost", "subscription")),
    ("faq", ("faq", "frequently asked", "questions", "help", "support")),
)
# fixed values: sections by words of the first headings and the first 200 characters, first family wins
SECTIONS = (
    ("leadership", ("ceo", "cto", "founder", "director", "executive", "leadership")),
    ("stats", ("employees", "clients", "projects", "solutions", "years", "deployed")),
    ("contact", ("address", "phone", "email", "location", "office")),
    ("testimonial", ("said", "quote", "testimonial", "review", '"', "★")),
    ("service", ("service", "solution", "offering", "what we provide")),
)
# fixed values: crawl priority by the first word that a path segment holds, in this order
URL_PRIORITY = (
    (0, "home"), (1, "about|services|solutions|products|contact"), (2, "team|leadership|careers|pricing|faq|clients|portfolio|case-study|testimonials"),
    (3, "industry|resources|partners|technology|platform"), (5, "blog|news|events|press"), (6, "legal|privacy|terms|cookie"),
    (9, "tag|category"), (8, "page"), (9, "search|login|register|cart|checkout|wp-"),
)
# fixed values: addresses that are not crawled
SKIP_URL = r"(?i)(\.pdf$|\.jpg$|\.jpeg$|\.png$|\.gif$|\.svg$|\.ico$|\.css$|\.js$|\.zip$|\.exe$|\.xml$|\?replytocom=|\?print=|\?lang=|/feed/?$|/wp-json/|/xmlrpc\.php|/__utm|/amp/|/embed/)"


#: An entity pattern that is a list of whole words.
WORD_LIST = re.compile(r"\\b\(\?:([\w|]+)\)\\b")


def named(column: str, words: tuple[str, ...]) -> Column:
    """How many of the words the file name column holds."""
    return F.expr(" + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words))


def classify_documents(docs: DataFrame, text_col: str = "text", name_col: str = "file_name") -> DataFrame:
    """Adds domain, doc_type, sensitivity and confidence: keyword density, file name hints, entity counts.

    All words of all lists are counted in one pass over a text; there is no join and no shuffle.
    """
    families: list[tuple[str, ...]] = [HIGH, MEDIUM]
    whole: list[tuple[str, ...]] = []
    n_whole = sum(WORD_LIST.fullmatch(p["entities"]) is not None for p in DOMAINS.values())

    def total(words: tuple[str, ...]) -> Column:
        families.append(words)
        return F.col("_h")[len(families) - 1]

    text, name = F.lower(F.coalesce(text_col, F.lit(""))), F.lower(F.coalesce(name_col, F.lit("")))
    rows = docs.withColumn("_t", text).withColumn("_f", name)
    t, f = "_t", "_f"
    scores = []
    for domain, profile in DOMAINS.items():
        hint = F.expr(" + ".join(f"CAST(contains(_f, '{w.replace(' ', '_')}') OR contains(_f, '{w.split(' ')[0]}') AS INT)" for w in profile["keywords"][:10])) * 0.1
        listed = WORD_LIST.fullmatch(profile["entities"])  # plain words go into the pass, other patterns are searched
        if listed:
            whole.append(tuple(listed[1].split("|")))
        entities = F.element_at("_h", F.lit(len(whole) - 2 - n_whole)) if listed else F.regexp_count(t, F.lit("(?i)" + profile["entities"]))
        score = F.round(total(profile["keywords"]) / F.greatest(F.lit(1), F.element_at("_h", -1)) + hint + entities * 0.05, 9)
        kinds = [F.struct((total(w) + 2 * named(f, w)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, w) in enumerate(profile["types"].items())]
        best = F.array_max(F.array(*kinds))
        scores.append(F.struct(score.alias("score"), F.lit(-len(scores)).alias("o"), F.lit(domain).alias("domain"), F.when(best["n"] > 0, best["kind"]).otherwise("document").alias("doc_type"), F.lit(profile["boost"]).alias("boost")))
    rows = rows.withColumn("_h", family_counts(F.col(t), families, whole)).withColumn("_best", F.array_max(F.array(*scores)))
    known = F.col("_best.score") >= 0.02
    boost = F.when(known, F.col("_best.boost")).otherwise(0.0)
    return rows.withColumns({
        "domain": F.when(known, F.col("_best.domain")).otherwise("general"),
        "doc_type": F.when(known, F.col("_best.doc_type")).otherwise("document"),
        "sensitivity": F.when((F.col("_h")[0] > 0) | (boost >= 0.4), "high").when((F.col("_h")[1] > 0) | (boost >= 0.2), "medium").otherwise("low"),
        "confidence": F.when(known, F.round(F.least(F.col("_best.score") * 10, F.lit(1.0)), 2)).otherwise(0.0),
    }).drop("_t", "_f", "_h", "_best")


def char_chunks(docs: DataFrame, size: int = 2000, step: int = 1600, id_col: str = "doc_id", text_col: str = "text", strip: bool = True) -> DataFrame:
    """(id, n, char_start, char_end, line_start, chunk): overlapping pieces of size characters, every step characters.

    The text is cut into steps in one pass; a piece is its step and the start of the next ones, so that neither
    the text nor its steps stand in every row, and no step is looked for from the text's beginning.
    """
    rows = docs.select(id_col, F.length(text_col).alias("_len"), F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_steps"))
    rows = rows.withColumn("_breaks", F.transform("_steps", lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))))

    def piece(own: Column, n: Column) -> Column:
        text = F.substring(F.array_join(F.slice("_steps", n + 1, F.lit(-(-size // step))), ""), 1, size)
        line = F.aggregate(F.slice("_breaks", F.lit(1), n), F.lit(1), lambda total, x: total + x)
        end = F.least(n * step + size, F.col("_len"))
        return F.struct((n * step).alias("char_start"), end.alias("char_end"), line.alias("line_start"), (F.trim(text) if strip else text).alias("chunk"))

    return rows.select(id_col, F.posexplode(F.transform("_steps", piece)).alias("n", "p")).select(id_col, "n", "p.*")


def rebuild(chunks: DataFrame, step: int = 1600, id_col: str = "doc_id") -> DataFrame:
    """(id, n_chunks, text): whole texts from overlapping chunks(id, char_start, chunk), in order, each read up to where the next begins."""
    last = F.max("char_start").over(W.partitionBy(id_col))
    own = chunks.withColumn("_p", F.when(F.col("char_start") == last, F.col("chunk")).otherwise(F.substring("chunk", 1, step)))
    pieces = F.array_sort(F.collect_list(F.struct("char_start", "_p")))
    return own.groupBy(id_col).agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(pieces, lambda p: p["_p"]), "").alias("text"))


def token_chunks(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, token_start, token_count, chunk): windows of white-space tokens; the last one ends the text."""
    return token_windows(docs, size, overlap, id_col, text_col).select(id_col, "n", "token_start", "token_count", F.regexp_replace("chunk", r"\s+", " ").alias("chunk"))


def token_windows(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As token_chunks, with char_start, char_end, line_start and line_end; chunk is the text between its places as it stands.

    Words with the spaces after them are cut once, into steps of size - overlap; a window is its step and the
    start of the next ones, and its place the length of the steps before it.
    """
    step = size - overlap
    text = F.regexp_replace(F.col(text_col), r"^\s+", "")
    lead = F.substring(F.col(text_col), F.lit(1), F.length(text_col) - F.length(text))
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    added = lambda c, k: F.aggregate(F.slice(c, F.lit(1), k), F.lit(0), lambda total, x: total + x)
    rows = docs.select(id_col, lead.alias("_lead"), F.regexp_extract_all(text, F.lit(r"(?s)\S+\s*"), F.lit(0)).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step))
    rows = rows.withColumn("_steps", F.transform(starts, lambda at: F.array_join(F.slice("_words", at + 1, F.lit(step)), "")))
    rows = rows.withColumns({"_lengths": F.transform("_steps", lambda s: F.length(s)), "_breaks": F.transform("_steps", lines)})

    def window(at: Column, n: Column) -> Column:
        chunk = F.regexp_replace(F.array_join(F.slice("_words", at + 1, F.lit(size)), ""), r"\s+$", "")
        start, line = F.length("_lead") + added("_lengths", n), lines(F.col("_lead")) + added("_breaks", n) + 1
        return F.struct(
            at.alias("token_start"), F.least(F.lit(size), F.size("_words") - at).alias("token_count"), start.alias("char_start"), (start + F.length(chunk)).alias("char_end"),
            line.alias("line_start"), (line + lines(chunk)).alias("line_end"), chunk.alias("chunk"),
        )

    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_words") - overlap - 1), F.lit(step)), window)
    return rows.select(id_col, F.posexplode(windows).alias("n", "w")).select(id_col, "n", "w.*")


def sentence_packs(pages: DataFrame, id_col: str, text_col: str, most: int = 800, overlap: int = 20, least: int = 50) -> DataFrame:
    """(id, n, chunk): sentences packed up to most characters; a new chunk begins with the last words of the one before.

    An ordered fold over one text's sentences, as an aggregate over their array.
    """
    state = "struct<done array<string>, now string>"
    kept = lambda acc: F.when(F.length(acc["now"]) > least, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])

    def add(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) + 1 <= most
        words = F.split(acc["now"], " ")
        tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - overlap + 1), F.lit(overlap)), " ")
        return F.when(fits, F.struct(acc["done"].alias("done"), F.trim(F.concat_ws(" ", acc["now"], s)).alias("now"))).otherwise(
            F.struct(kept(acc).alias("done"), F.trim(F.concat_ws(" ", tail, s)).alias("now"))
        )

    sentences = F.filter(F.transform(F.split(text_col, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    packed = F.aggregate(sentences, F.expr(f"cast(named_struct('done', array(), 'now', '') as {state})"), add, kept)
    return pages.select(id_col, F.posexplode(packed).alias("n", "chunk"))


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def upsert_versions(registry: DataFrame, uploads: DataFrame) -> DataFrame:
    """registry(doc_key, content_hash, version) and uploads(doc_key, content_hash): (doc_key, action, version).

    The same hash is unchanged, another one the next version, an unknown key version 1.
    """
    up = uploads.select("doc_key", F.col("content_hash").alias("new_hash"))
    return up.join(registry, "doc_key", "left").select(
        "doc_key",
        F.when(F.col("version").isNull(), "new").when(F.col("content_hash") == F.col("new_hash"), "unchanged").otherwise("updated").alias("action"),
        F.when(F.col("version").isNull(), 1).when(F.col("content_hash") == F.col("new_hash"), F.col("version")).otherwise(F.col("version") + 1).alias("version"),
    )


# fixed values: character references that page texts decode, in this order
REFERENCES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#8217;", "'"), ("&#8216;", "'"),
    ("&#8220;", '"'), ("&#8221;", '"'), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
)


def decoded(text: Column) -> Column:
    for reference, character in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def stripped(html: Column) -> Column:
    """Without tags, white space runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def meta_of(html: Column, name: str, attribute: str = "name") -> Column:
    """Content of a meta tag, whichever attribute comes first; empty without one."""
    value = r"""["']([^"']+)["']"""
    key = rf"""{attribute}=["'](?:twitter:|){name}["']"""
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (rf"(?i)<meta[^>]+{key}[^>]+content={value}", rf"(?i)<meta[^>]+content={value}[^>]+{key}")]
    return F.coalesce(*[stripped(f) for f in found], F.lit(""))


def page_meta(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds description, og_title, og_description, og_image, json_ld (blocks as text), nav_links (25 at most, "label → address")."""
    html = F.col(html_col)
    nav = F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    link = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    links = F.arrays_zip(F.regexp_extract_all(nav, F.lit(link), F.lit(1)), F.regexp_extract_all(nav, F.lit(link), F.lit(2)))
    labelled = F.filter(F.transform(links, lambda m: F.struct(stripped(m["1"]).alias("label"), m["0"].alias("to"))), lambda m: m["label"] != "")
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return pages.withColumns({
        "description": meta_of(html, "description"), "og_title": meta_of(html, "og:title", "property"), "og_description": meta_of(html, "og:description", "property"),
        "og_image": meta_of(html, "og:image", "property"), "json_ld": F.transform(blocks, F.trim),
        "nav_links": F.slice(F.transform(labelled, lambda m: F.concat(m["label"], F.lit(" → "), m["to"])), 1, 25),
    })


def linked_data(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", deepest: int = 6) -> DataFrame:
    """(id, type, name) of the nodes of JSON-LD blocks: a row for each type of a node, nested in arrays, @graph or other nodes up to deepest levels.

    Blocks are parsed as variants; what is not JSON is skipped. Nodes without a name are left out, a node that is
    repeated on a page comes once.
    """
    spark = pages.sparkSession
    block = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    level = pages.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(block), F.lit(1))).alias("t"))
    level = level.select("id", F.try_parse_json("t").alias("v")).where("v is not null")
    every = level
    for _ in range(deepest):
        level = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", F.col("value").alias("v"))
        every = every.unionByName(level)
    kinds = F.coalesce(F.try_variant_get("v", '$["@type"]', "array<string>"), F.array(F.try_variant_get("v", '$["@type"]', "string")))
    found = every.select("id", F.explode(kinds).alias("type"), F.trim(F.try_variant_get("v", "$.name", "string")).alias("name"))
    return found.where("type is not null and name <> ''").distinct().withColumnRenamed("id", id_col)


def same_domain(url: Column, domain: Column) -> Column:
    """Whether an address is on the domain, with or without www."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return (host == domain) | (host == F.concat(F.lit("www."), domain)) | (F.concat(F.lit("www."), host) == domain)


def organisation(url: Column) -> Column:
    """The first part of the host as a name; the address itself where it has no host."""
    host = F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit("www."), F.lit(""))
    return F.coalesce(F.initcap(F.substring_index(host, ".", 1)), url)


def people_in(html: Column, most: int = 20) -> Column:
    """Names of the persons that JSON-LD blocks describe, each once."""
    person = r'(?is)"@type"\s*:\s*"Person"[^{}]*?"name"\s*:\s*"([^"]+)"|"name"\s*:\s*"([^"]+)"[^{}]*?"@type"\s*:\s*"Person["]'
    names = F.zip_with(F.regexp_extract_all(html, F.lit(person), F.lit(1)), F.regexp_extract_all(html, F.lit(person), F.lit(2)), lambda a, b: F.trim(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    return F.slice(F.array_distinct(names), 1, most)


def crawl(seeds: DataFrame, links: DataFrame, most: int = 500, deepest: int = 6, link: Column | str = "link") -> DataFrame:
    """(url, depth, score, seq): pages in the order of a crawl, level by level, each once, the best score of a level first.

    seeds(url), links(url, link). A level is one join of the frontier with the links and an anti-join with what was
    seen; skipped addresses (score 999) are not followed. link may be any expression over the rows of links, an
    explode too: it is computed for rows that the frontier meets. What is new is written before it is scored, else
    the scoring would be pushed down to every link of every page on every level.
    """
    link = F.col(link) if isinstance(link, str) else link
    front = seeds.select(normal_url(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct()
    seen = checkpoint(front)
    for depth in range(1, deepest + 1):
        front = seen.where(F.col("depth") == depth - 1)
        met = front.join(links, "url").select(link.alias("link")).select(normal_url(F.col("link")).alias("url")).distinct()
        new = checkpoint(met.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        new = new.where(url_priority(F.col("url"), F.col("depth")) < 999)
        if new.isEmpty():
            break
        seen = checkpoint(seen.unionByName(new))
    scored = seen.withColumn("score", url_priority(F.col("url"), F.col("depth")))
    return scored.orderBy("depth", "score", "url").limit(most).withColumn("seq", F.row_number().over(W.orderBy("depth", "score", "url")))


def page_parts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title, headings, n_links and main_text of the html, by patterns on the JVM."""
    html, clean = F.col(html_col), stripped
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|aside)\b.*?</\1>", " ")
    return pages.withColumns({
        "title": clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "headings": F.slice(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), clean), 1, 35),
        "n_links": F.size(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s+href="([^"]*)"'), F.lit(1)))),
        "main_text": decoded(clean(body)),
    })


def path_of(url: Column) -> Column:
    """The path of an address, whatever follows it; empty without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def first_family(text: Column, families: tuple[tuple[str, tuple[str, ...]], ...], otherwise: Column) -> Column:
    out = F
    for name, words in families:
        out = out.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name)
    return out.otherwise(otherwise)


def page_type(url: Column, title: Column, headings: Column, text: Column) -> Column:
    whole = F.lower(F.concat_ws(" ", url, title, F.array_join(F.slice(headings, 1, 5), " "), F.substring(text, 1, 500)))
    path = F.regexp_replace(path_of(url), "^/+|/+$", "")
    return first_family(whole, PAGE_TYPES, F.when(path.isin("", "index.html"), "home").otherwise("other"))


def page_section(headings: Column, text: Column) -> Column:
    whole = F.lower(F.concat_ws(" ", F.array_join(F.slice(headings, 1, 3), " "), F.substring(text, 1, 200)))
    return first_family(whole, SECTIONS, F.when(F.size(headings) > 0, F.substring(headings[0], 1, 50)).otherwise("general"))


def normal_url(url: Column) -> Column:
    """Without fragment and trailing slashes; nothing left: as it was."""
    cut = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    return F.when(cut == "", url).otherwise(cut)


def url_priority(url: Column, depth: Column) -> Column:
    """Crawl priority, lower first: skipped 999, home 0, the first keyword of the first segment with one, else 4; and depth."""
    path = F.lower(path_of(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def of(segment: Column) -> Column:
        out = F
        for score, words in URL_PRIORITY:
            out = out.when(segment.rlike(words), score)
        return out.otherwise(F.lit(None))

    known = F.filter(F.transform(segments, of), lambda s: s.isNotNull())
    return (
        F.when(url.rlike(SKIP_URL), 999)
        .when(F.size(known) > 0, F.get(known, F.lit(0)) + depth)
        .when(F.size(segments) == 0, 0)
        .otherwise(4 + depth)
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int | None = None) -> DataFrame:
    """(url, n, link): distinct links of an address that stay on its host, relative ones resolved, in order; all of them, or the first most.

    Pages of one address count together: a link stands where any of them has it first, ties by the link.
    """
    host = F.regexp_extract(url_col, r"^(https?://[^/]+)", 1)
    links = F.transform(
        F.regexp_extract_all(html_col, F.lit(r'(?i)<a\s+href="([^"#]+)"'), F.lit(1)), lambda a: F.when(a.startswith("/"), F.concat(host, a)).otherwise(a)
    )
    rows = pages.select(F.col(url_col).alias("_url"), host.alias("_host"), links.alias("_links")).select(F.col("_url").alias("url"), "_host", F.posexplode("_links").alias("at", "link"))
    first = rows.where(F.startswith("link", "_host")).groupBy("url", "link").agg(F.min("at").alias("at"))
    n = F.row_number().over(W.partitionBy("url").orderBy("at", "link"))
    rows = first.select("url", (n - 1).alias("n"), "link")
    return rows if most is None else rows.where(F.col("n") < most)


def stats_in(text: Column, most: int = 20) -> Column:
    """Distinct "number label" pairs of a text."""
    pattern = r"(?i)\b(\$?[\d,]+(?:\.\d+)?(?:[kmb]|\+|%)?\+?)\s+([A-Za-z][A-Za-z\s+\-&]{2,30})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))
    return F.slice(F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(" ", F.trim(p["0"]), F.trim(p["1"])))), 1, most)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


# fixed values: document types by patterns, first family wins, file name before text
DOCUMENT_TYPES = (
    ("Patient Record", (r"patient\s*record\b", r"medical\s*record\b", r"vital\s*signs", r"diagnosis\s*:")),
    ("Medical Report", (r"medical\s*report\b", r"clinical\s*report", r"lab\s*result")),
    ("Prescription", (r"prescription\b", r"medication\s*order\b", r"rx\b")),
    ("Resume", (r"resume\b", r"\bcv\b", r"curriculum\s*vitae", r"professional\s*summary")),
    ("Application", (r"application\s*form\b", r"job\s*application\b", r"candidate\s*:")),
    ("Offer Letter", (r"offer\s*letter\b", r"job\s*offer\b", r"employment\s*offer\b")),
    ("Financial Statement", (r"financial\s*statement\b", r"financial\s*report")),
    ("Compliance Report", (r"compliance\s*report\b", r"regulatory\s*compliance")),
    ("Expense Report", (r"expense\s*report\b", r"expense\s*statement")),
    ("Invoice", (r"\binvoice\b", r"invoice\s*number", r"bill\s*to\b")),
    ("Purchase Order", (r"purchase\s*order\b", r"\bpo\s*#\b")),
    ("Contract", (r"contract\b", r"agreement\b", r"terms\s*and\s*conditions")),
    ("Report", (r"\breport\b", r"\bsummary\b", r"\banalysis\b")),
    ("Certificate", (r"certificate\b", r"certification\b")),
)
# fixed values: document types by extension
EXTENSION_TYPES = {
    "pdf": "PDF Document", "docx": "Word Document", "doc": "Word Document", "txt": "Text Document", "csv": "CSV Data", "xlsx": "Excel Spreadsheet",
    "xls": "Excel Spreadsheet", "json": "JSON Data", "xml": "XML Document", "pptx": "Presentation", "md": "Markdown Document",
}
# fixed values: how a text names its lifecycle
LIFECYCLE_IDS = (
    r"lifecycle[_\s-]?id[:\s]+([A-Za-z0-9_-]+)", r"lifecycle[:\s]+([A-Za-z0-9_-]+)", r"\b(lifecycle[_\s-]?[0-9]{3,})\b",
    r"invoice[_\s-]?#?[:\s]+([A-Za-z0-9_-]+)", r"contract[_\s-]?#?[:\s]+([A-Za-z0-9_-]+)",
)


def document_type(name: Column, text: Column) -> Column:
    """Type by the file name, else by the text, else by the extension."""
    out = F
    for source in (F.lower(name), F.lower(text)):
        for kind, patterns in DOCUMENT_TYPES:
            out = out.when(source.rlike("|".join(patterns)), kind)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])
    return out.otherwise(F.coalesce(known[extension], F.lit("Document")))


def lifecycle_id_in(text: Column) -> Column:
    """The first pattern's id of three characters or more in the first fifty lines, lower-cased; null without one."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 50), "\n")
    found = [F.regexp_replace(F.trim(F.regexp_extract(head, "(?im)" + p, 1)), r"[^\w-]", "") for p in LIFECYCLE_IDS]
    return F.coalesce(*[F.when(F.length(f) >= 3, F.lower(f)) for f in found])


#: Where a site's map is looked for, in this order; sub-maps of an index that are followed.
MAP_PLACES, SUB_MAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/robots.txt"), 5


def site_seeds(sites: DataFrame, fetched: DataFrame, deepest: int = 3) -> DataFrame:
    """(site, seq, url): the addresses that the maps of sites(site) list, in the order of the documents, each once.

    fetched(url, text) are the texts of maps and robots files. Of the places of a map the first that lists
    anything counts; a robots file names maps by Sitemap lines. A map gives all its addresses, then those of its
    first five sub-maps, one after the other, down to deepest levels. An address has its place as an array of
    numbers, so that the order needs no walk.
    """
    texts = fetched.groupBy("url").agg(F.max("text").alias("text"))
    places = F.array(*[F.struct(F.lit(i).alias("at"), F.concat("site", F.lit(p)).alias("url")) for i, p in enumerate(MAP_PLACES)])
    top = sites.select("site", F.explode(places).alias("p")).select("site", "p.at", "p.url").join(texts, "url")
    named = F.regexp_extract_all("text", F.lit(r"(?im)^sitemap:[ \t]*(\S+)"), F.lit(1))
    robots = top.where(F.col("at") == len(MAP_PLACES) - 1).select("site", "at", F.posexplode(named).alias("i", "url")).join(texts, "url")
    maps = top.where(F.col("at") < len(MAP_PLACES) - 1).select("site", "at", F.array("at").alias("place"), "text").unionByName(robots.select("site", "at", F.array("at", "i").alias("place"), "text"))
    found = None
    for level in range(deepest + 1):
        urls = maps.select("site", "at", "place", F.posexplode(F.regexp_extract_all("text", F.lit(r"<loc>\s*(https?://[^\s<]+)\s*</loc>"), F.lit(1))).alias("i", "url"))
        urls = urls.select("site", "at", F.concat("place", F.array(F.lit(0), F.col("i"))).alias("place"), "url")
        found = urls if found is None else found.unionByName(urls)
        if level < deepest:
            subs = F.slice(F.regexp_extract_all("text", F.lit(r"(?s)<sitemap>.*?<loc>(https?://[^\s<]+)</loc>.*?</sitemap>"), F.lit(1)), 1, SUB_MAPS)
            maps = maps.select("site", "at", "place", F.posexplode(subs).alias("i", "url")).join(texts, "url").select("site", "at", F.concat("place", F.array(F.lit(1), F.col("i"))).alias("place"), "text")
    found = checkpoint(found)
    first = found.groupBy("site").agg(F.min("at").alias("at"))
    once = found.join(first, ["site", "at"]).groupBy("site", "url").agg(F.min("place").alias("place"))
    return once.select("site", F.row_number().over(W.partitionBy("site").orderBy("place", "url")).alias("seq"), "url")
