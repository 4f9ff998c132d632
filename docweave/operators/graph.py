"""Knowledge graph: entities from text, node and edge upserts, neighbourhoods, hops, pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: entity patterns, all read without regard to case
CONTRACTS = (
    r"contract\s*(?:no\.?|number|#|num)?\s*[:\-]?\s*([A-Z0-9][\w\-/]{2,30})",
    r"agreement\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][\w\-/]{2,30})",
    r"\bLC[-\s]?(\d{4,})\b",
)
DATES = (
    r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})\b",
    r"\b(\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})\b",
    r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b",
)
AMOUNTS = (r"\$\s*([\d,]+(?:\.\d{2})?)", r"([\d,]+(?:\.\d{2})?)\s*(?:USD|EUR|GBP)", r"amount\s*[:\-]?\s*\$?([\d,]+(?:\.\d{2})?)")
ORGANISATIONS = (r"\b([A-Z][a-zA-Z&\s]{2,40}(?:LLC|Inc|Corp|Ltd|Company|Co\.|LLP|LP|PLC|Association|Authority|Commission|Board))\b",)


def found(text: Column, patterns: tuple[str, ...]) -> Column:
    """Distinct matches, pattern by pattern, in order."""
    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit("(?im)" + p), F.lit(1)) for p in patterns]), lambda x: F.trim(x)))


def entities(docs: DataFrame, doc_col: str = "doc_key", text_col: str = "text") -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(
        F.col(doc_col).alias("source"), found(text, CONTRACTS).alias("contracts"), found(text, DATES).alias("dates"),
        found(text, AMOUNTS).alias("amounts"), found(text, ORGANISATIONS).alias("organizations"),
    )


#: Relations of a contract, and what a document mentions.
RELATIONS = ("STARTS_ON", "ENDS_ON", "ISSUED_BY", "HAS_AMOUNT", "MENTIONS")
KINDS = (("contracts", "Contract"), ("dates", "Date"), ("amounts", "Amount"), ("organizations", "Organization"))


def _ends(nodes: Column, relation: str, kind: str) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(relation).alias("relation"), n.alias("to_node"), F.lit(kind).alias("to_type")))


def relations(found_in: DataFrame, wanted: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(from_node, from_type, relation, to_node, to_type, source) of the entities of each document.

    A document's entities are read once for all its edges; those that no wanted relation needs are not looked for.
    """
    dates, several = F.col("dates"), F.size("dates") > 1
    own = {
        "STARTS_ON": _ends(F.slice(dates, 1, 1), "STARTS_ON", "Date"),
        "ENDS_ON": _ends(F.when(several, F.slice(dates, -1, 1)).otherwise(F.slice(dates, 1, 0)), "ENDS_ON", "Date"),
        "ISSUED_BY": _ends(F.col("organizations"), "ISSUED_BY", "Organization"),
        "HAS_AMOUNT": _ends(F.transform("amounts", lambda a: F.concat(F.lit("$"), a)), "HAS_AMOUNT", "Amount"),
    }
    mentions = [_ends(F.col(c), "MENTIONS", kind) for c, kind in KINDS] if "MENTIONS" in wanted else []
    none = F.array().cast("array<struct<relation:string,to_node:string,to_type:string>>")
    # a document is one more row beside its contracts: (its own name, what it mentions)
    starts = F.struct(F.lit(None).cast("string").alias("contract"), F.concat(none, *mentions).alias("ends"))
    ends = F.concat(none, *[e for relation, e in own.items() if relation in wanted])
    starts = F.concat(F.array(starts), F.transform("contracts", lambda c: F.struct(c.alias("contract"), F.col("of_contract").alias("ends"))))
    rows = found_in.withColumn("of_contract", ends).select("source", F.explode(starts).alias("s"))
    rows = rows.select("source", "s.contract", F.explode("s.ends").alias("e"))
    label = F.when(F.col("contract").startswith("Contract"), F.col("contract")).otherwise(F.concat(F.lit("Contract "), "contract"))
    return rows.select(
        F.coalesce(label, "source").alias("from_node"), F.when(F.col("contract").isNull(), "Document").otherwise("Contract").alias("from_type"),
        "e.relation", "e.to_node", "e.to_type", "source",
    )


def relation_name(raw: Column) -> Column:
    """Upper case, anything but letters, digits and underscores as underscores."""
    return F.regexp_replace(F.upper(raw), r"[^A-Z0-9_]", "_")


def upsert_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row per (from, relation, to): the first by order wins. No window: the first is an aggregate."""
    rest = [c for c in edges.columns if c not in ("from_node", "relation", "to_node")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return edges.groupBy("from_node", "relation", "to_node").agg(first).select("from_node", "relation", "to_node", *[f"first.{c}" for c in rest])


def upsert_nodes(edges: DataFrame, order: list[str]) -> DataFrame:
    """(name, type, source) of both ends, first seen wins; a node's type is what precedes its colon."""
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("name"), "source", *order)
    return ends.groupBy("name").agg(F.min_by("source", F.struct(*order)).alias("source")).select("name", F.substring_index("name", ":", 1).alias("type"), "source")


def incident(edges: DataFrame, name: str, most: int = 50) -> DataFrame:
    return edges.where((F.col("from_node") == name) | (F.col("to_node") == name)).orderBy("from_node", "relation", "to_node").limit(most)


def keyword_entities(nodes: DataFrame, edges: DataFrame, keyword: str, most: int = 30) -> DataFrame:
    """Nodes whose name holds the keyword, with the edges that leave them (or none)."""
    hit = nodes.where(F.contains(F.lower("name"), F.lit(keyword.lower())))
    return hit.join(edges, hit["name"] == edges["from_node"], "left").select("name", "type", "relation", "to_node").orderBy("name", F.asc_nulls_first("relation"), F.asc_nulls_first("to_node")).limit(most)


def hops(edges: DataFrame, start: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """(name, hop): nodes reached from start(name) within most hops, each at its first hop.

    A frontier joins the edges once per hop and is anti-joined to what was seen; the seen set is
    checkpointed, so the plan stays short and a lost executor loses nothing.
    """
    arcs = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    if not directed:
        arcs = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = checkpoint(arcs.distinct())
    seen = start.select("name", F.lit(0).alias("hop")).distinct()
    for hop in range(1, most + 1):
        front = seen.where(F.col("hop") == hop - 1)
        new = front.join(arcs, front["name"] == arcs["a"]).select(F.col("b").alias("name")).distinct()
        seen = checkpoint(seen.unionByName(new.join(seen, "name", "left_anti").withColumn("hop", F.lit(hop))))
    return seen


def linked_documents(mentions: DataFrame, first: int = 20) -> DataFrame:
    """(from_node, relation, to_node) of mentions(source, seq, entity): SHARES_ENTITY_WITH and CO_MENTIONS edges.

    A document looks for others through its first entities only, as many as first says. A document
    that names an entity is linked to the entity's first document (by name) in both directions, and
    that one to all: who shares an entity is at most two links away, and an entity that all
    documents name gives two rows a document, not its pairs.
    """
    order = W.partitionBy("source").orderBy("seq", "entity")
    own = mentions.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first).select("source", "entity")
    every = mentions.select("source", "entity").distinct()
    ends = every.groupBy("entity").agg(F.min("source").alias("least"), F.max("source").alias("most")).where("least <> most")
    met = own.join(ends, "entity")
    # a document meets the first of the others: the least, or for the least itself the last
    other = F.when(F.col("source") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    shares = met.select(F.col("source").alias("from_node"), F.lit("SHARES_ENTITY_WITH").alias("relation"), other.alias("to_node"))
    names = met.select(F.col("source").alias("from_node"), F.lit("CO_MENTIONS").alias("relation"), F.col("entity").alias("to_node"))
    return shares.unionByName(names).distinct()


def document_neighbours(links: DataFrame, name: str) -> DataFrame:
    """(document): what shares an entity with the document, whichever end it is."""
    at = links.where(F.col("relation") == "SHARES_ENTITY_WITH").where((F.col("from_node") == name) | (F.col("to_node") == name))
    return at.select(F.when(F.col("from_node") == name, F.col("to_node")).otherwise(F.col("from_node")).alias("document")).distinct()


def entity_classes(mentions: DataFrame) -> DataFrame:
    """(entity, members, links) of mentions(source, entity): the documents that name an entity, and the pairs they would make.

    Links between documents are kept as these classes; pairs are never made.
    """
    each = mentions.select("source", "entity").distinct().groupBy("entity").agg(F.count("*").alias("members"))
    return each.select("entity", "members", (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("links"))


def entity_neighbours(mentions: DataFrame, document: str) -> DataFrame:
    """(document, shared): every other document that names an entity of the document, with how many they share.

    Two steps: the document's own entities, then all that name one of those (a semi-join; distinct per
    document and entity before anything is counted). An entity that all documents name gives a row a document.
    """
    own = mentions.where(F.col("source") == document).select("entity").distinct()
    met = mentions.where(F.col("source") != document).join(own, "entity", "left_semi").select("source", "entity").distinct()
    return met.groupBy(F.col("source").alias("document")).agg(F.count("*").alias("shared"))


def export(nodes: DataFrame, edges: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """At most 2 x most nodes and most edges, by name."""
    return nodes.orderBy("name").limit(2 * most), edges.orderBy("from_node", "relation", "to_node").limit(most)


def bounded_hops(edges: DataFrame, start: str, most: int = 2, fan_out: int = 20, cap: int = 30) -> DataFrame:
    """(name, hop): like hops(), but a node is left by its first fan_out neighbours by name only, and cap nodes are given, nearest first."""
    arcs = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    arcs = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    few = arcs.withColumn("n", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("n") <= fan_out)
    begin = edges.sparkSession.createDataFrame([(start,)], "name string")
    found = hops(few.select(F.col("a").alias("from_node"), F.col("b").alias("to_node")), begin, most, directed=True)
    return found.where("hop > 0").orderBy("hop", "name").limit(cap)


def checkpoint(df: DataFrame) -> DataFrame:
    """A written table in the folder that the cluster shares (spark.checkpoint.dir); where none is named, cached."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/docweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_entity_links(edges: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of sources that name the same node, with how many; both from distinct mentions.

    Sources are numbered in the order of their names, in blocks. An entity's list of numbers goes once to each block
    that it has members in, from the first of them on; pairs are made and counted there, so that lists are moved and
    not their pairs. A null source or node links nothing.
    """
    named = edges.select("source", F.col("to_node").alias("entity")).where("source is not null and entity is not null")
    names = named.select("source").distinct()
    n, tasks = names.count(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, n // (4 * tasks))  # sources of a block
    names = checkpoint(names.repartitionByRange("source").sortWithinPartitions("source").select("source", F.monotonically_increasing_id().alias("id")))
    block = lambda i: F.floor(i / F.lit(size)).cast("long")
    lists = named.join(names, "source").groupBy("entity").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    to = lists.select("ids", F.explode(F.array_distinct(F.transform(F.slice("ids", 1, F.size("ids") - 1), block))).alias("block"))
    met = to.select("block", F.filter("ids", lambda i: block(i) >= F.col("block")).alias("ids")).repartition("block")
    # members of the block come first in its lists; what is counted by block and pair needs no other exchange
    own = met.select("block", "ids", F.posexplode(F.filter("ids", lambda i: block(i) == F.col("block"))).alias("at", "a"))
    pairs = own.select("block", "a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    counted = pairs.groupBy("block", "a", "b").agg(F.count("*").alias("shared"))
    by = lambda end: names.select(F.col("id").alias(end), F.col("source").alias(f"name_{end}"))
    return counted.join(by("a"), "a").join(by("b"), "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "shared")


def prune(nodes: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Edges of at least that weight, and the nodes that still have one."""
    kept = edges.where(F.col("weight") >= least)
    ends = kept.select(F.explode(F.array("from_node", "to_node")).alias("name")).distinct()
    return nodes.join(ends, "name", "left_semi"), kept


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_node").alias("name")).union(edges.select("to_node")).distinct()
    return nodes.join(ends, "name", "left_anti")


def context_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct lines "a --[R]--> b" of the edges at given names(name)."""
    at = edges.join(names, edges["from_node"] == names["name"], "left_semi").unionByName(edges.join(names, edges["to_node"] == names["name"], "left_semi"))
    return at.select(F.concat(F.col("from_node"), F.lit(" --["), F.col("relation"), F.lit("]--> "), F.col("to_node")).alias("line")).distinct()


def metadata_edges(docs: DataFrame) -> DataFrame:
    """has_domain, has_type and has_sensitivity edges of documents(source, domain, doc_type, sensitivity)."""
    kinds = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(c).alias("to_node")) for r, c in (("HAS_DOMAIN", "domain"), ("HAS_TYPE", "doc_type"), ("HAS_SENSITIVITY", "sensitivity"))])
    return docs.select(F.col("source").alias("from_node"), F.explode(kinds).alias("e")).select("from_node", "e.relation", "e.to_node")
