"""Knowledge-graph queries over supplier-part edges and synthesised contract texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import graph as G
from docweave.plans.views import EDGES, kg_edges, table

ORDER = ["seq", "sub", "weight"]


def _edges(spark, sf_dir):
    return G.upsert_edges(kg_edges(spark, sf_dir), ORDER)


def _nodes(spark, sf_dir):
    return G.upsert_nodes(kg_edges(spark, sf_dir), ORDER)


def _texts(spark, sf_dir):
    """Contract texts rendered from orders, so that the entity patterns have input."""
    # dealt out by key: patterns cost far more than reading, and a file of few row groups is read by few tasks
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").repartition("o_orderkey")
    text = F.concat(
        F.lit("Contract No: C-"), F.col("o_orderkey").cast("string"), F.lit(" dated "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" for $"), F.format_string("%.2f", F.col("o_totalprice")), F.lit(" issued by Customer "), F.lit("Widget Corp"), F.lit("."),
    )
    return o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("doc_key"), text.alias("text"))


def edge_upsert(spark, sf_dir):
    return _edges(spark, sf_dir)


def node_upsert(spark, sf_dir):
    return _nodes(spark, sf_dir)


def incident_edges(spark, sf_dir):
    return G.incident(_edges(spark, sf_dir), "supplier:7").select("from_node", "relation", "to_node")


def keyword_entities(spark, sf_dir):
    return G.keyword_entities(_nodes(spark, sf_dir), _edges(spark, sf_dir).select("from_node", "relation", "to_node"), "Supplier:1")


def multi_hop(spark, sf_dir):
    start = spark.createDataFrame([("supplier:1",)], "name string")
    return G.hops(_edges(spark, sf_dir), start, 2)


def cross_document_links(spark, sf_dir):
    """Suppliers that share parts: pairs of sources through the nodes that both name."""
    e = kg_edges(spark, sf_dir).select(F.col("from_node").alias("source"), "to_node")
    return G.shared_entity_links(e)


def _named(spark, sf_dir):
    return kg_edges(spark, sf_dir).select(F.col("from_node").alias("source"), F.col("to_node").alias("entity"))


def entity_classes(spark, sf_dir):
    return G.entity_classes(_named(spark, sf_dir))


def entity_neighbours(spark, sf_dir):
    return G.entity_neighbours(_named(spark, sf_dir), "supplier:1")


def prune_nodes(spark, sf_dir):
    nodes, _ = G.prune(_nodes(spark, sf_dir), _edges(spark, sf_dir), 0.9)
    return nodes.select("name")


def orphan_nodes(spark, sf_dir):
    kept = _edges(spark, sf_dir).where("weight >= 0.9")
    return G.orphans(_nodes(spark, sf_dir), kept).select("name")


def graph_context(spark, sf_dir):
    names = _nodes(spark, sf_dir).where("name in ('supplier:3', 'part:11')").select("name")
    return G.context_lines(_edges(spark, sf_dir), names)


def node_types(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def entity_extraction(spark, sf_dir):
    e = G.entities(_texts(spark, sf_dir))
    return e.select("source", *[F.array_join(c, "|").alias(c) for c in ("contracts", "dates", "amounts")])


def entity_relations(spark, sf_dir):
    r = G.relations(G.entities(_texts(spark, sf_dir)), ("STARTS_ON", "HAS_AMOUNT"))
    return r.select("source", "relation", "from_node", "to_node")


def relation_counts(spark, sf_dir):
    return G.relations(G.entities(_texts(spark, sf_dir))).groupBy("relation").agg(F.count("*").alias("n"))


def metadata_edges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("lang").alias("domain"), F.col("source").alias("doc_type"), F.lit("low").alias("sensitivity"))
    return G.metadata_edges(d)


_UP = f"""{EDGES}, edges as (select from_node, relation, to_node, min_by(source, (seq, sub, weight)) as source, min_by(weight, (seq, sub, weight)) as weight,
  min(seq) as seq, min_by(sub, (seq, sub, weight)) as sub from raw_edges group by 1, 2, 3),
ends as (select from_node as name, source, seq, sub, weight from raw_edges union all select to_node, source, seq, sub, weight from raw_edges),
nodes as (select name, split_part(name, ':', 1) as type, min_by(source, (seq, sub, weight)) as source from ends group by name)"""

QUERIES = {
    f.__name__: f
    for f in (
        edge_upsert, node_upsert, incident_edges, keyword_entities, multi_hop, cross_document_links, prune_nodes, orphan_nodes,
        graph_context, node_types, entity_extraction, entity_relations, relation_counts, metadata_edges, entity_classes, entity_neighbours,
    )
}
ORACLES = {
    "edge_upsert": f"with {_UP} select * from edges",
    "node_upsert": f"with {_UP} select * from nodes",
    "incident_edges": f"with {_UP} select from_node, relation, to_node from edges where from_node = 'supplier:7' or to_node = 'supplier:7' order by 1, 2, 3 limit 50",
    "keyword_entities": f"""with {_UP} select name, type, relation, to_node from nodes left join edges on name = from_node where contains(lower(name), 'supplier:1')
order by name, relation nulls first, to_node nulls first limit 30""",
    "multi_hop": f"""with recursive {_UP}, arcs as (select from_node as a, to_node as b from edges union select to_node, from_node from edges),
reach(name, hop) as (select 'supplier:1', 0 union select b, hop + 1 from reach join arcs on a = name where hop < 2)
select name, cast(min(hop) as int) as hop from reach group by name""",
    "cross_document_links": f"""with {EDGES}, m as (select distinct from_node as source, to_node as entity from raw_edges)
select x.source as a, y.source as b, count(*) as shared from m x join m y using (entity) where x.source < y.source group by 1, 2""",
    "entity_classes": f"with {EDGES}, m as (select distinct from_node as source, to_node as entity from raw_edges) select entity, count(*) as members, count(*) * (count(*) - 1) // 2 as links from m group by 1",
    "entity_neighbours": f"""with {EDGES}, m as (select distinct from_node as source, to_node as entity from raw_edges)
select y.source as document, count(*) as shared from m x join m y using (entity) where x.source = 'supplier:1' and y.source <> 'supplier:1' group by 1""",
    "prune_nodes": f"with {_UP} select distinct name from nodes where name in (select from_node from edges where weight >= 0.9 union select to_node from edges where weight >= 0.9)",
    "orphan_nodes": f"with {_UP} select name from nodes where name not in (select from_node from edges where weight >= 0.9 union select to_node from edges where weight >= 0.9)",
    "graph_context": f"with {_UP} select distinct from_node || ' --[' || relation || ']--> ' || to_node as line from edges where from_node in ('supplier:3', 'part:11') or to_node in ('supplier:3', 'part:11')",
    "node_types": f"with {_UP} select type, count(*) as n from nodes group by 1",
    "entity_extraction": """select 'order-' || o_orderkey as source, 'C-' || o_orderkey as contracts, strftime(o_orderdate, '%Y-%m-%d') as dates, printf('%.2f', o_totalprice) as amounts from orders""",
    "entity_relations": """select 'order-' || o_orderkey as source, 'STARTS_ON' as relation, 'Contract C-' || o_orderkey as from_node, strftime(o_orderdate, '%Y-%m-%d') as to_node from orders
union all select 'order-' || o_orderkey, 'HAS_AMOUNT', 'Contract C-' || o_orderkey, '$' || printf('%.2f', o_totalprice) from orders""",
    "metadata_edges": """select cast(doc_id as varchar) as from_node, 'HAS_DOMAIN' as relation, lang as to_node from documents union all select cast(doc_id as varchar), 'HAS_TYPE', source from documents
union all select cast(doc_id as varchar), 'HAS_SENSITIVITY', 'low' from documents""",
}
