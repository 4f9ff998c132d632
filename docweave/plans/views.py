"""The library's logical tables, as views over the driver's tables; each also as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """Chunks with an embedding where one exists (if asked for), and the roles that may read them."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    if not with_vectors:
        docs, vectors = docs.withColumns({"vec_id": F.col("doc_id"), "embedding": F.lit(None)}), None
    low = F.when(F.col("doc_id") % 10 == 0, "public").when(F.col("doc_id") % 3 == 0, "user").otherwise("admin")
    rows = docs if vectors is None else docs.join(vectors, docs["doc_id"] == vectors["vec_id"], "left")
    return rows.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("doc_key"),
        "text",
        F.col("lang").alias("tenant_id"),
        F.when(low == "public", F.array(F.lit("public"), F.lit("user"), F.lit("admin")))
        .when(low == "user", F.array(F.lit("user"), F.lit("admin")))
        .otherwise(F.array(F.lit("admin")))
        .alias("access_roles"),
        "embedding",
    )


CHUNKS = """chunks as (
  select d.doc_id as chunk_id, d.source as doc_key, d.text, d.lang as tenant_id,
         case when d.doc_id % 10 = 0 then ['public', 'user', 'admin'] when d.doc_id % 3 = 0 then ['user', 'admin'] else ['admin'] end as access_roles,
         e.embedding
  from documents d left join embeddings e on e.vec_id = d.doc_id)"""


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "error", "RISK_ALERT")
        .when(F.col("event_type") == "click", "CHANGE_ORDER")
        .when(F.col("event_type") == "view", "DOCUMENT_ADDED")
        .when(F.col("event_type") == "signup", "CONTRACT_UPLOADED")
        .otherwise("INVOICE_PAID")
    )
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor((F.day("ts") - 1) / 3).cast("string")).alias("lifecycle_id"),
        "event_id",
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


LC = """lc as (
  select concat(cast(user_id as varchar), '-', cast(cast(floor((day(ts) - 1) / 3) as int) as varchar)) as lifecycle_id, event_id,
         case event_type when 'error' then 'RISK_ALERT' when 'click' then 'CHANGE_ORDER' when 'view' then 'DOCUMENT_ADDED'
              when 'signup' then 'CONTRACT_UPLOADED' else 'INVOICE_PAID' end as event_type, ts, value
  from events)"""


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat log made of the event stream: latency is the value, a session is a user's day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("log_id"),
        "user_id",
        F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.concat_ws(" ", F.lit("question"), F.col("event_type"), (F.col("event_id") % 7).cast("string")).alias("question"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("query_type"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "view").alias("graph_used"),
        (F.col("event_id") % 100).cast("double").alias("confidence"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


LOG = """log as (
  select event_id as log_id, user_id, concat(cast(user_id as varchar), '@', strftime(ts, '%Y-%m-%d')) as session_id,
         concat('question ', event_type, ' ', cast(event_id % 7 as varchar)) as question,
         case when event_type <> 'error' then event_type end as query_type, value as latency_ms,
         event_type = 'view' as graph_used, cast(event_id % 100 as double) as confidence, ts as created_at
  from events)"""


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("from_node"),
        F.lit("SUPPLIES").alias("relation"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("to_node"),
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"),
        (F.col("l_quantity") / 50.0).alias("weight"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_linenumber").alias("sub"),
    )


EDGES = """raw_edges as (
  select concat('supplier:', cast(l_suppkey as varchar)) as from_node, 'SUPPLIES' as relation,
         concat('part:', cast(l_partkey as varchar)) as to_node, concat('order:', cast(l_orderkey as varchar)) as source,
         l_quantity / 50.0 as weight, l_orderkey as seq, l_linenumber as sub
  from lineitem)"""


def po_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and item number of consecutive purchase-order versions of a customer."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", F.col("l_linenumber").alias("item_no")).agg(
        F.max(F.col("l_quantity").cast("int")).alias("quantity"),
        F.round(F.max("l_extendedprice") / F.max("l_quantity") + 1e-9, 2).alias("unit_price"),
    )


def po_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", F.row_number().over(by).alias("version"),
        F.lag("o_orderkey").over(by).alias("prev_orderkey"), F.lag("o_totalprice").over(by).alias("prev_total"),
    )


PO = """items as (
  select l_orderkey, l_linenumber as item_no, max(cast(l_quantity as int)) as quantity, round(max(l_extendedprice) / max(l_quantity) + cast(1e-9 as double), 2) as unit_price
  from lineitem group by 1, 2),
versions as (
  select o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() over w as version, lag(o_orderkey) over w as prev_orderkey, lag(o_totalprice) over w as prev_total
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))"""
