"""All queries of the library, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans import analytics, answering, context, diffs, documents, graph, ingest, lifecycle, portfolio, retrieval, security, streaming

MODULES = (retrieval, answering, analytics, lifecycle, portfolio, graph, documents, diffs, security, context, streaming, ingest)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
FLAGSHIP = "hybrid_search"
