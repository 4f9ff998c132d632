"""Streaming queries: the event table read as a stream of files, run to its end, as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.plans.documents import ORACLES as DELTA_ORACLES
from docweave.plans.documents import _delta, _known
from docweave.plans.security import ORACLES as LIMITED_ORACLES
from docweave.plans.views import table
from docweave.sources import versioned
from docweave.sources.shared import new_folder
from docweave.streaming import events as S
from docweave.streaming import stateful, sync

#: Where a session names the store of its streams' state.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; the pattern lets one file stand for a folder."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(df: DataFrame, mode: str) -> DataFrame:
    """Run over what is there and return the result table: a row per window or session, not per event.

    The table is written to the folder that the cluster shares; only where none is named it is held in memory.
    """
    spark, name = df.sparkSession, f"stream_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)
    path = f"{folder.rstrip('/')}/docweave/{name}"
    sink = df.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state")
    sink.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def stream_daily_counts(spark, sf_dir):
    return _finished(S.windowed_counts(_live(spark, sf_dir)), "complete").select(F.to_date("start").alias("day"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    return _finished(S.sessions(_live(spark, sf_dir), gap="6 hours"), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def _synced(spark, sf_dir):
    """The known files after the whole feed came as a stream of several files; a folder of the table."""
    path = new_folder(spark, "known-files")
    versioned.write(_known(spark, sf_dir), f"{path}/table", "item_id", tag=-1)
    _delta(spark, sf_dir).repartitionByRange(5, "item_id").write.parquet(f"{path}/feed")
    schema = spark.read.parquet(f"{path}/feed").schema
    feed = S.read_events(spark, f"{path}/feed", schema, files_a_trigger=1)
    sync.sync_files(feed, f"{path}/table", f"{path}/state").awaitTermination()
    return f"{path}/table"


def delta_synced(spark, sf_dir):
    return versioned.read(spark, _synced(spark, sf_dir)).select("item_id", "name", "size")


def files_rolled_back(spark, sf_dir):
    """The table of known files with its first version made the newest again, by bucket folders that no later version changed."""
    path = _synced(spark, sf_dir)
    versioned.rollback(spark, path, versioned.versions(spark, path)[0])
    return versioned.read(spark, path).select("item_id", "name", "size")


def stream_admissions(spark, sf_dir):
    """All events as requests, 3 an hour for each user, admitted as a stream whose state goes with the windows."""
    requests = _live(spark, sf_dir).select("user_id", F.col("event_id").alias("request_id"), "ts")
    path, before = new_folder(spark, "admissions"), spark.conf.get(PROVIDER, None)
    stateful.use_rocksdb(spark)
    try:
        sink = stateful.admissions(requests, 3, 3600).writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}"))
        sink.option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema("user_id long, request_id long, allowed boolean").parquet(f"{path}/out").select("user_id", "request_id", "allowed")


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_sessions, delta_synced, files_rolled_back, stream_admissions)}
ORACLES = {
    "stream_admissions": f"select user_id, request_id, allowed from ({LIMITED_ORACLES['rate_limited']})",
    "delta_synced": DELTA_ORACLES["delta_applied"],
    "files_rolled_back": "select o_orderkey as item_id, 'f' || o_orderkey || '.pdf' as name, o_custkey as size from orders where o_orderkey % 3 <> 0",
    "stream_daily_counts": "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2",
    "stream_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events)
select user_id, cast(sum(fresh) as bigint) as sessions, count(*) as events from g group by 1""",
}
