"""Tables of versions: data first, then one manifest, so that a reader always sees a whole version.

A table is a folder with data/ (folders that are written once and never changed) and manifest/ (a small file
for each version, numbered). A write puts its folders in place and then creates the next manifest, which fails
if another writer was faster; a write that fails before leaves the version of before. Rows are kept in buckets
by the hash of a key, and a write names only the buckets that it changes, so the others are not written again.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.sources.shared import delete, get, names, put_new


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are complete, oldest first."""
    return [n for n in _numbers(spark, path) if manifest(spark, path, n) is not None]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{path}/manifest") if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any] | None:
    """A version's manifest, the newest complete one by default; None where there is none."""
    if version is not None:
        return get(spark, f"{path}/manifest/{version:012d}")
    return next((m for n in reversed(_numbers(spark, path)) if (m := get(spark, f"{path}/manifest/{n:012d}")) is not None), None)


def commit(spark: SparkSession, path: str, content: dict[str, Any], after: int | None = None) -> int:
    """Make content the next version. after is the version that it was made from; if another came since, FileExistsError."""
    number = max(_numbers(spark, path), default=0) + 1
    newest = (manifest(spark, path) or {"version": 0})["version"]
    if after is not None and newest != after:
        raise FileExistsError(f"{path}: version {newest} came after {after}")
    put_new(spark, f"{path}/manifest/{number:012d}", {**content, "version": number})
    return number


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, key: str, buckets: int = 16, tag: int | None = None, only: list[int] | None = None) -> int:
    """Make rows the next version of the table; with only, rows are the new rows of those buckets and the others stay.

    tag is a number that the version carries, for writers that must tell what was written before. Columns must
    not be named bucket.
    """
    spark = rows.sparkSession
    before = manifest(spark, path)
    if before is not None and only is not None:
        buckets = before["of"]
    place = f"data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/{place}")
    held = {n.removeprefix("bucket="): f"{place}/{n}" for n in names(spark, f"{path}/{place}") if n.startswith("bucket=")}
    kept = {} if before is None or only is None else {b: p for b, p in before["buckets"].items() if int(b) not in only}
    content = {"buckets": {**kept, **held}, "of": buckets, "key": key, "tag": tag, "schema": rows.schema.json()}
    return commit(spark, path, content, before["version"] if before else 0)


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """Rows of a version (the newest by default), or of some of its buckets."""
    import json

    found = manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"{path} has no version")
    folders = [f"{path}/{p}" for b, p in sorted(found["buckets"].items()) if only is None or int(b) in only]
    schema = StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def rollback(spark: SparkSession, path: str, version: int) -> int:
    """An earlier version becomes the newest once more."""
    found = manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"{path} has no version {version}")
    return commit(spark, path, {k: v for k, v in found.items() if k != "version"})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the newest versions, and delete what none of them names; how many folders went."""
    kept = versions(spark, path)[-keep:]
    used = {p.split("/")[1] for n in kept for p in manifest(spark, path, n)["buckets"].values()}
    for n in _numbers(spark, path):
        if n < min(kept, default=0):
            delete(spark, f"{path}/manifest/{n:012d}")
    gone = [n for n in names(spark, f"{path}/data") if n not in used]
    for name in gone:
        delete(spark, f"{path}/data/{name}")
    return len(gone)
