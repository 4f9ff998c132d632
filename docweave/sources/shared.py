"""The folder that the driver and all executors share, and small files in it through Spark's own file systems."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where that is unset, on a cluster an error."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="docweave-"))
    return _own[0]


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/docweave/{tag}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    files, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def put_new(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    """Write a small file that must not exist yet; of two writers one fails with FileExistsError."""
    files, where = _at(spark, path)
    try:
        out = files.create(where, False)
    except Exception as error:
        raise FileExistsError(path) from error
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def get(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What put_new wrote, or None while it is not complete."""
    files, where = _at(spark, path)
    stream = files.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None
