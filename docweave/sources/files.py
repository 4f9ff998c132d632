"""File sources and sinks: text and office files to one row per file, JSONL logs, tables by key."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.documents import text_hash

TEXT_KINDS = ("txt", "md", "html", "xml", "log")
CSV_ROWS, JSON_ITEMS = 5000, 2000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, kind, size, modified) of a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), extension(F.col("path")).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, kind, text, content_hash): every file's text by its extension.

    Text kinds and JSON (first 2000 items) are decoded on the JVM; CSV (first 5000 rows) and office
    formats, which are zipped XML, in batches. A file that cannot be read has a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").withColumn("kind", extension(F.col("path")))
    packed = ("docx", "pptx", "xlsx", "pdf", "csv")
    plain = files.where(~F.col("kind").isin(*packed)).withColumn("raw", F.decode("content", "UTF-8"))
    text = F.when(F.col("kind") == "json", json_text(F.col("raw"))).otherwise(F.col("raw"))
    plain = plain.select("path", "kind", text.alias("text"))
    office = files.where(F.col("kind").isin(*packed)).mapInPandas(_office, "path string, kind string, text string")
    both = plain.unionByName(office)
    return both.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "kind", "text", text_hash(F.col("text")).alias("content_hash"))


def csv_text(content: bytes) -> str:
    """Cells of the first rows joined by " | ", a line per row; quoted cells may hold commas and line ends."""
    rows = csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""))
    return "\n".join(" | ".join(c.strip() for c in row) for row in itertools.islice((r for r in rows if r), CSV_ROWS))


def json_text(raw: Column) -> Column:
    """An object as "key: value" lines, a list as a line per item, a scalar as it is."""
    value = F.try_parse_json(raw)
    as_map = F.try_variant_get(value, "$", "map<string, variant>")
    as_list = F.try_variant_get(value, "$", "array<variant>")
    said = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    pairs = F.transform(F.map_entries(as_map), lambda e: F.concat_ws(": ", e["key"], said(e["value"])))
    return F.coalesce(F.array_join(pairs, "\n"), F.array_join(F.transform(F.slice(as_list, 1, JSON_ITEMS), said), "\n"), raw)


def _office(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "kind": pdf["kind"], "text": [office_text(k, c) for k, c in zip(pdf["kind"], pdf["content"])]})


def office_text(kind: str, content: bytes) -> str | None:
    """Non-blank paragraphs, shapes or rows of an office file; null where it cannot be read or is PDF."""
    try:
        if kind == "csv":
            return csv_text(content)
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = archive.namelist()
        tree = lambda name: ElementTree.fromstring(archive.read(name))
        if kind == "docx":
            lines = ["".join(t.text or "" for t in p.iter(_W + "t")) for p in tree("word/document.xml").iter(_W + "p")]
        elif kind == "pptx":
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
            lines = ["".join(t.text or "" for t in p.iter(_A + "t")) for n in slides for p in tree(n).iter(_A + "p")]
        else:
            shared = ["".join(t.text or "" for t in s.iter(_S + "t")) for s in tree("xl/sharedStrings.xml").iter(_S + "si")] if "xl/sharedStrings.xml" in names else []
            lines = []
            for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
                for row in tree(name).iter(_S + "row"):
                    cells = [(c.get("t"), c.findtext(_S + "v") or "".join(t.text or "" for t in c.iter(_S + "t"))) for c in row.iter(_S + "c")]
                    lines.append(" | ".join(shared[int(v)] if t == "s" else v for t, v in cells if v))
        return "\n".join(x for x in lines if x.strip())
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, csv.Error):
        return None


def read_error_log(spark: SparkSession, path: str, level: str | None = None, most: int = 200) -> DataFrame:
    """Newest entries of a JSONL log (ts, level, source, message); malformed lines are left out."""
    schema = "ts string, level string, source string, message string, bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    rows = rows.where("bad is null").withColumn("at", F.try_to_timestamp("ts"))
    return (rows if level is None else rows.where(F.col("level") == level)).drop("bad").orderBy(F.desc_nulls_last("at"), "message").limit(most)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_keys(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A table after an upsert: rows replace those with the same keys."""
    return current.join(rows.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(rows)


def sitemap_urls(maps: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct <loc> urls of sitemap texts."""
    return maps.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()
