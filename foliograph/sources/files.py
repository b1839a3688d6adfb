"""Files in and out: PDF collection, gold data, reports, staged tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.sources.tables import POINTER, current, exists

GOLD = "document string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,relation:string,target:string>>"


def pdf_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, file_hash, file_key, filename) of the PDF files under the paths; contents are read once, for the hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(list(paths))
    digest = F.sha2("content", 256)
    return files.select("path", "length", digest.alias("file_hash"), F.left(digest, F.lit(12)).alias("file_key"), F.element_at(F.split("path", "/"), -1).alias("filename"))


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold documents, one JSON object per file; what can't be read or names no document is left out."""
    rows = spark.read.schema(GOLD).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    return rows.filter("document IS NOT NULL AND document != ''")


def scaffold(folder: str) -> str:
    """Creates the folder for gold data with a template beside it."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    template = Path(folder) / "_example.json.template"
    if not template.exists():
        example = {"document": "report.pdf", "entities": [{"name": "Acme", "type": "Organization"}], "relations": [{"source": "report.pdf", "relation": "mentions", "target": "Acme"}]}
        template.write_text(json.dumps(example, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(template)


def write_report(report: dict, folder: str, timestamp: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{re.sub('[-:]', '', timestamp)}.json"
    path.write_text(json.dumps(report, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(path)


def read_baseline(path: str) -> dict | None:
    """A stored baseline; None where there is none or it can't be read."""
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return None


def publish(tables: dict[str, DataFrame], folder: str, after: Callable[[str], None] | None = None, append: bool = False) -> str:
    """Writes a new version of the tables beside the old ones and then swaps the one pointer that names the versions.

    Until the swap, which is a single rename, readers see all old tables, afterwards all new ones. Tables that aren't given
    stay as they are; with ``append`` the new rows stand beside the old ones, none of which is written again. ``after`` is
    called with the name of each table written. Returns the version's folder.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"versions/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}.parquet")
        if after:
            after(name)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held = current(spark, folder)
    where = held | {name: [*(held.get(name, [f"{name}.parquet"]) if append and exists(spark, folder, name) else []), f"{version}/{name}.parquet"] for name in tables}
    new, live = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in (f"{version}/{POINTER}", POINTER))
    fs = live.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(where), "utf-8"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(live), how)
    return f"{folder}/{version}"


def checked_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Stored vectors of the right size; a missing or unreadable table is an empty one."""
    empty = spark.createDataFrame([], "row_id bigint, document_id bigint, vec array<float>")
    try:
        return spark.read.parquet(path).filter(F.size("vec") == dim)
    except Exception:
        return empty
