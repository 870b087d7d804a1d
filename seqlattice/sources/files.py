"""Files: CSV, JSON documents, text trees in; CSV, JSON, Markdown and zip archives out.  Paths are any that Spark reads, but for archives."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, columns: list[str], lenient: bool = False) -> DataFrame:
    """Text columns by name, '' where a cell is empty; if lenient, a missing file is an empty table."""
    try:
        df = spark.read.options(**_CSV).csv(path)
    except AnalysisException as e:
        if lenient and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
        raise
    names = [c.lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in names))


def header(spark: SparkSession, path: str) -> list[str]:
    return [c.lstrip("﻿") for c in spark.read.options(**_CSV).csv(path).columns]


def read_records(spark: SparkSession, path: str, field: str = "records") -> DataFrame:
    """The rows below a field of a JSON document, with its meta as a column where it has one."""
    df = spark.read.json(path, multiLine=True)
    meta = ["meta"] if "meta" in df.columns else []
    return df.select(*meta, F.explode(field).alias("_r")).select(*meta, "_r.*")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a JSON document of principal components, by id."""
    return read_records(spark, path, "points").orderBy("id")


def read_tree(spark: SparkSession, path: str, suffixes: tuple[str, ...], without: tuple[str, ...] = ("__pycache__",)) -> DataFrame:
    """path, text of all files below a folder with one of the suffixes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")
    for part in without:
        kept &= ~F.contains("path", F.lit(f"/{part}/"))
    return df.where(kept).select("path", F.decode("content", "UTF-8").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def skeleton(spark: SparkSession, path: str, columns: list[str]) -> bool:
    """A CSV with a header only, unless there is something; whether it was written."""
    try:
        spark.read.options(**_CSV).csv(path)
        return False
    except AnalysisException:
        write_csv(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)).coalesce(1), path)
        return True


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line, written by all tasks."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def document(df: DataFrame, meta: dict, field: str = "records") -> str:
    """One indented JSON document of a small result, streamed to the driver."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()]
    return json.dumps({"meta": meta, field: rows}, indent=2, ensure_ascii=False) + "\n"


def zip_pages(pages: DataFrame, path: str) -> list[str]:
    """A deflated archive of (name, markdown), sorted by name, written on the driver page by page; the names."""
    names = []
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        for r in pages.orderBy("name").toLocalIterator():
            z.writestr(r.name, r.markdown)
            names.append(r.name)
    return names


def package(pages: DataFrame, manifest: str, path: str) -> list[str]:
    """A deflated archive of pages (name, markdown), all of them in one file, and a manifest of images; the names, sorted.

    It is written on the driver page by page; the file of all pages is read once more."""
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("IMAGES.md", manifest)
        with z.open("all.md", "w") as whole:
            for k, r in enumerate(pages.orderBy("name").toLocalIterator()):
                whole.write((("\n\n---\n\n" if k else "") + r.markdown.strip()).encode())
            whole.write(b"\n")
        for r in pages.orderBy("name").toLocalIterator():
            z.writestr(f"pages/{r.name}", r.markdown.strip() + "\n")
        return sorted(z.namelist())
