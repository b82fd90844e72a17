"""Batch sources and sinks: directories of documents in, sites out."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import PySparkException  # noqa: F401 - what FAILFAST surfaces as
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from palisade.functions import native, udfs

EXTENSIONS = native.EXTENSIONS


#: Rows of a task that ``spread`` makes, and the tasks up to which Spark's shuffle writer has a stream for each and holds no rows.
SPREAD_ROWS, SPREAD_TASKS = 8_192, 200


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows, to be worked on in Python.

    A table of narrow rows is a few row groups, as one of a million rows may be, and Spark
    reads a row group in one task: whatever follows would run on as many cores, and all
    its nodes be one task's. Goes by all columns, so take only those needed. Counts
    the rows, from the footers if ``df`` is of Parquet; few stay as they are."""
    n = min(SPREAD_TASKS, -(-df.count() // rows))
    return df if n < 2 else df.repartition(n, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, modificationTime) of a file or of a directory tree."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_markup(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The files with one of ``extensions`` (case-sensitive, without the dot)."""
    return read_files(spark, path).where(native.is_markup_file(F.col("path"), extensions))


def convert(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, mode: str = "PERMISSIVE", headers: bool = False) -> DataFrame:
    """(path, html, error) of the documents under ``path``.

    Modes: PERMISSIVE keeps faulty documents with their error, DROPMALFORMED
    leaves them out, FAILFAST raises at the first. With ``headers`` every file,
    of whatever kind, has a row and a ``header``, as directory listings show.
    """
    files = read_files(spark, path)
    ours = native.is_markup_file(F.col("path"), extensions)
    if not headers:
        files = files.where(ours)
    done = udfs.markup_to_html(F.when(ours, F.col("content")))
    out = files.select("path", done.alias("done"), F.concat(F.lit("\n"), F.col("path"), F.lit(": ")).alias("header"))
    out = out.select("path", "header", F.col("done.html").alias("html"), F.col("done.error").alias("error"))
    if mode == "DROPMALFORMED":
        out = out.where("error IS NULL")
    elif mode == "FAILFAST":
        fault = F.concat(F.lit("parsing "), F.col("path"), F.lit(": "), native.error_text(F.col("error")))
        out = out.withColumn("html", F.when(F.col("error").isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("html")))
    elif mode != "PERMISSIVE":
        raise ValueError(f"no such mode: {mode}")
    return out if headers else out.drop("header")


def html_path(path: F.Column) -> F.Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+\z", ""), F.lit(".html"))


class SiteSource(DataSource):
    """Sink ``site``: rows (path, content) become files under the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return SiteWriter(self.options["path"], overwrite)


class SiteWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for row in rows:
            put_file(self.root, row["path"], bytes(row["content"]))
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        Path(self.root).mkdir(parents=True, exist_ok=True)


def put_file(root: str, path: str, content: bytes) -> None:
    """Write a file whole: a rename makes a retried task's copy replace the first."""
    target = Path(root, path.lstrip("/"))
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{os.getpid()}~")
    part.write_bytes(content)
    part.replace(target)


def build_site(spark: SparkSession, source: str, target: str, extensions: tuple[str, ...] = EXTENSIONS) -> None:
    """Copy a tree to ``target``, each document replaced by its HTML."""
    spark.dataSource.register(SiteSource)
    root = Path(source).resolve().as_uri() + "/"
    inner = str(Path(source).resolve()) + "/"
    relative = F.substr("path", F.instr("path", inner) + F.lit(len(inner)))
    files = read_files(spark, root).select(relative.alias("path"), "content")
    ours = native.is_markup_file(F.col("path"), extensions)
    done = udfs.markup_to_html(F.when(ours, F.col("content")))["html"]
    pages = files.select(F.when(ours, html_path(F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(ours, F.encode(done, "UTF-8")).otherwise(F.col("content")).alias("content"))
    pages.where("content IS NOT NULL").write.format("site").mode("append").option("path", target).save()


def remove_site(target: str) -> None:
    shutil.rmtree(target, ignore_errors=True)
