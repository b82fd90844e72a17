"""A change feed over a directory, and live conversion by micro-batches.

Spark's file source never reports deletions, so the feed is a data source of its
own: each read compares the tree's listing with the last offset's.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from palisade.functions import native, udfs
from palisade.sources.files import EXTENSIONS, html_path, put_file


def listing(root: str) -> dict[str, str]:
    """Version of each file below ``root``; dotfiles, dot-directories and ``~`` files are left out."""
    out = {}
    for folder, inner, files in os.walk(root):
        inner[:] = [d for d in inner if not d.startswith(".")]
        for f in files:
            if f.startswith(".") or f.endswith("~"):
                continue
            full = os.path.join(folder, f)
            try:
                stat = os.stat(full)
            except FileNotFoundError:
                continue
            out[os.path.relpath(full, root)] = f"{stat.st_mtime_ns}:{stat.st_size}"
    return out


def changes(root: str, old: dict[str, str], new: dict[str, str]) -> Iterator[tuple]:
    for path in sorted(old.keys() | new.keys()):
        if old.get(path) == new.get(path):
            continue
        op = "delete" if path not in new else "create" if path not in old else "modify"
        content = None
        if op != "delete":
            try:
                content = Path(root, path).read_bytes()
            except FileNotFoundError:
                op = "delete"
        yield path, op, content


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": {}, "seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.root)
        if now == start["files"]:
            return iter(()), start
        rows = [(p, op, c, start["seq"]) for p, op, c in changes(self.root, start["files"], now)]
        return iter(rows), {"files": now, "seq": start["seq"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return ((p, op, c, start["seq"]) for p, op, c in changes(self.root, start["files"], end["files"]))


class ChangeSource(DataSource):
    """Stream ``markup_changes``: (path, op, content, seq) of the tree at option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "markup_changes"

    def schema(self) -> str:
        return "path string, op string, content binary, seq bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001
        return ChangeReader(self.options["path"])


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("markup_changes").option("path", root).load()


def latest(changes_: DataFrame) -> DataFrame:
    """The last change of each path."""
    return changes_.groupBy("path").agg(F.max_by(F.struct("op", "content"), "seq").alias("c")).select("path", "c.op", "c.content")


def converted(changes_: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, suffix: str = "") -> DataFrame:
    """(path, op, content) on the target side: documents become HTML pages, with
    ``suffix`` (a reload script, say) at the end; faulty ones keep their last page."""
    ours = native.is_markup_file(F.col("path"), extensions)
    page = udfs.markup_to_html(F.when(ours, F.col("content")))["html"]
    content = F.when(ours, F.encode(F.concat(page, F.lit(suffix)), "UTF-8")).otherwise(F.col("content"))
    out = latest(changes_).select(F.when(ours, html_path(F.col("path"))).otherwise(F.col("path")).alias("path"), "op", content.alias("content"))
    return out.where("op = 'delete' OR content IS NOT NULL")


def live_convert(spark: SparkSession, root: str, target: str, checkpoint: str, extensions: tuple[str, ...] = EXTENSIONS, suffix: str = "", interval: str = "100 milliseconds", available_now: bool = False) -> StreamingQuery:
    """Keep ``target`` the converted image of ``root``. Batches may be replayed:
    writing and removing files are idempotent."""

    def apply(batch: DataFrame, _: int) -> None:
        def put(rows: Iterator) -> None:
            for r in rows:
                if r.op == "delete":
                    Path(target, r.path).unlink(missing_ok=True)
                else:
                    put_file(target, r.path, bytes(r.content))

        converted(batch, extensions, suffix).foreachPartition(put)

    writer = read_changes(spark, root).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if not available_now else writer.trigger(once=True).start()


def live_table(spark: SparkSession, root: str, name: str, checkpoint: str) -> StreamingQuery:
    """The change feed as an in-memory table."""
    return read_changes(spark, root).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
