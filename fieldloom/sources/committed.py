"""Lines of text as sets of files that appear whole or not at all, once for each batch.

Each task writes a file under a name of its own and reports it. Only when all have, the driver publishes the set by moving one
manifest into place; readers take files that a manifest names. A failed job leaves no manifest, a task that ran twice a file
that none names, and a batch whose manifest is there is not written again. One file of a set has the header, if there is one.

Folders are URIs that pyarrow's file systems know, shared by the driver and the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .sinks import audit_rows, flat_rows

FORMAT = "committed_lines"


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return files, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """A task's file; without a name, if its batch was there already."""

    name: str
    rows: int
    header: bool


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, header: str | None):
        self.path, self.batch, self.header = path, batch, header

    def _published(self, files: fs.FileSystem, root: str) -> bool:
        return files.get_file_info(f"{root}/_commits/{self.batch}.json").type == fs.FileType.File

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        files, root = _folder(self.path)
        if self._published(files, root):
            for _ in iterator:
                pass
            return Written("", 0, False)
        part, rows = TaskContext.get().partitionId(), 0
        name, header = f"part-{part:05}-{uuid.uuid4().hex}.txt", self.header is not None and part == 0
        files.create_dir(f"{root}/{self.batch}")
        try:
            with files.open_output_stream(f"{root}/{self.batch}/{name}") as out:
                if header:
                    out.write(f"{self.header}\n".encode())
                for batch in iterator:
                    lines = [x for x in batch.column(0).to_pylist() if x is not None]
                    rows += len(lines)
                    out.write("".join(f"{x}\n" for x in lines).encode())
        except BaseException:
            files.delete_file(f"{root}/{self.batch}/{name}")
            raise
        return Written(name, rows, header)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _folder(self.path)
        done = [m for m in messages if m is not None and m.name]
        if self._published(files, root):
            return self.abort(messages)
        manifest = {"batch": self.batch, "header": self.header, "files": [{"name": m.name, "rows": m.rows, "header": m.header} for m in sorted(done, key=lambda m: m.name)]}
        files.create_dir(f"{root}/_commits")
        draft = f"{root}/_commits/.{self.batch}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        files.move(draft, f"{root}/_commits/{self.batch}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _folder(self.path)
        for m in messages:
            if m is not None and m.name and files.get_file_info(f"{root}/{self.batch}/{m.name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{self.batch}/{m.name}")


class CommittedLines(DataSource):
    """Options path, batch and, if a set of files begins with one, header."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        if overwrite:
            raise ValueError("sets of files are added, never replaced")
        return LinesWriter(self.options["path"], self.options["batch"], self.options.get("header"))


def write_lines(lines: DataFrame, path: str, batch: str | int, header: str | None = None) -> None:
    """lines (value string) as the set of files of a batch; nothing happens if the batch is there."""
    lines.sparkSession.dataSource.register(CommittedLines)
    out = lines.write.format(FORMAT).mode("append").option("path", path).option("batch", str(batch))
    (out if header is None else out.option("header", header)).save()


def write_audit(verified: DataFrame, path: str, batch: str | int, at=None) -> None:
    """Audit rows of a batch as JSON lines."""
    rows = audit_rows(verified, at)
    write_lines(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), path, batch)


def write_flat(verified: DataFrame, path: str, batch: str | int) -> None:
    """Flat rows of a batch as CSV, with one header."""
    rows = flat_rows(verified)
    write_lines(rows.select(F.to_csv(F.struct(*rows.columns)).alias("value")), path, batch, ",".join(rows.columns))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value) of all published sets, without headers. The manifests, one a batch, are read by the driver."""
    files, root = _folder(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    sets = [json.loads(files.open_input_file(x.path).read()) for x in found if x.base_name.endswith(".json")]
    base = path.rstrip("/")
    out = spark.createDataFrame([], "batch string, value string")
    for headed in (True, False):
        names = [f"{base}/{s['batch']}/{f['name']}" for s in sets for f in s["files"] if f["header"] == headed and f["rows"]]
        if names:
            rows = spark.read.text(names).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("batch"), "value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("file"))
            if headed:
                first = rows.groupBy("file").agg(F.min(F.struct("at", "n")).alias("first"))
                rows = rows.join(F.broadcast(first), "file").where(F.struct("at", "n") != F.col("first"))  # a row a set
            out = out.unionByName(rows.select("batch", "value"))
    return out
