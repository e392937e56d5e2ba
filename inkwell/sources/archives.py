"""A sink that writes documents into ZIP archives, one a task, with an outcome for every document.

Tasks write into a staging folder; the driver learns the names of two files a task and moves them into place once all tasks are done, or deletes the
folder if the job fails. So a folder never holds parts of a failed write, nor two archives of a task that ran twice.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "inkwell_archive"
OUTCOMES = "name string, status string, reason string, n_bytes long, archive string"
#: Outcomes that a task keeps before it writes them.
ROWS = 10_000


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    outcomes: str
    done: int


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path.rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        """name, text and error: a document with an error, or without a text, is left out and told."""
        context = TaskContext.get()
        part = f"part-{context.partitionId():05d}-{context.attemptNumber()}"
        files, root = self.files()
        for folder in ("archives", "outcomes"):
            files.create_dir(f"{root}/{self.staging}/{folder}", recursive=True)
        archive, outcomes = f"archives/{part}.zip", f"outcomes/{part}.parquet"
        schema = pa.schema([("name", pa.string()), ("status", pa.string()), ("reason", pa.string()), ("n_bytes", pa.int64()), ("archive", pa.string())])
        done, told, zipped = 0, [], None
        with files.open_output_stream(f"{root}/{self.staging}/{outcomes}") as sink, pq.ParquetWriter(sink, schema) as table:
            try:
                for row in iterator:
                    reason = row["error"] if row["error"] is not None else "no text" if row["text"] is None else None
                    data = b"" if reason else row["text"].encode()
                    if reason is None:
                        if zipped is None:  # a task without a document to write leaves no archive
                            out = files.open_output_stream(f"{root}/{self.staging}/{archive}")
                            zipped = out, zipfile.ZipFile(Unseekable(out), "w", zipfile.ZIP_DEFLATED)
                        zipped[1].writestr(row["name"], data)
                        done += 1
                    told.append((row["name"], "skipped" if reason else "ok", reason, len(data), None if reason else archive))
                    if len(told) >= ROWS:
                        table.write_batch(batch_of(told, schema))
                        told = []
            finally:
                if zipped:
                    zipped[1].close()
                    zipped[0].close()
            table.write_batch(batch_of(told, schema))
        return Written(archive if done else None, outcomes, done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self.files()
        for folder in ("archives", "outcomes"):
            if self.overwrite and files.get_file_info(f"{root}/{folder}").type != fs.FileType.NotFound:
                files.delete_dir(f"{root}/{folder}")
            files.create_dir(f"{root}/{folder}", recursive=True)
        for message in filter(None, messages):
            for name in filter(None, (message.archive, message.outcomes)):
                # an appending write keeps what is there under other names
                files.move(f"{root}/{self.staging}/{name}", f"{root}/{name}" if self.overwrite else f"{root}/{name.replace('part-', f'part-{self.staging[9:17]}-')}")
        self.clean(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clean(*self.files())

    def clean(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class Unseekable(io.RawIOBase):
    """A stream that only grows, so that an archive is written without going back."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def writable(self) -> bool:
        return True


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class ArchiveSource(DataSource):
    """Options: path, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if missing := {"name", "text", "error"} - set(schema.names):
            raise ValueError(f"the rows lack {', '.join(sorted(missing))}")
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(docs: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes the documents (name, text, error) and returns their outcomes: name, status, reason, n_bytes, archive.

    A null text or an error leaves a document out. Names are entries as they are, so they should differ; an empty table gives no archive."""
    spark = docs.sparkSession
    spark.dataSource.register(ArchiveSource)
    docs.select("name", "text", "error").write.format(FORMAT).option("path", path).mode(mode).save()
    return spark.read.schema(OUTCOMES).parquet(f"{path}/outcomes")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives: archive, name, data."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(f"{path}/archives").select("path", "content")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for entry in archive.namelist():
                        yield pa.RecordBatch.from_arrays([pa.array([f"archives/{name.rsplit('/', 1)[-1]}"]), pa.array([entry]), pa.array([archive.read(entry)], pa.binary())], names=["archive", "name", "data"])

    return found.mapInArrow(entries, "archive string, name string, data binary")
