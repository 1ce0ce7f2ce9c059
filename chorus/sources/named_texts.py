"""One text file per row: a data source with a writer and a reader, registered as ``named_text``.

Rows are (file_name, text).  A task writes a file under a name of its own attempt and then moves
it to its final name, which the row alone decides; a retried or doubled task writes the same file
again and leaves no second one.  The folder must be new: a job that fails removes it, a job that
ends writes ``_SUCCESS`` with the number of files last.  Nothing but counts reaches the driver.

Defined results: a null text is an empty file; a null name fails the job; characters that a path
cannot hold are written as %XX.  Names must be unique.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_UNSAFE = re.compile(r"[/\\%:\x00-\x1f]")


def safe_name(name: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", name)


def _open(path: str):
    """(file system, path in it) of a folder, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class NamedTextWriter(DataSourceWriter):
    def __init__(self, path: str):
        from pyarrow import fs

        self.path = path
        system, folder = _open(path)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists")

    def write(self, rows) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files = size = 0
        for r in rows:
            if r["file_name"] is None:
                raise ValueError("a row without a file name")
            final = f"{folder}/{safe_name(r['file_name'])}"
            own = f"{folder}/_attempt-{uuid.uuid4().hex}"
            body = (r["text"] or "").encode()
            try:
                with system.open_output_stream(own) as out:
                    out.write(body)
                system.move(own, final)
            except OSError:
                if not system.get_file_info(final).is_file:
                    raise
                system.delete_file(own)  # another attempt put the same file there
            files, size = files + 1, size + len(body)
        return Written(files, size)

    def commit(self, messages) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, folder = _open(self.path)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class NamedTextReader(DataSourceReader):
    """Files in slices of ``SLICE``; unlike the built-in sources it gives empty files a row."""

    SLICE = 1000

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = _open(self.path)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(("_", ".")))
        return [InputPartition(names[i : i + self.SLICE]) for i in range(0, len(names), self.SLICE)]

    def read(self, partition):
        system, folder = _open(self.path)
        for name in partition.value:
            with system.open_input_stream(f"{folder}/{name}") as f:
                yield name, f.read().decode()


class NamedTextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "file_name string, text string"

    def reader(self, schema) -> DataSourceReader:
        return NamedTextReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedTextWriter(self.options["path"])


def write_text_files(df: DataFrame, path: str, name_col: str = "file_name", text_col: str = "text") -> None:
    """A file for every row below ``path``."""
    df.sparkSession.dataSource.register(NamedTextSource)
    rows = df.select(F.col(name_col).cast("string").alias("file_name"), F.col(text_col).cast("string").alias("text"))
    rows.write.format("named_text").mode("append").option("path", path).save()


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of every file of a finished write."""
    spark.dataSource.register(NamedTextSource)
    return spark.read.format("named_text").option("path", path).load()
