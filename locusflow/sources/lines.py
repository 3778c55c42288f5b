"""Text files with one header: a Spark sink.

``df.write.format("headed_lines").option("header", text).mode("overwrite").save(path)`` writes the column ``value``. Each
attempt of a task writes a file of its own beside the result; only when all tasks are done are the files of those that
count moved to ``part-00001`` and so on, in the order of the partitions, behind ``part-00000`` with the header. So the
parts one after another are the file, and attempts that failed or were repeated leave nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .bgzf import place


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


class HeadedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "headed_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header"), overwrite
        self.attempts = f"{self.path}/_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        name = f"{number:05d}-{uuid.uuid4().hex}"
        system, folder = place(self.attempts)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as sink:
            for batch in iterator:
                if batch.num_rows:
                    sink.write("".join(f"{x}\n" for x in batch.column("value").to_pylist()).encode())
        return Part(number, name)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        _, attempts = place(self.attempts)
        old = system.get_file_info(fs.FileSelector(folder))
        if self.overwrite:
            for x in old:
                if x.type == fs.FileType.File:
                    system.delete_file(x.path)
        first = 0 if self.overwrite else len([x for x in old if x.base_name.startswith("part-")])
        if self.header is not None and not first:
            with system.open_output_stream(f"{folder}/part-00000") as sink:
                sink.write((self.header + "\n").encode())
            first = 1
        for k, part in enumerate(sorted((m for m in messages if m), key=lambda m: m.number)):
            system.move(f"{attempts}/{part.name}", f"{folder}/part-{first + k:05d}")
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, attempts = place(self.attempts)
        if system.get_file_info(attempts).type == fs.FileType.Directory:
            system.delete_dir(attempts)


def write_lines(lines: DataFrame, path: str, header: str | None = None, mode: str = "errorifexists") -> None:
    """lines: value, in the order of the file. mode: errorifexists, overwrite or append."""
    register(lines.sparkSession)
    system, folder = place(path)
    if mode == "errorifexists" and system.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    writer = lines.select("value").write.format("headed_lines")
    writer = writer if header is None else writer.option("header", header)
    writer.mode("append" if mode == "append" else "overwrite").save(path)


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(HeadedLines)
