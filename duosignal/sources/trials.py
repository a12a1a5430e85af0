"""Files of trials, one for each session, trial and channel, as a Spark data source.

A file ``s<session>.objects.<trial>.channel<channel>.phrases`` has lines of start, end and text, parted
by tabs. Names say what a file holds, so filters on session, trial and channel choose files before
any is opened.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

KEYS = ("session", "trial", "channel")
NAME = re.compile(r"s(\d+)\.objects\.(\d+)\.channel(\d+)\.phrases")
TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path)))


@dataclass
class TrialFile(InputPartition):
    path: str
    session: int
    trial: int
    channel: int


@dataclass
class Saved(WriterCommitMessage):
    files: list


class TrialFiles(DataSource):
    """``format("trial_files")``: rows (session, trial, channel, start, end, text); a partition is a file."""

    @classmethod
    def name(cls) -> str:
        return "trial_files"

    def schema(self) -> str:
        return "session long, trial long, channel long, start double, end double, text string"

    def reader(self, schema) -> DataSourceReader:
        return TrialReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TrialWriter(self.options["path"])


class TrialReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        """Takes those on the keys in names; the others are left to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.tests.append((TESTS[type(f)], f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, folder = place(self.path)
        out = []
        for info in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            name = NAME.fullmatch(info.base_name)
            if name:
                file = TrialFile(info.base_name, *map(int, name.groups()))
                if all(test(getattr(file, key), value) for test, key, value in self.tests):
                    out.append(file)
        return out

    def read(self, partition: TrialFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where, folder = place(self.path)
        rows: list[tuple] = []
        names = ["start", "end", "text"]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            keys = [pa.array([getattr(partition, k)] * len(rows), pa.int64()) for k in KEYS]
            return pa.RecordBatch.from_arrays([*keys, pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())], names=[*KEYS, *names])

        with where.open_input_stream(f"{folder}/{partition.path}") as source:
            left = b""
            while True:
                piece = source.read(1 << 20)
                *whole, left = (left + piece).split(b"\n") if piece else [left, b""]
                for line in whole:
                    start, end, text = [*line.decode(errors="replace").split("\t", 2), "", "", ""][:3]
                    if line.strip():
                        rows.append((float(start), float(end), text))
                if rows and (len(rows) > 10_000 or not piece):
                    yield batch()
                    rows.clear()
                if not piece:
                    return


class TrialWriter(DataSourceArrowWriter):
    """A task writes the files of its rows, which come key by key, under names of its own; the commit gives them their names."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Saved:
        where, folder = place(self.path)
        files, at, sink = [], None, None
        for batch in iterator:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in KEYS)
                if key != at:
                    if sink:
                        sink.close()
                    own = f".part-{uuid.uuid4().hex}"
                    where.create_dir(folder, recursive=True)
                    at, sink = key, where.open_output_stream(f"{folder}/{own}")
                    files.append((own, "s{}.objects.{}.channel{}.phrases".format(*key)))
                text = re.sub(r"[\t\n]", " ", row["text"] or "")
                sink.write(f"{row['start']!r}\t{row['end']!r}\t{text}\n".encode())
        if sink:
            sink.close()
        return Saved(files)

    def commit(self, messages: list[Saved]) -> None:
        where, folder = place(self.path)
        for own, name in (f for m in messages if m for f in m.files):
            where.move(f"{folder}/{own}", f"{folder}/{name}")

    def abort(self, messages: list[Saved]) -> None:
        where, folder = place(self.path)
        for own, _ in (f for m in messages if m for f in m.files):
            where.delete_file(f"{folder}/{own}")


def save_trials(df: DataFrame, path: str) -> None:
    """Writes (session, trial, channel, start, end, text) as a file for each key; lines in the order of start."""
    df.sparkSession.dataSource.register(TrialFiles)
    rows = df.select(*[F.col(k).cast("long").alias(k) for k in KEYS], F.col("start").cast("double"), F.col("end").cast("double"), "text")
    rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "start", "end").write.format("trial_files").mode("append").save(path)


def scan_trials(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files; filters on session, trial and channel choose the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrialFiles)
    return spark.read.format("trial_files").load(path)
