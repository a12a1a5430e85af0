"""What several operators need: the shared folder, tables, runs of equal keys, and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duosignal.sources.workspace import discard, stored, work_folder  # noqa: F401


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def first_by_hash(rows: DataFrame, key: str, most: int, bins: int = 4096) -> DataFrame:
    """At most ``most`` of ``rows`` (doc_id, ``key``) for each value of the key, in the order of a hash of doc_id.

    Rows are counted by range of the hash first, map-side; only those of the ranges that the last
    taken rows fall in are ordered, so no key's rows meet in a task. Equal rows count each.
    """
    rows = rows.withColumns({"_hash": F.xxhash64("doc_id"), "_bin": F.shiftright(F.xxhash64("doc_id"), 65 - bins.bit_length())})
    counts = stored(rows.groupBy(key, "_bin").agg(F.count("*").alias("_n")), "bins")
    before = counts.select(key, "_bin", "_n", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bin")) - F.col("_n")).alias("_before"))
    near = rows.join(before.where(F.col("_before") < most), [key, "_bin"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_bin").orderBy("_hash", "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).select("doc_id", key)


def fitting(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``df``, a stored table of a few numbers a row, to broadcast if it has at most ``most`` rows.

    With more it is left to join by a shuffle.
    """
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts of at most this many rows, so that workers hold few at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows that are equal in ``key``, over the borders of batches."""
    open_rows: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if open_rows and keys[start] != open_key:
                    yield pa.Table.from_batches(open_rows)
                    open_rows = []
                open_key = keys[start]
                open_rows.append(batch.slice(start, i - start))
                start = i
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def emit(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows each."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def per_row(fn: Callable[[bytes], tuple], out: pa.Schema, keep: list[str], text: str = "text") -> Callable:
    """A mapInArrow function that puts ``fn`` of each whole text beside the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = list(zip(*map(fn, utf8(batch.column(text))), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, t.type) for c, t in zip(made, out, strict=True)], names=keep + out.names)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star rounds; each round's edges are written to the shared folder. Minima
    are combined before the shuffle, and the joins back on a hub are left to the skew-join rule.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
