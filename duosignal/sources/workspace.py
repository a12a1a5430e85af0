"""Readers, writers and the read-or-build helper."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own = ""


def work_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="duosignal-series-")
    return _own


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage.

    The shuffle files behind it are no longer needed then; Spark drops them when the driver's JVM
    collects its garbage, which is asked for here so that they don't pile up over the steps.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of tables of ``stored`` that nothing reads any more; others are left alone."""
    for df in dfs:
        spark = df.sparkSession
        own = work_folder(spark).rsplit("/", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split("/")[-2] == own:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_intervals(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Headerless tab-separated phrases: start, end and text, behind the columns ``keys`` ("k long") if files hold several series."""
    return spark.read.schema(", ".join([*([keys] if keys else []), "start double, end double, text string"])).option("sep", "\t").csv(path)


def defined(text: str | Column, fill: float | None = 0.0, undefined: str = "--undefined--") -> Column:
    """A number from text; the undefined token becomes ``fill`` (null: stays missing)."""
    text = F.col(text) if isinstance(text, str) else text
    value = F.when(text != undefined, text.cast("double"))
    return value if fill is None else F.coalesce(value, F.lit(fill))


def trial_of(path: str) -> Column:
    """The trial number in a file name of the form <session>.objects.<trial>.channel<n>.<ext>."""
    return F.get(F.split(path, "\\."), 2).cast("long")


def select_features(df: DataFrame, wanted: str, known: list[str], feature: str = "feature") -> DataFrame:
    """The rows of the features named in ``wanted``, parted by underscores; an unknown name raises."""
    names = wanted.split("_")
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown features: {unknown}")
    return df.where(F.col(feature).isin(names)).withColumn("position", F.array_position(F.array(*map(F.lit, names)), F.col(feature)) - 1)


def save_partitioned(df: DataFrame, path: str, by: list[str], files: int = 16) -> None:
    """Replaces just the partitions that ``df`` has rows for.

    The rows of a partition are dealt by a hash into up to ``files`` files, so that no task writes a
    large partition alone.
    """
    deal = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(*by, deal).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The finished table at ``path`` if there is one, else what ``build`` gives, saved there."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """Of all files under the inputs (paths, sizes, times) and the parameters."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in sorted(inputs):
        at = jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(conf)
        files = system.listFiles(at, True) if system.getFileStatus(at).isDirectory() else None
        if files is None:
            status = system.getFileStatus(at)
            found.append((path, status.getLen(), status.getModificationTime()))
        while files is not None and files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found), parameters], sort_keys=True, default=str).encode()).hexdigest()


def _text_file(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """The text of a small file, None without one; or writes it, in one step as others see it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    if text is None:
        if not system.exists(at):
            return None
        source = system.open(at)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    sink = system.create(new, False)
    sink.write(bytearray(text.encode()))
    sink.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(new, at, options) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf).rename(new, at, options)
    return None


def cached_partitions(spark: SparkSession, path: str, sources: dict[str, list[str]], build: Callable[[str], DataFrame], parameters: dict | None = None, column: str = "part") -> DataFrame:
    """The tables that ``build`` gives for each name in ``sources``, with the name as a column, kept at ``path``.

    ``sources`` says which inputs a name is built from. A name is built again if the fingerprint of
    its inputs and ``parameters`` is not the one beside what is there. It is written to a folder of its
    own, which its manifest is then turned to in one step, so readers and other builders see a
    whole table or the one before. Builders at once each write a whole one; the last manifest
    counts. Folders that no manifest names any more are left, as others may still read them.
    """
    folders = []
    for name, inputs in sources.items():
        now, at = fingerprint(spark, inputs, parameters or {}), f"{path}/{name}.json"
        held = json.loads(_text_file(spark, at) or "{}")
        if held.get("fingerprint") != now:
            held = {"fingerprint": now, "folder": f"{name}-{uuid.uuid4().hex}"}
            build(name).withColumn(column, F.lit(name)).write.parquet(f"{path}/{held['folder']}")
            _text_file(spark, at, json.dumps(held))
        folders.append(f"{path}/{held['folder']}")
    return spark.read.parquet(*folders)
