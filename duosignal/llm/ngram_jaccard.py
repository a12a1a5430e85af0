"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Equal shingle sets are one matrix row. A row that holds more n-grams of its own alone than the size
bound lets a linked pair differ by links with nothing; that is counted first on the n-grams of the
lowest hashes, then on all n-grams of the rows left. Of these, linked rows share an entry among
their first few in the order of rising frequency, and those entries deal rows into blocks of bounded
size. Each pair of blocks with a common entry is multiplied in one task, a few thousand n-grams at a
time, accumulating overlap counts; pairs below the bound that their sizes set are discarded. A block
reports a spanning forest and link counts, never all pairs, and the forests are joined to components
on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.llm.shared import components, discard, emit, fitting, runs, small_batches, stored, table, utf8
from duosignal.llm.shingles import shingle_sets


def _name(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def _numbers(grams: np.ndarray) -> list[int]:
    return np.frombuffer(_name(grams), "<i8").tolist()


def _summaries(k: int, sampled: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("low", pa.list_(pa.int64()))])
    bound = np.uint64(int(sampled * 2**64))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(utf8(batch.column("text")), k), strict=True):
            yield i, len(s), *_numbers(s), s[: np.searchsorted(s, bound)].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from emit(schema, rows(batch))

    return run


def _whole_sets(k: int):
    """The whole set of each text that has the name (x, y); texts may share a doc_id."""
    schema = pa.schema([("node", pa.binary()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for s, *named in zip(shingle_sets(utf8(batch.column("text")), k), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            if _numbers(s) == named:
                yield _name(s), *named, len(s), s.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from emit(schema, rows(batch), 200)

    return run


def _linkable(rows: DataFrame, grams: str, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``sets`` of which fewer ``grams`` are in no other set than a linked pair can differ by."""
    alone = rows.select(F.explode(grams).alias("gram"), "x", "y").groupBy("gram").agg(F.min("x").alias("x"), F.max("x").alias("most"), F.min("y").alias("y"))
    alone = alone.where("x = most").groupBy("x", "y").agg(F.count("*").alias("own"))
    return sets.join(alone, ["x", "y"], "left").where(F.coalesce("own", F.lit(0)) < _differ(percent)).drop("own")


def _differ(percent: int):
    return F.col("n") - F.ceil(F.col("n") * percent / 100) + 1


def _block_product(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of ``left`` link with which of ``right``: overlap counts against size bounds."""
    grams, entry = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(entry) > 1
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.cumsum(shared) - 1)[entry]
    row, column = row[shared[entry]], column[shared[entry]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(left), len(right)), np.float64)
    width, total = 1024, int(shared.sum())
    for c in range(0, total, width):
        x, y = np.searchsorted(column, (c, c + width))
        block = np.zeros((len(sets), min(width, total - c)), np.float32)
        block[row[x:y], column[x:y] - c] = 1
        overlap += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - overlap
    return 100 * overlap >= percent * union


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row that it reaches over links: least neighbours and short cuts by turns."""
    root = np.arange(n)
    while True:
        new = root.copy()
        new[left] = np.minimum(new[left], np.where(linked, root[right][None, :], n).min(1))
        new[right] = np.minimum(new[right], np.where(linked, root[left][:, None], n).min(0))
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(percent: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def block(rows: pa.Table) -> Iterator[tuple]:
        nodes = rows.column("node").to_pylist()
        home = np.array(rows.column("at_first").to_pylist(), bool)
        flat = rows.column("grams").combine_chunks()
        cuts, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        sets = [values[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        left = np.flatnonzero(home)
        right = left if rows.column("inside")[0].as_py() else np.flatnonzero(~home)
        if not len(left) or not len(right):
            return
        linked = _block_product(np.diff(cuts).astype(np.float64), sets, left, right, percent)
        if left is right:
            np.fill_diagonal(linked, False)
        root = _roots(linked, left, right, len(nodes))
        degree = np.zeros(len(nodes), np.int64)
        degree[left] = linked.sum(1)
        if left is not right:
            degree[right] = linked.sum(0)
        yield from ((nodes[i], nodes[root[i]], int(degree[i])) for i in np.flatnonzero(degree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(schema, (row for rows in runs(batches, "pair") for row in block(rows)))

    return run


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80, sampled: float | None = None, block: int = 1024, grams: int = 1 << 19) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs`` (doc_id, text).

    A document's set are its distinct k-word shingles (A-Z lower-cased; fewer words: the whole
    sequence). Two link when 100 * intersection >= percent * union. component_id is the smallest
    doc_id reachable over links; n_links counts the different sets that a row's set links with.

    Null or wordless text: an empty set, linked with nothing, its own component. Repeated rows:
    one result each, of one component. A null doc_id is never a component's id unless all are null.
    No rows: no rows. Further columns are ignored. Very long texts are worked on whole.

    ``sampled``: the share of the space of hashes that the first count covers, by default half as
    much again as a linked pair can differ by. ``block`` and ``grams``: rows of a block and their
    n-grams together, about. These change the work, never the result. What is sent for a group of N
    rows that are all near copies of one another is N / block times their sets, for n_links counts
    every pair of them.
    """
    sampled = min(0.999, 1.5 * (1 - percent / 100)) if sampled is None else sampled
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    rows = stored(docs.mapInArrow(_summaries(k, sampled), "doc_id long, n_shingles long, x long, y long, low array<long>"), "rows")
    sets = rows.where("n_shingles > 0").groupBy("x", "y").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"))
    some = stored(_linkable(rows, "low", sets, percent), "some")
    texts = docs.join(fitting(some), docs.doc_id.eqNullSafe(some.id)).select("x", "y", "text")
    whole = texts.mapInArrow(_whole_sets(k), "node binary, x long, y long, n long, grams array<long>")
    if rows.groupBy("doc_id", "x", "y").count().where("count > 1").isEmpty():
        whole = stored(whole, "whole")
    else:  # repeated rows
        whole = stored(whole.dropDuplicates(["x", "y"]), "whole")
    kept = stored(_linkable(whole, "grams", some, percent), "kept")
    few = stored(whole.drop("n").join(fitting(kept), ["x", "y"]), "few")
    discard(some, whole, kept)

    # Entries: a row's first few n-grams in the order of rising frequency. Counts are taken map-side first.
    each = few.select(F.explode("grams").alias("gram"), "x", "y")
    often = each.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    shared = few.select("x", "y", "node", "n").join(each.join(often, "gram"), ["x", "y"])
    own = Window.partitionBy("x", "y")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("m", "gram"))
    ranked = stored(shared.withColumn("rank", rank).where(F.col("rank") <= _differ(percent)).select("gram", "node", "n"), "ranked")
    leads = ranked.groupBy("gram").agg(F.count("*").alias("m"), F.min("node").alias("lead")).where("m > 1").select("gram", "lead")
    entries = stored(ranked.join(leads, "gram"), "entries")

    # A block is named by the smallest node among the neighbours of a row's neighbours.
    near = entries.groupBy("node").agg(F.min("lead").alias("label"), F.max("n").alias("n"))
    labels = entries.join(near, "node").groupBy("gram").agg(F.min("label").alias("label"))
    near = entries.join(labels, "gram").groupBy("node").agg(F.min("label").alias("label"), F.max("n").alias("n"))
    near = stored(near, "near")
    size = near.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / grams)).cast("int").alias("parts"))
    home = near.join(size, "label").select("node", F.struct("label", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")).alias("home"))
    placed = stored(entries.select("gram", "node").join(home, "node"), "placed")
    other = placed.groupBy("gram", F.col("home").alias("other")).agg(F.count("*").alias("m"))
    dealt = placed.join(other, "gram").where((F.col("home") != F.col("other")) | (F.col("m") > 1))
    pair = F.sha2(F.to_json(F.struct(F.least("home", "other").alias("x"), F.greatest("home", "other").alias("y"))), 256)
    dealt = dealt.select("node", F.struct(F.unhex(pair).alias("pair"), (F.col("home") <= F.col("other")).alias("at_first"), (F.col("home") == F.col("other")).alias("inside")).alias("deal"))
    dealt = dealt.groupBy("node").agg(F.collect_set("deal").alias("deals"))
    work = few.join(dealt, "node").select("node", "grams", F.inline("deals"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    work = work.repartition(int(parts), "pair").sortWithinPartitions("pair")
    found = stored(work.mapInArrow(_links(percent), "a binary, b binary, links long"), "links")
    discard(ranked, entries, near, placed)

    # Components by set; a set that links with none is its own. Rows join their set once.
    joined = components(found.select("a", "b"))
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = few.select("x", "y", "node", "id").join(joined, "node").join(degree, "node", "left")
    lows = linked.groupBy("component").agg(F.min("id").alias("low"))
    linked = linked.join(lows, "component").select("x", "y", "low", "n_links")
    named = sets.join(linked, ["x", "y"], "left").select("x", "y", F.coalesce("low", "id").alias("low"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = rows.select("doc_id", "n_shingles", "x", "y").join(named, ["x", "y"], "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), k=3, percent=90)
