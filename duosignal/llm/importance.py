"""Importance resampling towards a target distribution of word n-grams.

Separators collapse to single spaces; an overlapped scan with a regular expression gives the n-grams
that start at each word as spans, which are counted by the CRC of their bytes. A document weighs
what its buckets gain in the target over the corpus, and Gumbel noise from its id turns the highest
scores into a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duosignal.llm.shared import discard, small_batches, stored, table, utf8

#: ASCII that parts words: all but digits and letters. Bytes of other characters belong to words.
PARTING = bytes(c for c in range(128) if not chr(c).isalnum())
SPACED = bytes.maketrans(PARTING, b" " * len(PARTING))


def scanner(most: int) -> regex.Pattern:
    """A word from its border on, and up to ``most`` - 1 following ones as groups of their own."""
    more = b""
    for _ in range(most - 1):
        more = rb"(?:( [^ ]++)" + more + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]++)" + more + rb"(?![^ ])")


def word_spans(text: bytes, scan: regex.Pattern, piece: int = 1 << 20) -> Iterator[tuple[bytes, regex.Match]]:
    """(collapsed piece, match) for each word of a text in lower case (A-Z), with the words that follow it.

    Pieces end between words; the last words of a piece, whose followers are in the next, are scanned there.
    """
    flat, at, kept = text.lower().translate(SPACED), 0, []
    while at < len(flat):
        end = flat.find(b" ", at + piece)
        end = len(flat) if end < 0 else end
        words = kept + flat[at:end].split()
        at, own = end, b" ".join(words)
        kept = words[len(words) - min(len(words), scan.groups - 1) :] if at < len(flat) else []
        limit = len(own) - len(b" ".join(kept)) if kept else len(own)
        for found in scan.finditer(own, overlapped=True):
            if found.start() >= limit:
                break
            yield own, found


def grams(text: bytes, scan: regex.Pattern, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(how many words, n-gram) of each n-gram of a text, repeats included, in the order of their starts."""
    for own, found in word_spans(text, scan, piece):
        start = found.start()
        for words in range(1, scan.groups + 1):
            end = found.end(words)
            if end < 0:
                break
            yield words, own[start:end]


def _scanned(most: int, buckets: int, keep: list[str]):
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, part, place = scanner(most), TaskContext.get().partitionId(), 0
        for batch in batches:
            found, words = [], []
            for text in utf8(batch.column("text")):
                n = 0

                def ids() -> Iterator[int]:
                    nonlocal n
                    for size, gram in grams(text, scan):  # noqa: B023  used at once
                        n += size == 1
                        yield crc32(gram) % buckets

                found.append(np.fromiter(ids(), kind).tobytes())
                words.append(n)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(np.full(n, part, np.int64)), pa.array(np.arange(place, place + n)), pa.array(words, pa.int64()), pa.array(found, pa.binary())],
                names=[*keep, "part", "place", "n_words", "found"],
            )
            place += n

    return run


def _tallied(buckets: int):
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column("found"):
                counts += np.bincount(np.frombuffer(found.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    return run


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; tasks send what they added up, the driver gets ``buckets`` numbers."""
    rows = scanned.select("found").mapInArrow(_tallied(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * the log ratio) of each bucket's share of the target to that of the corpus, plus one each."""
    both = [float(x.sum() + len(x)) for x in (corpus, target)]
    return np.array([floor(1000 * log((t + 1) * both[0] / ((s + 1) * both[1]))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain, keep: list[str], buckets: int):
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(found.as_buffer(), kind) for found in batch.column("found")]
            weights = [int(gain.value[i].sum()) // len(i) if len(i) else 0 for i in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([len(i) for i in ids], pa.int64()), pa.array(weights, pa.int64())], names=[*keep, "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256(``<seed>:<doc_id>``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their ``rank`` (from 1) in a total order, by ranges of it: no task holds more than a range."""
    ranges = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_here", here).join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + F.col("_here")).drop("_range", "_here", "_before")


def resample(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text).

    Features are all runs of 1 to ``most`` words of whole texts, repeats counted, in ``buckets`` by
    the crc32 of their bytes; words are what ASCII but letters and digits parts, A-Z in lower case.
    weight is the floored mean of the buckets' gains in ``target`` (text) over ``docs``, 0 without
    features. Of the rows with at least ``least`` words, ``percent`` in a hundred (rounded down) of
    the highest scores (weight plus noise by doc_id) are drawn; rank orders them from 1, ties to the
    smaller doc_id (null last, read as empty for the noise), of equal ids to the first read; it is
    null if not drawn. Null texts have no words. No rows: no rows; no target: gains over an even
    one. Further columns are ignored. What tasks found is written once, as bucket numbers, and read
    for the counts and for the weights.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = ["doc_id"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stored(docs.select("doc_id", "text").mapInArrow(_scanned(most, buckets, keep), f"doc_id {kind}, part long, place long, n_words long, found binary"), "scanned")
    wanted = target.select("text").mapInArrow(_scanned(most, buckets, []), "part long, place long, n_words long, found binary")
    gain = spark.sparkContext.broadcast(gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets)))
    keep = ["doc_id", "part", "place", "n_words"]
    weighed = scanned.mapInArrow(_weighed(gain, keep, buckets), f"doc_id {kind}, part long, place long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    discard(scanned)
    enough = scored.where(F.col("n_words") >= least)
    drawn = enough.count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = ranked(enough, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("part"), F.asc("place")]).withColumn("rank", rank)
    return out.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
