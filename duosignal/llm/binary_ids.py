"""Token ids in files of patched frame-of-reference blocks, as a Spark data source.

A file holds the ids of consecutive documents. Blocks of 256 ids keep their minimum and the
differences to it, packed at the width that a percentile of the block needs; what is wider has its
upper bits in a list of exceptions. A footer indexes where blocks start and how many ids each
document has, so any range of ids is read from just its blocks. A manifest lists the files that were
committed, in order.

    file      MAGIC, blocks, footer, four 64-bit numbers (blocks, documents, ids, where the footer starts), MAGIC
    block     minimum (32 bits), ids in it (16), exceptions (16), width (8), 7 zero bytes; packed differences
              (256 * width bits, little-endian, padded with zeros); places of exceptions (16 each), upper bits (32 each)
    footer    block starts (64), documents' ids (64), documents without id (8), counts of ids (64)

All numbers are little-endian.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from duosignal.llm.shared import free_names, small_batches, table
from duosignal.sources.workspace import work_folder

MAGIC, BLOCK, HEADER = b"PFORIDS1", 256, 16
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**width as rows of bytes."""
    words = np.zeros((len(values), BLOCK * width // 64 + 1), np.uint64)
    for i in range(BLOCK if width else 0):
        word, bit = divmod(i * width, 64)
        words[:, word] |= values[:, i] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= values[:, i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words[:, :-1]).astype("<u8").view(np.uint8)


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    """What ``pack`` was given."""
    out = np.zeros((len(rows), BLOCK), np.uint64)
    words = np.ascontiguousarray(rows).view("<u8").astype(np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, bit = divmod(i * width, 64)
        out[:, i] = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            out[:, i] |= words[:, word + 1] << np.uint64(64 - bit)
    return out & mask


def encode_blocks(ids: np.ndarray, percentile: float = 90.0) -> list[bytes]:
    """The blocks of 32-bit ids; only the last may have fewer than BLOCK."""
    many = -(-len(ids) // BLOCK)
    if not many:
        return []
    grid = np.concatenate([ids.astype(np.uint64), np.full(many * BLOCK - len(ids), ids[-1], np.uint64)]).reshape(many, BLOCK)
    low = grid.min(1)
    grid = grid - low[:, None]
    wanted = np.percentile(grid, percentile, axis=1, method="higher").astype(np.uint64)
    widths = np.array([int(w).bit_length() for w in wanted])
    over = grid >> widths.astype(np.uint64)[:, None]
    row, place = np.nonzero(over)
    upper = over[row, place].astype("<u4")
    exceptions = np.bincount(row, minlength=many)
    ends = np.cumsum(exceptions)
    head = np.zeros(many, np.dtype([("low", "<u4"), ("n", "<u2"), ("exceptions", "<u2"), ("width", "u1"), ("zero", "u1", 7)]))
    head["low"], head["n"], head["exceptions"], head["width"] = low, BLOCK, exceptions, widths
    head["n"][-1] = len(ids) - (many - 1) * BLOCK
    packed: list[bytes] = [b""] * many
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        rows = pack(grid[own] & np.uint64((1 << int(width)) - 1), int(width))
        for i, data in zip(own, rows, strict=True):
            packed[i] = data.tobytes()
    place = place.astype("<u2")
    return [head[i].tobytes() + packed[i] + place[b - n : b].tobytes() + upper[b - n : b].tobytes() for i, (b, n) in enumerate(zip(ends, exceptions, strict=True))]


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    at = starts.astype(np.int64)
    head = np.ascontiguousarray(raw[at[:, None] + np.arange(HEADER)])
    low, n, exceptions, widths = head[:, :4].copy().view("<u4")[:, 0], head[:, 4:6].copy().view("<u2")[:, 0], head[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64), head[:, 8].astype(np.int64)
    out = np.zeros((len(at), BLOCK), np.uint64)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        size = BLOCK * int(width) // 8
        out[own] = unpack(raw[at[own][:, None] + HEADER + np.arange(size)], int(width)) if size else 0
    row = np.repeat(np.arange(len(at)), exceptions)
    if len(row):
        first = at + HEADER + BLOCK * widths // 8
        turn = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        place = np.ascontiguousarray(raw[(first[row] + 2 * turn)[:, None] + np.arange(2)]).view("<u2")[:, 0]
        upper = np.ascontiguousarray(raw[(first[row] + 2 * exceptions[row] + 4 * turn)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[row, place] |= upper.astype(np.uint64) << widths[row].astype(np.uint64)
    out += low[:, None]
    return out.reshape(-1)[(np.arange(BLOCK)[None, :] < n[:, None]).reshape(-1)].astype("<u4")


class IdsWriter:
    """One file, written a stretch of whole blocks at a time; holds what is not a block yet, and the index."""

    def __init__(self, sink, percentile: float = 90.0, held: int = 1 << 18) -> None:
        self.sink, self.percentile, self.most = sink, percentile, held
        self.held: list[np.ndarray] = []
        self.waiting, self.ids, self.at = 0, 0, len(MAGIC)
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.most:
            self._flush(self.waiting - self.waiting % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for block in encode_blocks(ids[:n], self.percentile):
            self.starts.append(self.at)
            self.at += len(block)
            self.sink.write(block)
        self.held, self.waiting, self.ids = [ids[n:]], len(ids) - n, self.ids + n

    def close(self) -> None:
        self._flush(self.waiting)
        empty = np.array([d is None for d in self.docs], np.uint8)
        for part in (np.array(self.starts, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), empty, np.array(self.counts, "<u8"), np.array([len(self.starts), len(self.docs), self.ids, self.at], "<u8")):
            self.sink.write(part.tobytes())
        self.sink.write(MAGIC)


class IdsFile:
    """A file that is open to be read, and its index."""

    def __init__(self, source) -> None:
        self.source = source
        tail = len(MAGIC) + 32
        size = source.size()
        end = self._read(max(0, size - tail), tail)
        if size < tail + len(MAGIC) or end[32:] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a whole file of ids")
        blocks, docs, self.n, at = (int(x) for x in np.frombuffer(end[:32], "<u8"))
        index = self._read(at, 8 * blocks + 17 * docs)
        self.starts = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at)).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.empty = np.frombuffer(index, np.uint8, docs, 8 * (blocks + docs)).astype(bool)
        self.counts = np.frombuffer(index, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` to before ``stop``, read from their blocks alone."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        data = self._read(int(self.starts[first]), int(self.starts[last] - self.starts[first]))
        return decode_blocks(data, self.starts[first:last] - self.starts[first])[start - first * BLOCK : stop - first * BLOCK]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path)))


def manifest(path: str) -> list[dict]:
    """The committed files, in the order of their documents: name, ids and documents of each."""
    where, folder = _place(path)
    if where.get_file_info(f"{folder}/manifest.json").type == fs.FileType.NotFound:
        return []
    with where.open_input_stream(f"{folder}/manifest.json") as held:
        return json.loads(held.read())


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    ids: int
    documents: int


@dataclass
class OneFile(InputPartition):
    name: str
    before: int


class PackedIds(DataSource):
    """``format("packed_ids")``: rows (doc_id, ids), ids as little-endian 32-bit numbers.

    A task writes one file of its rows in their order, files follow each other by the number of the
    task; nothing is seen before the manifest is replaced, so lost tasks and second attempts leave
    no rows. Appended rows follow those that are there. Read rows have also ``start``, how many ids
    stand before, and ``n_tokens``.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return PackedIdsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PackedIdsWriter(self.options["path"], float(self.options.get("percentile", "90")), overwrite)


class PackedIdsReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out, before = [], 0
        for file in manifest(self.path):
            out.append(OneFile(file["name"], before))
            before += file["ids"]
        return out

    def read(self, partition: OneFile | None, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        where, folder = _place(self.path)
        with where.open_input_file(f"{folder}/{partition.name}") as source:
            file = IdsFile(source)
            ends = np.cumsum(file.counts)
            first = 0
            while first < len(ends):
                start = int(ends[first] - file.counts[first])
                last = max(first + 1, int(np.searchsorted(ends, start + most, "right")))
                ids = file.ids(start, int(ends[last - 1]))
                own = slice(first, last)
                cuts = ends[own] - file.counts[own] - start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.docs[own], mask=file.empty[own]), pa.array(cuts + start + partition.before), pa.array(file.counts[own]), pa.array([ids[a : a + n].tobytes() for a, n in zip(cuts, file.counts[own], strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                first = last


class PackedIdsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, percentile: float, overwrite: bool) -> None:
        self.path, self.percentile, self.overwrite = path, percentile, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, name = TaskContext.get().partitionId(), ""
        where, folder = _place(self.path)
        out, sink = None, None
        for batch in iterator:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if out is None:
                    name = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"
                    where.create_dir(folder, recursive=True)
                    sink = where.open_output_stream(f"{folder}/{name}")
                    out = IdsWriter(sink, self.percentile)
                out.add(doc, np.frombuffer(ids.as_buffer() or b"", "<u4"))
        if out is None:
            return Written(part, "", 0, 0)
        out.close()
        sink.close()
        return Written(part, name, out.ids, len(out.docs))

    def commit(self, messages: list[Written]) -> None:
        where, folder = _place(self.path)
        files = [] if self.overwrite else manifest(self.path)
        files += [{"name": m.name, "ids": m.ids, "documents": m.documents} for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part)]
        where.create_dir(folder, recursive=True)
        new = f"{folder}/manifest-{uuid.uuid4().hex}.json"
        with where.open_output_stream(new) as out:
            out.write(json.dumps(files).encode())
        where.move(new, f"{folder}/manifest.json")

    def abort(self, messages: list[Written]) -> None:
        where, folder = _place(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{folder}/{m.name}")


#: A word of letters that the vocabulary's normalisation only puts in lower case, and marks that its pattern parts
#: from it; no special token has such marks alone.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{0,64})([!-&(-/:;=-@\[-`{-~]{0,64})")


class _Chunks(dict):
    """Ids of chunks of text without spaces; words in lower case and marks stand for themselves."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.letters = str.maketrans({c: tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))})

    def _part(self, part: str) -> bytes:
        """Ids of a word in lower case or of marks, by the library's model."""
        ids = self.get(part)
        if ids is None:
            ids = self[part] = array("I", [t.id for t in self.tokenize(part if part.isascii() else part.translate(self.letters))]).tobytes()
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha() and len(chunk) <= 64:
            low = chunk.lower()
            ids = self._part(low)
            if low != chunk:
                self[chunk] = ids
            return ids
        plain = PLAIN.fullmatch(chunk)
        if plain:
            word, marks = plain.groups()
            ids = self._part(word.lower()) + self._part(marks) if marks else self._part(word.lower())
        else:
            ids = array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
            if len(chunk) > 128:  # long ones hardly repeat
                return ids
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """What ``tokenizers`` gives for a text, a chunk between spaces or line ends at a time.

    The vocabulary's normalisation and split pattern never join what white space parts, and drop it.
    So a text's ids are those of its chunks; they repeat and are kept, up to ``held``. A chunk that
    is a plain word with marks behind it goes to the library's model in these two parts, in the
    letters that stand for their bytes; others pass all its steps.
    """

    def __init__(self, vocabulary: str = VOCABULARY, held: int = 300_000) -> None:
        self.known, self.held = _Chunks(Tokenizer.from_file(vocabulary)), held

    def __call__(self, text: str, end: int) -> bytes:
        if len(self.known) > self.held:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))) + end.to_bytes(4, "little")


@lru_cache(1)
def chunk_encoder(vocabulary: str) -> ChunkEncoder:
    """One for each worker process."""
    return ChunkEncoder(vocabulary)


def _encoded(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(t or "", end) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, percentile: float = 90.0) -> None:
    """Writes the ids of whole texts, each document's followed by ``end``, in the order of doc_id.

    ``docs`` has doc_id (integer) and text. Null text: ``end`` alone. Null doc_ids stand last; rows of
    one doc_id stand in the order in which they were read. No rows: no files. Further columns are
    ignored. Texts are dealt by ranges of doc_id and order of reading, so a range is a file and rows
    of one doc_id may be in several.
    """
    small_batches(docs.sparkSession)
    (row,) = free_names(docs.select("doc_id", "text"), "row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(row, F.monotonically_increasing_id())
    order = [F.asc_nulls_last("doc_id"), F.asc(row)]
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encoded(vocabulary, end), "doc_id long, ids binary")
    docs.sparkSession.dataSource.register(PackedIds)
    ids.write.format("packed_ids").mode("overwrite").option("percentile", str(percentile)).save(path)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files at ``path``, a file to a task."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(path)


def op13_binary_ids(spark, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
