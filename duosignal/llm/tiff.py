"""Media columns: TIFF pages written from bytes, and read back from image directories.

The reader walks the directories of either byte order, decodes PackBits, LZW and deflate strips and
tiles, undoes horizontal predictors and gives one row for each page.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duosignal.llm.shared import emit, per_row, table, utf8

# Field types by number (size, struct code), the tags used, and compression numbers.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
        else:
            j = i + 1
            while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
            i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears, 257 ends."""
    single = [bytes((i,)) for i in range(256)]
    words, width, held, bits, out, last = [*single, b"", b""], 9, 0, 0, [], b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            words, width, last = [*single, b"", b""], 9, b""
            continue
        if code > len(words) or code == len(words) and not last:
            raise ValueError("no such LZW code")
        word = words[code] if code < len(words) else last + last[:1]
        out.append(word)
        if last:
            words.append(last + word[:1])
        last = word
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    first = {bytes((i,)): i for i in range(256)}
    words, width, size, held, bits, out, word = dict(first), 9, 258, 0, 0, bytearray(), b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer], size, word = size, size + 1, data[i : i + 1]
        if size == 4094:
            put(256)
            words, width, size = dict(first), 9, 258
        elif size > (1 << width) - 1:
            width += 1
    if word:
        put(words[word])
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


PACK = {PLAIN: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}
UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def write_tiff(samples: np.ndarray, compression: int = DEFLATE, predictor: int = 2, page_rows: int = 512, strip_rows: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """An 8-bit grey image of ``samples`` (rows, width), cut into pages of ``page_rows``."""
    out, link = bytearray(b"II*\0" + bytes(4)), 4
    for top in range(0, len(samples), page_rows):
        page = samples[top : top + page_rows]
        high, wide = page.shape
        if tile:
            size = (-(-high // tile[0]) * tile[0], -(-wide // tile[1]) * tile[1])
            full = np.zeros(size, np.uint8)
            full[:high, :wide] = page
            parts = [full[y : y + tile[0], x : x + tile[1]] for y in range(0, size[0], tile[0]) for x in range(0, size[1], tile[1])]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, high, strip_rows)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            data = PACK[compression](part.tobytes())
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + bytes(len(data) % 2)
        fields = {WIDTH: [wide], HEIGHT: [high], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile[1]], TILE_HEIGHT: [tile[0]], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                data, at = struct.pack("<I", len(out)), data
                out += at
            entries += struct.pack("<HHI", tag, 4, len(values)) + data
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    """(fields, samples as rows x width x samples a pixel) of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        fields = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size, code = TYPES.get(kind, (1, "B"))
            place = at + 10 + 12 * i
            if size * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            fields[tag] = struct.unpack_from(order + code * count, data, place)
        yield fields, _samples(data, fields, order)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _narrow(raw: bytes, rows: int, wide: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, the highest first; rows begin at whole bytes."""
    line = -(-wide * bits // 8)
    single = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : wide * bits]
    return (single.reshape(rows, wide, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def _samples(data: bytes, fields: dict[int, tuple], order: str) -> np.ndarray:
    one = lambda tag, default: fields.get(tag, (default,))[0]
    wide, high, depth, planar = fields[WIDTH][0], fields[HEIGHT][0], one(SAMPLES, 1), one(PLANAR, 1)
    bits, packing = one(BITS, 1), one(COMPRESSION, 1)
    if len(set(fields.get(BITS, (1,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32) or packing not in UNPACK:
        raise ValueError(f"{bits} bits or compression {packing} are not read")
    kind = np.dtype("u1" if bits <= 8 else f"{order}u{bits // 8}")
    if wide * high * depth * bits / 8 > 2048 * len(data):  # more than any of the codes can hold
        raise ValueError("more pixels than data")
    tiled = TILE_OFFSETS in fields
    part_high, part_wide = (fields[TILE_HEIGHT][0], fields[TILE_WIDTH][0]) if tiled else (min(one(ROWS_PER_STRIP, high), high), wide)
    offsets, sizes = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    across, down = -(-wide // part_wide), -(-high // part_high)
    out = np.zeros((high, wide, depth), kind)
    each = 1 if planar == 2 else depth
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(i, across * down)
        y, x = place // across * part_high, place % across * part_wide
        rows = part_high if tiled else min(part_high, high - y)
        raw = UNPACK[packing](data[offset : offset + size])
        if bits < 8:
            part = _narrow(raw, rows, part_wide * each, bits).reshape(rows, part_wide, each)
        else:
            part = np.frombuffer(raw, kind, rows * part_wide * each).reshape(rows, part_wide, each)
        if one(PREDICTOR, 1) == 2 and bits >= 8:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("unknown predictor")
        band = slice(plane, plane + 1) if planar == 2 else slice(None)
        out[y : y + rows, x : x + part_wide, band] = part[: high - y, : wide - x]
    return out


def tiff_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of the TIFF files in the binary column ``media``.

    Keeps the key column ``doc_id`` and adds page (from 0), width, height, samples, compression,
    pixels (binary, rows first; samples of under 8 bits take a byte each) and error. A null or empty
    file has no pages. A damaged one, or one of a form that is not read, has the pages up to there
    and a row with the next page's number and an error. Repeated rows: pages each. No rows: no rows.
    Further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column(media).to_pylist(), strict=True):
            i = 0
            try:
                for fields, pixels in read_tiff(data) if data else ():
                    yield doc, i, pixels.shape[1], pixels.shape[0], pixels.shape[2], fields.get(COMPRESSION, (PLAIN,))[0], pixels.tobytes(), None
                    i += 1
            except (struct.error, zlib.error, ValueError, KeyError, IndexError, TypeError, ZeroDivisionError) as e:
                yield doc, i, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from emit(schema, rows(batch), 64)

    return files.select("doc_id", media).mapInArrow(run, "doc_id long, page int, width int, height int, samples int, compression int, pixels binary, error string")


def payload(text: bytes, width: int = 576) -> bytes:
    """The text and bytes 255 up to a positive multiple of ``width``."""
    return text + b"\xff" * (-len(text) % width if text else width)


def text_tiff(text: bytes, width: int = 576) -> bytes:
    return write_tiff(np.frombuffer(payload(text, width), np.uint8).reshape(-1, width))


def as_tiff(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each row's whole text (null: empty) as the samples of a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_tiff(t) for t in utf8(part.column("text"))], pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


_DIGEST = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(text: bytes) -> tuple:
    media = text_tiff(text)
    pages = [pixels for _, pixels in read_tiff(media)]
    back = b"".join(p.tobytes() for p in pages)
    counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
    share = counts[counts > 0] / len(back)
    mean, entropy = float(counts @ np.arange(256)) / len(back), -math.fsum(p * math.log2(p) for p in share.tolist())
    feature = f"pages={len(pages)};rows={sum(p.shape[0] for p in pages)};width={pages[0].shape[1]};mean={mean:.4f};entropy={abs(entropy):.4f}"
    return len(text), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), sha256(media).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    """A round trip of each row's whole text through TIFF, and features of the samples read back.

    Null text: empty, so one row of 255. Repeated rows: one result each, equal texts equal values.
    No rows: no rows. Further columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(per_row(_digest, _DIGEST, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_tiff(spark, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
