"""Removal of repeated byte strings by a difference-cover sample of the suffixes.

Positions are sampled whose remainder by 91 lies in a perfect difference set: whatever the distance
of two equal strings of ``length`` bytes, some offset below 91 is sampled in both. Sampled suffixes
are named by a 64-bit polynomial hash of their first length - 90 bytes; rows are sorted by that hash
to bring equal ones together. Buckets of equal hashes replace the lexicographic order of suffixes,
and neighbours' prefixes are not compared. Rows whose name repeats meet again with up to 90 bytes of
both sides, and within a name every way to complete it to ``length`` bytes is compared, pair by pair
or by tables of hashes; that stands for the suffixes that were not sampled. So results hold but for
collisions of hashes, and only prefixes that can matter are named. A name that more than a few
thousand rows share is halved first: with 45 bytes more of one side or of the other it is two names,
and so on until few rows share one or all of its rows are alike, which is counted, not held.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.llm.shared import discard, emit, fitting, free_names, small_batches, stored, table, utf8
from duosignal.llm.shingles import mix

# Each remainder by 91 but 0 is the difference of just one pair of these.
PERIOD, COVER = 91, np.array([0, 1, 3, 9, 27, 49, 56, 61, 77, 81])
SIDE = PERIOD - 1

_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _OTHER = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse by 2 ** 64, kept for the next text."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                _POWERS[i] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, base, np.uint64))), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def window_hashes(a: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` bytes from each of the rising starts.

    Long texts are worked on in blocks, so that they need little more memory than their bytes.
    """
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(a) + _BLOCK, _BLOCK))
    for low, x, y in zip(range(0, len(a), _BLOCK), cuts[:-1], cuts[1:], strict=False):
        if x < y:
            part, own = a[low : low + _BLOCK + length], starts[x:y] - low
            up, down = _powers(len(part) + 1)
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * up[: len(part)], dtype=np.uint64)))
                out[x:y] = mix((sums[own + length] - sums[own]) * down[own])
    return out


def _who(h: int, g: int, at: np.ndarray) -> np.ndarray:
    """64 bits that stand for a text and a position in it."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(h & 0xFFFFFFFFFFFFFFFF) + mix((at + 1).astype(np.uint64) * _OTHER + np.uint64(g & 0xFFFFFFFF)))


def _short(who: np.ndarray) -> np.ndarray:
    return who >> np.uint64(41)


def sampled_positions(n: int) -> np.ndarray:
    return (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()


def _sample(length: int, turn: int, turns: int, flush: int = 1 << 19):
    """(name, ref) of sampled suffixes whose name falls to ``turn``.

    ref holds 40 bits of the text's key, 23 bits of a hash of the whole key and the position, and
    one bit that says that the name is known to repeat. Of a name that repeats within what a task
    holds at a time one row carries it on; that is decided on whole keys and positions, so two
    places of one text never count as one.
    """
    name_length = length - SIDE

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            for h, g, text in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), utf8(batch.column("text")), strict=True):
                if len(text) < length:
                    continue
                at = sampled_positions(len(text))
                at = at[at + name_length <= len(text)]
                name = window_hashes(np.frombuffer(text, np.uint8), at, name_length)
                mine = name % np.uint64(turns) == turn
                who = _who(h, g, at[mine])
                held.append((name[mine], who, np.uint64(h & 0xFFFFFFFFFF000000) | (_short(who) << np.uint64(1))))
                n += len(who)
                if n >= flush:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def carried(name: np.ndarray, who: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(name)
        same = name[order[1:]] == name[order[:-1]]
        inner = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[inner] = order[inner][np.lexsort((who[order[inner]], name[order[inner]]))]
        name, who, ref = name[order], who[order], ref[order]
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (who[1:] != who[:-1])
        name, ref = name[fresh], ref[fresh]
        follows = np.zeros(len(name), bool)
        follows[1:] = name[1:] == name[:-1]
        known = follows.copy()
        known[:-1] |= follows[1:]
        ref = ref | known.astype(np.uint64)
        return np.where(follows, mix(ref), name), ref

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in pieces(batches):
            name, ref = carried(*held)
            for i in range(0, len(name), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].view(np.int64)) for x in (name, ref)], names=["name", "ref"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h40, mark) of sorted (name, ref) rows that are known to repeat or share a name with another ref."""
    out = lambda r: pa.RecordBatch.from_arrays([pa.array(r >> 23), pa.array(r & 0x7FFFFF)], names=["h40", "mark"])
    name, ref, known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    for batch in batches:
        if batch.num_rows:
            rest = batch.column(1).to_numpy()
            name, ref, known = np.append(name, batch.column(0).to_numpy()), np.append(ref, rest >> 1), np.append(known, rest & 1 == 1)
            fresh = np.ones(len(name), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (ref[1:] != ref[:-1])
            first = np.flatnonzero(fresh)
            name, ref, known = name[first], ref[first], np.logical_or.reduceat(known, first)
            same = name[1:] == name[:-1]
            known[1:] |= same
            known[:-1] |= same
            yield out(ref[:-1][known[:-1]])
            name, ref, known = name[-1:], ref[-1:], known[-1:]
    yield out(ref[known])


_SIDES = "name long, h long, g int, at long, n_before int, n_after int, sides binary, known boolean"


def _with_sides(length: int, flush: int = 60_000):
    """Marked suffixes with SIDE bytes of both sides, the nearest first.

    Of rows that are equal in all these bytes among what a task holds at a time one is carried on;
    the others are settled and go without their sides. Long texts are taken in pieces.
    """
    name_length = length - SIDE
    away = np.arange(SIDE)

    def pieces(h: int, g: int, text: bytes, marks: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        n = len(text)
        at = sampled_positions(n)
        at = at[at + name_length <= n]
        who = _who(h, g, at)
        wanted = np.isin(_short(who).view(np.int64), marks)
        at, key = at[wanted], who[wanted]
        a = np.frombuffer(text, np.uint8)
        name = window_hashes(a, at, name_length)
        before, after = np.minimum(at, SIDE), np.minimum(n - at - name_length, SIDE)
        full = np.flatnonzero((before == SIDE) & (after == SIDE))
        key[full] = window_hashes(a, at[full] - SIDE, length + SIDE)
        for i in range(0, len(at), flush // 4):
            p = slice(i, i + flush // 4)
            left, right = at[p, None] - 1 - away, at[p, None] + name_length + away
            sides = np.hstack((np.where(left >= 0, a[np.maximum(left, 0)], 0), np.where(right < n, a[np.minimum(right, n - 1)], 0))).astype(np.uint8)
            m = len(sides)
            yield {"name": name[p].view(np.int64), "h": np.full(m, h), "g": np.full(m, g, np.int32), "at": at[p], "n_before": before[p].astype(np.int32), "n_after": after[p].astype(np.int32), "sides": sides, "key": key[p]}

    def settled(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        _, first, inverse, count = np.unique(rows.pop("key"), return_index=True, return_inverse=True, return_counts=True)
        extra = np.ones(len(inverse), bool)
        extra[first] = False
        yield from _side_batches(rows, count[inverse] > 1, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            flat = batch.column("marks")
            cuts, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            for h, g, text, i, j in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), utf8(batch.column("text")), cuts[:-1], cuts[1:], strict=True):
                for piece in pieces(h, g, text, values[i:j]):
                    held.append(piece)
                    n += len(piece["at"])
                    if n >= flush:
                        yield from settled(held)
                        held, n = [], 0
        if n:
            yield from settled(held)

    return run


def _side_batches(rows: dict[str, np.ndarray], known: np.ndarray, extra: np.ndarray, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows; extra ones are settled and go without their sides."""
    for i in range(0, len(known), size):
        part = slice(i, i + size)
        bare = extra[part]
        ends = np.cumsum(np.append(0, np.where(bare, 0, 2 * SIDE))).astype(np.int32)
        present = pa.py_buffer(np.packbits(~bare, bitorder="little").tobytes())
        sides = pa.Array.from_buffers(pa.binary(), len(bare), [present, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows["sides"][part][~bare].tobytes())])
        plain = [pa.array(rows[c][part]) for c in ("name", "h", "g", "at", "n_before", "n_after")]
        yield pa.RecordBatch.from_arrays([*plain, sides, pa.array(known[part])], names=["name", "h", "g", "at", "n_before", "n_after", "sides", "known"])


def _side_hashes(sides: np.ndarray) -> np.ndarray:
    """Hashes of the first 0 to SIDE bytes of each row."""
    hashes = np.zeros((SIDE + 1, len(sides)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SIDE):
            hashes[i + 1] = (hashes[i] ^ (hashes[i] >> np.uint64(29))) * np.uint64(_BASE) + _TABLE[sides[:, i]]
    return hashes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes rows begin with in common."""
    other = a != b
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


def _covered(name: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least and most bytes before the name with which the whole string repeats.

    Most is below least where none does. Rows are sorted by name.
    """
    before, after = sides[:, :SIDE], sides[:, SIDE:]
    wide = np.ascontiguousarray(np.hstack((sides, n_before[:, None].astype(np.uint8), n_after[:, None].astype(np.uint8), np.zeros((len(name), 2), np.uint8)))).view(np.uint64)
    with np.errstate(over="ignore"):
        alike = mix(name.view(np.uint64))
        for i in range(wide.shape[1]):
            alike = mix(alike + wide[:, i] * _OTHER)
    # Rows alike in name and both sides: any completion repeats. Of these one is compared on.
    _, first, inverse, count = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
    low, high = np.full(len(count), SIDE + 1), np.full(len(count), -1)
    many = count > 1
    low[many], high[many] = np.maximum(0, SIDE - n_after[first[many]]), np.minimum(SIDE, n_before[first[many]])
    order = np.argsort(first)
    rows = first[order]
    _, start, size = np.unique(name[rows], return_index=True, return_counts=True)
    for m in range(2, 7):  # small groups pair by pair
        head = start[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                x, y = rows[head + i], rows[head + j]
                left = np.minimum(_common(before[x], before[y]), np.minimum(n_before[x], n_before[y]))
                right = np.minimum(_common(after[x], after[y]), np.minimum(n_after[x], n_after[y]))
                fit = left + right >= SIDE
                for own in (order[head + i][fit], order[head + j][fit]):
                    low[own], high[own] = np.minimum(low[own], SIDE - right[fit]), np.maximum(high[own], left[fit])
    large = np.flatnonzero(np.repeat(size > 6, size))
    if len(large):
        own, at = order[large], rows[large]
        h_before, h_after = _side_hashes(before[at]), _side_hashes(after[at])
        with np.errstate(over="ignore"):
            for x in range(SIDE + 1):
                fit = np.flatnonzero((n_before[at] >= x) & (n_after[at] >= SIDE - x))
                key = mix(name[at][fit].view(np.uint64) + mix(h_before[x, fit] * _OTHER + h_after[SIDE - x, fit]))
                by_key = np.argsort(key)
                same = np.zeros(len(key) + 1, bool)
                same[1:-1] = key[by_key][1:] == key[by_key][:-1]
                found = own[fit[by_key[same[1:] | same[:-1]]]]
                low[found], high[found] = np.minimum(low[found], x), np.maximum(high[found], x)
    return low[inverse], high[inverse]


def _matrix(sides: pa.Array) -> np.ndarray:
    """The side bytes of each row; no row is null."""
    return np.frombuffer(sides.buffers()[2], np.uint8)[sides.offset * 2 * SIDE :][: len(sides) * 2 * SIDE].reshape(-1, 2 * SIDE)


_SPAN = "h long, g int, start long, stop long"


def _spans(length: int, chunk: int = 40_000):
    """(h, g, start, stop) that repeat, from rows sorted by name. A task holds whole names."""
    name_length = length - SIDE

    def cover(t: pa.Table) -> pa.RecordBatch:
        name, at, n_before, n_after = (t.column(c).to_numpy() for c in ("name", "at", "n_before", "n_after"))
        least, most = _covered(name, n_before, n_after, _matrix(t.column("sides").combine_chunks()))
        found = np.flatnonzero(most >= least)
        at = at[found]
        return pa.RecordBatch.from_arrays([t.column("h").to_numpy()[found], t.column("g").to_numpy()[found], at - most[found], at + name_length + SIDE - least[found]], names=["h", "g", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                rows = pa.Table.from_batches(held)
                names = rows.column("name").to_numpy()
                end = int(np.searchsorted(names, names[-1]))
                if end:
                    yield cover(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
        if held:
            yield cover(pa.Table.from_batches(held))

    return run


_HALF = "name long, whole long, x0 int, x1 int, h long, g int, at long, n_before int, n_after int, sides binary"


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows twice, for the lower and the upper half of the numbers x0 to x1 of bytes before the name.

    name stands for what all strings with a number in that half share, whole for what they span; a
    half for which a row has too few bytes is left out, and whole is null where only some fit.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        name, x0, x1, n_before, n_after = (batch.column(c).to_numpy() for c in ("name", "x0", "x1", "n_before", "n_after"))
        sides = _matrix(batch.column("sides"))
        h_before, h_after = _side_hashes(sides[:, :SIDE]), _side_hashes(sides[:, SIDE:])
        row = np.arange(len(name))

        def key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):  # noqa: B023
                return mix(mix(name.view(np.uint64) + before.astype(np.uint64)) + mix(h_before[before, row] * _OTHER + h_after[after, row])).view(np.int64)  # noqa: B023

        for y0, y1 in ((x0, (x0 + x1) // 2), ((x0 + x1) // 2 + 1, x1)):
            y1 = np.maximum(y0, y1)
            shared, whole = key(y0, SIDE - y1), key(y1, SIDE - y0)
            fits = np.flatnonzero((y0 <= x1) & (n_before >= y0) & (n_after >= SIDE - y1))
            spanned = (n_before >= y1) & (n_after >= SIDE - y0)
            columns = [pa.array(shared[fits]), pa.array(whole[fits], mask=~spanned[fits]), pa.array(y0[fits].astype(np.int32)), pa.array(y1[fits].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(pa.array(fits)) for c in ("h", "g", "at", "n_before", "n_after", "sides"))], names=["name", "whole", "x0", "x1", "h", "g", "at", "n_before", "n_after", "sides"])


def _crowded(rows: DataFrame, most: int) -> DataFrame | None:
    """Names that more than ``most`` rows share, counted map-side first; None if there are none."""
    names = stored(rows.groupBy("name").count().where(F.col("count") > most).select("name"), "crowded")
    return None if names.isEmpty() else fitting(names)


def _all_spans(sides: DataFrame, length: int, most: int) -> DataFrame:
    """(h, g, start, stop) of the rows that _with_sides gives, stored.

    No task holds more than ``most`` rows of a name. Names with more are halved: rows whose
    whole strings over a half are alike are settled by their count, and of these one stays; then the
    names of the halves are looked at in the same way. At
    a single number of bytes before the name what is shared is the whole string, so that ends.
    """
    end = F.col("at") + length
    found = [sides.where("known").select("h", "g", (F.col("at") - F.least(F.col("n_before"), F.lit(SIDE))).alias("start"), (F.col("at") + length - SIDE + F.least(F.col("n_after"), F.lit(SIDE))).alias("stop"))]
    rows = sides.where("sides is not null").select("name", "h", "g", "at", "n_before", "n_after", "sides")
    x0, x1 = F.lit(0), F.lit(SIDE)
    used = []
    while True:
        names = _crowded(rows, most)
        few = rows if names is None else rows.join(names, "name", "left_anti")
        parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        few = few.select("name", "h", "g", "at", "n_before", "n_after", "sides").repartition(parts, "name").sortWithinPartitions("name")
        found.append(few.mapInArrow(_spans(length), _SPAN))
        if names is None:
            break
        many = rows.join(names, "name", "left_semi").select("name", x0.cast("int").alias("x0"), x1.cast("int").alias("x1"), "h", "g", "at", "n_before", "n_after", "sides")
        many = stored(many.mapInArrow(_halved, _HALF), "halved")
        used.append(many)
        names = _crowded(many, most)
        if names is None:
            rows = many
            continue
        hot = many.join(names, "name", "left_semi")
        row = F.struct("h", "g", "at")
        twice = hot.where("whole is not null").groupBy("whole").agg(F.count("*").alias("n"), F.min(row).alias("one")).where("n > 1").select("whole", "one")
        twice = stored(twice, "twice")
        used.append(twice)
        twice = fitting(twice)
        found.append(hot.join(twice, "whole", "left_semi").select("h", "g", (F.col("at") - F.col("x1")).alias("start"), (end - F.col("x0")).alias("stop")))
        # One row of each settled string stays, for others may share a part of it.
        rest = hot.join(twice, "whole", "left").where("x0 < x1").where(F.col("one").isNull() | (F.col("one") == row)).drop("one")
        rows = many.join(names, "name", "left_anti").unionByName(rest)
        x0, x1 = F.col("x0"), F.col("x1")
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    spans = stored(spans, "spans")
    discard(*used)
    return spans


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans united where they touch, from rows sorted by h, g and start."""
    names = ["h", "g", "start", "stop"]
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, start, stop = (np.concatenate(([x], c.to_numpy())) if last else c.to_numpy() for x, c in zip(last or names, batch.columns, strict=True))
        other = np.append(False, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        lift = np.cumsum(other) * (int(stop.max()) + 1)
        far = np.maximum.accumulate(stop + lift)
        first = np.flatnonzero(np.append(True, start[1:] + lift[1:] > far[:-1]))
        far = far[np.append(first[1:], len(h)) - 1] - lift[first]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first[:-1]], g[first[:-1]].astype(np.int32), start[first[:-1]], far[:-1])], names=names)
        last = (h[first[-1]], g[first[-1]], start[first[-1]], far[-1])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)


def merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["stop"], n)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they cut."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


_CUT = "h long, g int, spans array<struct<start:bigint,stop:bigint>>, n_removed long, kept_sha256 string, kept string"


def _cut(with_text: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("spans", span), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for h, g, text, spans in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            own = merged(spans, len(text))
            kept = _without(text, _whole_characters(text, own)).decode() if with_text else None
            yield h, g, [{"start": a, "stop": b} for a, b in own], sum(b - a for a, b in own), sha256(_without(text, own)).hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from emit(schema, rows(batch), 500)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with h and g, 96 bits that stand for the text, null as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"h": F.xxhash64(text), "g": F.hash(text)})


def repeated_passages(docs: DataFrame, length: int = 200, turns: int = 2, with_text: bool = False, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """What of each text is covered by strings of ``length`` bytes that also start elsewhere.

    ``docs`` has doc_id and text (null: empty; further columns are ignored). Gives its rows as
    (doc_id, h, g, n_bytes, sha256), and for each different text (h, g) that loses any byte its
    merged ``spans``, n_removed and kept_sha256 (``with_text``: also the kept text, where a
    character that a span cuts stays whole). Strings overlap, never cross texts, may repeat within
    one, and are judged on the input. Two rows of one text of ``length`` bytes or more lose all of
    it. ``turns`` deals the sampled suffixes into that many sorts, one after the other, which bounds
    the disk in use; ``most`` is how many rows of a name a task holds, names of more are halved.
    Neither changes the result. ``length`` must be over 100. No rows: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(docs.sparkSession, 2000)
    keyed = _keyed(docs)
    text = F.coalesce("text", F.lit(""))
    rows = stored(keyed.select("doc_id", "h", "g", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256")), "rows")
    texts = rows.where(F.col("n_bytes") >= length).groupBy("h", "g").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))

    turned = []
    for turn in range(turns):
        names = keyed.select("h", "g", "text").mapInArrow(_sample(length, turn, turns), "name long, ref long")
        found = names.repartition(parts, "name").sortWithinPartitions("name", "ref").mapInArrow(_repeated, "h40 long, mark long")
        turned.append(stored(found.distinct(), "marks"))
    marks = turned[0]
    for more in turned[1:]:
        marks = marks.union(more)
    marks = marks.groupBy("h40").agg(F.collect_set("mark").alias("marks"))
    wanted = texts.withColumn("h40", F.shiftright("h", 24)).join(marks, "h40").select("id", F.col("h").alias("_h"), F.col("g").alias("_g"), "marks")
    some = keyed.join(wanted, keyed.doc_id.eqNullSafe(wanted.id) & (keyed.h == wanted["_h"]) & (keyed.g == wanted["_g"]))
    some = stored(some.select("h", "g", "text", "marks"), "some")
    discard(*turned)

    sides = stored(some.mapInArrow(_with_sides(length), _SIDES), "sides")
    spans = _all_spans(sides, length, most)
    discard(sides)
    copied = texts.where("copies > 1").select("h", "g", "n_bytes")
    united = spans.join(copied, ["h", "g"], "left_anti").repartition(parts, "h", "g").sortWithinPartitions("h", "g", "start").mapInArrow(_united, _SPAN)
    once = united.groupBy("h", "g").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = some.select("h", "g", "text").join(once, ["h", "g"]).mapInArrow(_cut(with_text), _CUT)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    gone = copied.select("h", "g", whole.alias("spans"), F.col("n_bytes").alias("n_removed"), F.lit(sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("" if with_text else None).cast("string").alias("kept"))
    cut = stored(cut.union(gone), "cut")
    discard(some, spans)
    return rows, cut


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated passages cut out of text, and n_chars, if there, counted anew.

    Rows and columns stay as they are otherwise; a null text stays null.
    """
    _, cut = repeated_passages(docs, length, with_text=True)
    h, g, kept = free_names(docs, "h", "g", "kept")
    cut = cut.select(F.col("h").alias(h), F.col("g").alias(g), F.col("kept").alias(kept))
    text = F.coalesce("text", F.lit(""))
    here = docs.join(cut, (F.xxhash64(text) == F.col(h)) & (F.hash(text) == F.col(g)), "left")
    changed = F.col(h).isNotNull()
    out = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return here.select(*[out[c].alias(c) if c in out else docs[c] for c in docs.columns])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows, cut = repeated_passages(table(spark, sf_dir, "documents"))
    cut = cut.select("h", "g", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    return rows.join(cut, ["h", "g"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
