"""Best-fit packing by linear grouping.

Documents are encoded and cut once, on Spark; only the histogram of piece lengths, one number for
each length up to the sequence size, is planned with. Large lengths are rounded up within groups of
equal cardinality, configurations of few sizes are optimised for them by column generation, actual
lengths are substituted and small ones go where they fit best. The plan says which ranks of a length stand where, so pieces
find their place by one join of (length, rank).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duosignal.llm.shared import emit, fitting, stored, table
from duosignal.llm.tokens import RANKS, VOCABULARY, encoder

END = 2


def _pieces(size: int, vocabulary: str, ranks: str):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary, ranks), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + END.to_bytes(4, "little")
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    yield doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, int(seen[b - a])
                    seen[b - a] += 1

        for batch in batches:
            yield from emit(schema, rows(batch), 10_000)

    return run


def _groups(counts: dict[int, int], groups: int) -> list[tuple[int, deque]]:
    """Lengths in falling order, in groups of equal cardinality: (largest length, its runs)."""
    total, out, left = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not left:
                left = -(-total // groups)
                out.append((length, deque()))
            take = min(n, left)
            out[-1][1].append([length, take])
            n, left = n - take, left - take
    return out


def _heaviest(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The configuration of ``sizes`` (falling) within ``room`` that is worth most: (worth, how often each size)."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    for i in np.flatnonzero(worth > 1e-12):
        step = int(sizes[i])
        for _ in range(room // step):
            got = value[:-step] + worth[i]
            better = got > value[step:] + 1e-12
            if not better.any():
                break
            np.copyto(value[step:], got, where=better)
            np.copyto(last[step:], i, where=better)
    shape, c = np.zeros(len(sizes)), room
    while last[c] >= 0:
        shape[last[c]] += 1
        c -= int(sizes[last[c]])
    return float(worth @ shape), shape


def configurations(need: dict[int, int], room: int, turns: int = 600) -> list[tuple[np.ndarray, float]]:
    """Configurations of few sizes and how often each is used, so that all of ``need`` is met by the least in all.

    The linear programme over all configurations, by column generation: the one that is worth most at
    the prices of the sizes enters, until none is worth more than a sequence, or until the bound that
    prices give is reached but for less than a sequence, or after ``turns`` columns. Counts are of
    the fractional solution, which covers ``need`` whenever it ends.
    """
    sizes = np.array(sorted(need, reverse=True))
    wanted = np.array([need[s] for s in sizes], float)
    shapes = np.diag((room // sizes).astype(float))  # a column for each configuration in use
    inverse = np.diag(1 / np.diag(shapes))
    used = inverse @ wanted
    for turn in range(1, turns + 1):
        prices = inverse.sum(axis=0)
        worth, shape = _heaviest(sizes, prices, room)
        if worth <= 1 + 1e-9 or np.ceil(prices @ wanted / worth - 1e-6) >= np.ceil(used.sum() - 1e-6):
            break
        way = inverse @ shape
        up = way > 1e-10
        ratio = np.full(len(way), np.inf)
        ratio[up] = np.maximum(used[up], 0) / way[up]
        out = int(ratio.argmin())
        shapes[:, out] = shape
        if turn % 64:
            inverse[out] /= way[out]
            inverse -= np.outer(np.where(np.arange(len(way)) == out, 0, way), inverse[out])
        else:
            inverse = np.linalg.inv(shapes)  # rounding errors don't pile up
        used = inverse @ wanted
    return [(shapes[:, i], float(used[i])) for i in range(len(sizes)) if used[i] > 1e-9]


def _large(counts: dict[int, int], size: int, groups: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Optimised configurations of the rounded lengths with actual lengths put in: (lengths, how often).

    Their counts are rounded down; lengths that are left over then come second.
    """
    runs: dict[int, deque] = {}
    for top, own in _groups(counts, groups):
        runs.setdefault(top, deque()).extend(own)
    if not runs:
        return [], {}
    sizes, out = sorted(runs, reverse=True), []
    for shape, times in configurations({top: sum(n for _, n in own) for top, own in runs.items()}, size):
        need, times = {s: int(round(n)) for s, n in zip(sizes, shape, strict=True) if n > 0.5}, int(times + 1e-6)
        while times and all(sum(n for _, n in runs[s]) >= k for s, k in need.items()):
            took, once = [], min(times, *(_longest(runs[s], n) for s, n in need.items()))
            for s, n in need.items():
                for _ in range(n):
                    took.append(runs[s][0][0])
                    runs[s][0][1] -= once
                    if not runs[s][0][1]:
                        runs[s].popleft()
            out.append((tuple(took), once))
            times -= once
    left: Counter = Counter()
    for own in runs.values():
        for length, n in own:
            left[length] += n
    return out, left


def _longest(runs: deque, n: int) -> int:
    """How often the first n places can be served from the front without a run ending midway."""
    if runs[0][1] >= n:
        return runs[0][1] // n
    return 1


def plan(counts: dict[int, int], size: int, small: int, groups: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for all lengths of a histogram, as (lengths in a sequence, how many such).

    Lengths above ``small`` are configured in ``groups`` groups; what their rounded counts leave over
    and the small ones go where they fit best, longest first.
    """
    done = [((size,), counts[size])] if counts.get(size) else []
    shelves: list[tuple[int, tuple[int, ...], int]] = []  # room, lengths, how many
    made, left = _large({x: n for x, n in counts.items() if small < x < size and n}, size, groups)
    for lengths, n in made:
        insort(shelves, (size - sum(lengths), lengths, n))
    left = left | {x: n for x, n in counts.items() if x <= min(small, size - 1) and n}
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_right(shelves, (x,))
            if at == len(shelves):
                fit = size // x
                if n >= fit:
                    insort(shelves, (size - fit * x, (x,) * fit, n // fit))
                    n %= fit
                else:
                    insort(shelves, (size - n * x, (x,) * n, 1))
                    n = 0
                continue
            room, lengths, many = shelves.pop(at)
            each = min(room // x, n)
            used = min(many, n // each)
            insort(shelves, (room - each * x, lengths + (x,) * each, used))
            if many > used:
                insort(shelves, (room, lengths, many - used))
            n -= each * used
    return done + [(lengths, n) for _, lengths, n in shelves]


def best_plan(counts: dict[int, int], size: int, small: int, groups: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    """The plan of fewest sequences: best fit of all lengths, or configurations in several numbers of groups.

    Configurations are not tried once a plan has as few sequences as the tokens or the lengths over half need.
    """
    pick, needed = plan(counts, size, size, 1), least_sequences(counts, size)
    for g in groups:
        if sum(n for _, n in pick) <= needed:
            break
        pick = min(pick, plan(counts, size, small, g), key=lambda p: sum(n for _, n in p))
    return pick


def least_sequences(counts: dict[int, int], size: int) -> int:
    """A bound that no packing goes below: by all tokens, and by lengths that can't share a sequence.

    For every length t up to half: those over size - t are alone among lengths of t and more, those
    over half are one to a sequence, and those from t to half fill at best what these leave.
    """
    n = np.zeros(size + 1, np.int64)
    for x, many in counts.items():
        n[x] += many
    tokens = np.cumsum(n * np.arange(size + 1))
    many = np.cumsum(n)
    best = -(-int(tokens[-1]) // size)
    half = size // 2
    for t in range(1, half + 1):
        alone, pairs = int(many[size] - many[size - t]), int(many[size - t] - many[half])
        room = pairs * size - int(tokens[size - t] - tokens[half])
        rest = int(tokens[half] - tokens[t - 1])
        best = max(best, alone + pairs + max(0, -(-(rest - room) // size)))
    return best


def _places(shapes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) of each place in the plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in shapes:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            out.append((x, first, first + n - 1, sequence, offset))
            used[x] = first + n
            offset += x
        sequence += n
    return out


def _by_range(places: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, ...]], dict[int, int]]:
    """The places under each range of ranks that they reach into, and how many ranks a range of a length has.

    Ranges are about as wide as a place of that length is on average, so that a rank meets few places.
    """
    held, ranks = Counter(p[0] for p in places), Counter()
    for x, first, last, *_ in places:
        ranks[x] += last - first + 1
    widths = {x: -(-ranks[x] // n) for x, n in held.items()}
    return [(x, at, first, last, *rest) for x, first, last, *rest in places for at in range(first // widths[x], last // widths[x] + 1)], widths


def pack(docs: DataFrame, size: int = 1024, small: int = 64, groups: tuple[int, ...] = (32, 128), vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    ``docs`` has doc_id and text; further columns are ignored. A document is its ids and END; only
    longer ones than ``size`` are cut, the first piece taking the rest. Each row is packed, so
    repeated rows are packed as often. Null or empty text: END alone. No rows: no rows. Ties are
    dealt by the order of pieces within the tasks that cut them.

    The histogram has at most ``size`` numbers, so the plan is bounded whatever the corpus: some
    tens of thousands of places.
    ``small`` lengths take no part in the configurations; ``groups`` are the numbers of groups that
    are tried beside plain best fit, the plan of fewest sequences is taken.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(size, vocabulary, ranks), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long")
    pieces = stored(pieces, "pieces")
    own = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    places, widths = _by_range(_places(best_plan(counts, size, small, groups)))
    spark = docs.sparkSession
    places = spark.createDataFrame(places, "at long, range long, first long, last long, sequence long, offset long")
    widths = spark.createDataFrame(list(widths.items()), "length long, width long")
    before = own.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")).join(F.broadcast(widths), "length")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    here = (F.col("length") == F.col("at")) & (F.floor(F.col("rank") / F.col("width")) == F.col("range")) & F.col("rank").between(F.col("first"), F.col("last"))
    placed = ranked.join(fitting(places), here)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
