"""Spelling variant grouping by Bloom-guided neighbourhoods.

Words of a vocabulary are near if one edit apart. Every word's edits are made as hashes (an edit
changes a polynomial hash by one term) and probed against broadcast Bloom filters of the
vocabulary, one for each word length. Only what a filter lets through is shuffled, to an exact join
with the vocabulary that drops false positives and compares the strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.llm.shared import discard, small_batches, stored, table, utf8

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Of the polynomial hash and of the mixing of its bits; any odd numbers do.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words of at least this length share a filter.
LONG = 64
LANES = 4


def runs_of(text: str, piece: int = 1 << 20) -> Iterator[str]:
    """All runs of letters of a text, held a piece at a time; pieces end where no run does."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, min(at + piece, len(text)))
        end = gap.start() if gap else len(text)
        yield from RUN.findall(text, at, end)
        at = end + 1


def _counted(typos: int | None, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])
            words.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                for word, n in Counter(runs_of(text.decode("utf-8", "replace"))).items():
                    low = word.lower() if word.isascii() else word.translate(LOWER)
                    if typos:
                        h = zlib.crc32(f"{doc or ''}:{low}".encode())
                        if h % typos == 0:
                            at = h % len(low)
                            low = low[:at] + low[at + 1 :]
                    words[low] += n
                if len(words) > held:
                    yield out()
        if words:
            yield out()

    return run


def vocabulary(docs: DataFrame, length: int = 5, least: int = 3, typos: int | None = None, held: int = 200_000) -> DataFrame:
    """(word, n): runs of letters of whole texts with A-Z in lower case, by how often they stand.

    Words shorter than ``length`` code points or rarer than ``least`` are left out. With ``typos``, a
    run whose crc32 of ``<doc_id>:<run>`` is divisible by it loses the code point at that number
    modulo its length; a null doc_id reads as empty. Null text: no words. Each row counts, repeated
    ones too; no rows: no rows. Tasks add up ``held`` words at a time before they are shuffled.
    Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted(typos, held), "word string, n long")
    return rows.where(F.char_length("word") >= length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(word: bytes) -> np.ndarray:
    return np.frombuffer(word, np.uint8).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])[: n + 1]


def _hashed(words: np.ndarray) -> np.ndarray:
    """The polynomial hash of each row of letters."""
    return (words * _powers(words.shape[1])[words.shape[1] - 1 :: -1]).sum(1, dtype=np.uint64) if words.shape[1] else np.zeros(len(words), np.uint64)


def _by_length(words: list[bytes], cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters) of words of one length at a time, of at most ``cells`` letters if not one word."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        step = max(1, cells // max(1, int(n)))
        for i in range(0, len(places), step):
            own = places[i : i + step]
            yield own, _letters(b"".join(words[k] for k in own)).reshape(len(own), int(n))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        keys = np.zeros(len(words), np.uint64)
        for places, letters in _by_length(words):
            keys[places] = _hashed(letters)
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([len(w) for w in words], pa.int32()), pa.array(keys.view(np.int64))], names=["word", "n", "size", "key"])


def _spread(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(32))) * MIX
    keys = (keys ^ (keys >> np.uint64(29))) * MIX
    return keys ^ (keys >> np.uint64(32))


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of each key: 12 of the bits for each lane of its block say which two are set."""
    mixed = _spread(keys)
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), _spread(mixed + BASE)


def _mask(bits: np.ndarray, lane: int) -> np.ndarray:
    low = (bits >> np.uint64(12 * lane)) & np.uint64(63)
    high = (bits >> np.uint64(12 * lane + 6)) & np.uint64(63)
    return (np.uint64(1) << low) | (np.uint64(1) << high)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a length that a key belongs to, if a length has more words than a filter may hold."""
    return (keys * MIX >> np.uint64(40)) % np.uint64(parts)


def _found(keys: np.ndarray, filters: dict, shard: int) -> np.ndarray:
    """Which keys the filter of a length lets through, as places in ``keys``."""
    if shard not in filters or not len(keys):
        return np.zeros(0, np.int64)
    lanes, part, parts = filters[shard]
    at = np.arange(len(keys)) if parts == 1 else np.flatnonzero(_part(keys, parts) == part)
    block, bits = _places(keys[at], lanes.shape[1])
    block = block.astype(np.int64)
    for lane in range(LANES):
        mask = _mask(bits, lane)
        keep = np.flatnonzero((lanes[lane][block] & mask) == mask)
        at, block, bits = at[keep], block[keep], bits[keep]
    return at


def _edits(letters: np.ndarray, alphabet: np.ndarray, filters: dict, cells: int = 1 << 19) -> Iterator[tuple]:
    """(row, key of the edit, its length, place, letter) of edits that the filters let through.

    A pair of words is met once: letters are replaced by later ones only and otherwise left out, of
    equal neighbours the first. A left-out letter has -1 as its new letter.
    """
    rows, n = letters.shape
    powers, whole = _powers(n), _hashed(letters)
    shard, less = min(n, LONG), min(n - 1, LONG)
    wide = max(1, cells // (rows * len(alphabet)))
    before = np.zeros(rows, np.uint64)
    for start in range(0, n, wide):
        own = letters[:, start : start + wide]
        power = powers[n - 1 - np.arange(start, start + own.shape[1])]
        if shard in filters:
            row, place, letter = np.nonzero(alphabet[None, None, :] > own[:, :, None])
            key = whole[row] + (alphabet[letter] - own[row, place]) * power[place]
            hit = _found(key, filters, shard)
            if len(hit):
                yield row[hit], key[hit], n, place[hit] + start, alphabet[letter[hit]].astype(np.int64)
        if less in filters:
            ahead = np.empty((rows, own.shape[1] + 1), np.uint64)  # hashes of what stands before each place
            ahead[:, 0] = before
            for i in range(own.shape[1]):
                ahead[:, i + 1] = ahead[:, i] * BASE + own[:, i]
            left = whole[:, None] + (ahead[:, :-1] - ahead[:, 1:]) * power[None, :]
            last = letters[:, start - 1 : start] if start else np.full((rows, 1), 1 << 20, np.uint64)
            row, place = np.nonzero(own != np.concatenate([last, own[:, :-1]], 1))
            key = left[row, place]
            hit = _found(key, filters, less)
            if len(hit):
                yield row[hit], key[hit], n - 1, place[hit] + start, np.full(len(hit), -1)
            before = ahead[:, -1]


def _probed(filters, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filters.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            keys = batch.column("key").to_numpy()
            for places, letters in _by_length(words, 1 << 14):
                for row, key, size, place, letter in _edits(letters, alphabet, own):
                    many = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[places[row]]), pa.array(np.full(many, letters.shape[1], np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(many, size, np.int32)), pa.array(place.astype(np.int32)), pa.array(letter.astype(np.int32))],
                        names=["from_key", "from_size", "key", "size", "place", "letter"],
                    )

    return run


def filter_rounds(counts: dict[int, int], bits: int, budget: int) -> list[list[tuple[int, int, int, int]]]:
    """Which filters are broadcast together: (length, part, parts, blocks), at most ``budget`` bytes a round.

    A length with more words than one filter may hold is divided into parts by hash.
    """
    most = max(1, budget // (8 * LANES))
    rounds, room = [], 0
    for shard, n in sorted(counts.items()):
        need = -(-n * bits // (64 * LANES))
        parts = -(-need // most)
        for part in range(parts):
            blocks = -(-need // parts)
            if blocks > room:
                rounds.append([])
                room = most
            rounds[-1].append((shard, part, parts, blocks))
            room -= blocks
    return rounds


def _marks(chosen: dict[int, tuple[int, int, int]]):
    """(shard, block, lanes) of the words whose filters are built."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shards = batch.column("key").to_numpy().view(np.uint64), np.minimum(batch.column("size").to_numpy(), LONG)
            for shard, (part, parts, blocks) in chosen.items():
                own = keys[shards == shard]
                own = own[_part(own, parts) == part]
                if len(own):
                    block, bits = _places(own, blocks)
                    lanes = [pa.array(_mask(bits, lane).view(np.int64)) for lane in range(LANES)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(block.astype(np.int64)), *lanes], names=["shard", "block", *[f"l{i}" for i in range(LANES)]])

    return run


def _filters(words: DataFrame, own: list[tuple[int, int, int, int]]) -> dict[int, tuple[np.ndarray, int, int]]:
    """The filters of one round; what is collected is bounded by the round's bytes."""
    chosen = {shard: (part, parts, blocks) for shard, part, parts, blocks in own}
    lanes = [f"l{i}" for i in range(LANES)]
    rows = words.select("key", "size").mapInArrow(_marks(chosen), "shard int, block long, " + ", ".join(f"{x} long" for x in lanes))
    got = rows.groupBy("shard", "block").agg(*[F.bit_or(x).alias(x) for x in lanes]).toArrow()
    shards, block = got.column("shard").to_numpy(), got.column("block").to_numpy()
    out = {}
    for shard, (part, parts, blocks) in chosen.items():
        bits, here = np.zeros((LANES, blocks), np.uint64), shards == shard
        for i, lane in enumerate(lanes):
            bits[i, block[here]] = got.column(lane).to_numpy()[here].view(np.uint64)
        out[shard] = (bits, part, parts)
    return out


def near_pairs(words: DataFrame, bits: int = 16, budget: int = 1 << 25, work: int = 1 << 24) -> DataFrame:
    """(a, b, n_a, n_b), each pair of words one inserted, deleted or replaced code point apart, once.

    ``words`` is a stored table (word, n, size, key) of different words of code points up to 255.
    Filters have ``bits`` bits a word and at most ``budget`` bytes are broadcast at once; a larger
    vocabulary takes more rounds. A task makes about ``work`` edits. What passes a filter is a row
    of six numbers; the vocabulary is joined on its hash and length, then on that of the word it
    came from, and the strings are compared, so neither filters nor hashes decide anything.
    """
    spark = words.sparkSession
    shard = F.least(F.col("size"), F.lit(LONG))
    counts = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}  # at most LONG rows
    alphabet = np.array(sorted(ord(r.c) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()), np.uint64)  # at most 256
    found = None
    for own in filter_rounds(counts, bits, budget):
        shards = sorted({s for s, *_ in own})
        here = words.where(shard.isin(shards) | F.least(F.col("size") - 1, F.lit(LONG)).isin(shards)).select("word", "key")
        tasks = sum(n * min(s, LONG) * (len(alphabet) // 2 + 1) for s, n in counts.items()) // work + 1
        got = here.repartition(int(min(tasks, 100_000))).mapInArrow(_probed(spark.sparkContext.broadcast(_filters(words, own)), alphabet), "from_key long, from_size int, key long, size int, place int, letter int")
        found = got if found is None else found.union(got)
    if found is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b")).where("false")
    at, edited = F.col("place"), F.when(F.col("letter") >= 0, F.chr("letter")).otherwise("")
    target = words.select("key", "size", F.col("word").alias("b"), F.col("n").alias("n_b"))
    origin = words.select(F.col("key").alias("from_key"), F.col("size").alias("from_size"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    same = F.concat(F.substring("a", F.lit(1), at), edited, F.substring("a", at + 2, F.char_length("a"))) == F.col("b")
    return found.join(target, ["key", "size"]).join(origin, ["from_key", "from_size"]).where(same).select("a", "b", "n_a", "n_b")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, to), followed to the end; the ways are halved in each round."""
    now = stored(links, "links")
    while True:
        onward = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        before, now = now, stored(now.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "links")
        moved = now.where("moved").limit(1).count()
        discard(before)
        if not moved:
            return now.select("word", F.col("to").alias("root"))
        now = now.select("word", "to")


def variants(words: DataFrame, times: int = 2, **filters) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at
    least ``times`` the word's own n, else null; root follows forms to the last, and is the word
    itself without one. n_near counts near words. Words are different, of code points up to 255. No
    rows: no rows.
    """
    words = stored(words.select("word", "n").mapInArrow(_keyed, "word string, n long, size int, key long"), "words")
    pairs = stored(near_pairs(words, **filters), "pairs")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    chosen = F.col("best.m") <= -times * F.col("n")
    formed = words.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n"))
    formed = stored(formed, "forms")
    discard(pairs)
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("to")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), typos=97))
