"""Encoding whole texts with a public byte-level BPE vocabulary, and exact length histograms."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duosignal.llm.shared import stored, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


class _Chunks(dict):
    """Encoded chunks of text as little-endian 32-bit ids; each chunk is encoded once."""

    def __init__(self, encode, before: str) -> None:
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = np.array(self.encode(self.before + chunk), "<u4").tobytes()
        return ids


class Encoder:
    """What ``tokenizers`` gives for a text, a chunk at a time.

    The vocabulary's split pattern always starts a new word at a space that follows other than
    white space. So a text's ids are those of its chunks between such spaces, and chunks repeat.
    Chunks are encoded from the same vocabulary in its form of ranks. A text that holds a special
    token's string goes through ``tokenizers`` whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS, held: int = 400_000) -> None:
        self.whole, self.held = Tokenizer.from_file(vocabulary), held
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.first, self.later = _Chunks(encode, ""), _Chunks(encode, " ")

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _CUT.split(text) if _SPACED.search(text) else text.split(" ")
        ids = self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        for known in (self.first, self.later):
            if len(known) > self.held:
                known.clear()
        return ids


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
    """One for each worker process."""
    return Encoder(vocabulary, ranks)


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(n_tokens) of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t or "")) // 4 for t in batch.column("text").to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def length_totals(lengths: DataFrame, width: int = 1024) -> DataFrame:
    """What a histogram of n_tokens answers, one row for each length that occurs.

    For the context limit n_tokens: n_docs of just that length; docs_longer and tokens_longer, of
    documents beyond it; tokens_truncated, all tokens if each document is cut to it; share_within,
    the part of the documents that fit (so a quantile q is the first n_tokens with share_within >=
    q). Between two lengths a limit's truncated total is linear. total_docs and total_tokens cover
    all rows. Suffix sums run within ranges of ``width`` lengths, then over the ranges' totals.
    Null lengths are left out. No rows: no rows.
    """
    rows = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    rows = rows.withColumns({"part": F.floor(F.col("n_tokens") / width), "tokens": F.col("n_tokens") * F.col("n_docs")})
    rows = stored(rows, "lengths")
    down = Window.orderBy(F.desc("part"))
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all"))
    after = parts.select("part", (F.sum("docs").over(down) - F.col("docs")).alias("docs_after"), (F.sum("all").over(down) - F.col("all")).alias("tokens_after"), F.sum("docs").over(Window.partitionBy()).alias("total_docs"), F.sum("all").over(Window.partitionBy()).alias("total_tokens"))
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens"))
    rows = rows.withColumns({"docs_here": F.sum("n_docs").over(inside) - F.col("n_docs"), "tokens_here": F.sum("tokens").over(inside) - F.col("tokens")}).join(after, "part")
    longer, tokens = F.col("docs_here") + F.col("docs_after"), F.col("tokens_here") + F.col("tokens_after")
    return rows.select("n_tokens", "n_docs", longer.alias("docs_longer"), tokens.alias("tokens_longer"), (F.col("total_tokens") - tokens + longer * F.col("n_tokens")).alias("tokens_truncated"), (1 - longer / F.col("total_docs")).alias("share_within"), "total_docs", "total_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_totals(encoded_lengths(table(spark, sf_dir, "documents")))
