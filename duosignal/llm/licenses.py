"""License scans by diagonal voting of word k-grams.

All rolling k-gram hashes of all texts are joined with the k-grams of license templates, a fixed
small table. A hit votes for its diagonal, the offset between text and template. Neighbouring
diagonals are merged along the text and the span is kept if enough of the template is found in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duosignal.llm.shared import stored, table

# Phrases that label a text wherever they stand.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The wording of common licenses and notices, in lower case without punctuation.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "gpl-2": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """ASCII letters (lower-cased), digits and all characters beyond ASCII make words."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def grams(k: int) -> Column:
    """Hashes of all k-grams of the column ``words``, in order."""
    last = F.size("words") - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)])))


def template_grams(spark: SparkSession, k: int) -> DataFrame:
    """(label, template, size, gram, place): a table of fixed size."""
    rows = [(label, f"{label} {i}", text) for label, texts in sorted(TEMPLATES.items()) for i, text in enumerate(texts)]
    own = spark.createDataFrame(rows, "label string, template string, text string").withColumn("words", words(F.col("text")))
    return own.select("label", "template", (F.size("words") - k + 1).alias("size"), F.posexplode(grams(k)).alias("place", "gram"))


def _phrase_places() -> Column:
    """Structs (at, label) of every place where a phrase's words stand."""

    def found(i: Column) -> Column:
        says = [reduce(lambda a, b: a & b, [F.coalesce(F.get("words", i + j) == w, F.lit(False)) for j, w in enumerate(phrase.split())]) for phrase in PHRASES]
        return reduce(lambda a, x: a.when(x[0], F.lit(x[1])), zip(says[1:], list(PHRASES.values())[1:], strict=True), F.when(says[0], F.lit(next(iter(PHRASES.values())))))

    rare = reduce(lambda a, b: a | b, [F.array_contains("words", p.split()[x]) for p, x in zip(PHRASES, (2, 0, 0), strict=True)])
    every = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.struct(i.alias("at"), found(i).alias("label")))
    return F.when(rare, F.filter(every, lambda x: x["label"].isNotNull()))


def license_spans(docs: DataFrame, k: int = 3, slack: int = 3, reach: int = 40, share: float = 0.6) -> DataFrame:
    """(h, g, label, template, first_word, last_word, coverage) of each verified span.

    h and g stand for the text. Hits of one template are merged while the diagonal moves by at most
    ``slack`` words and the text by at most ``reach``; a span is verified if ``share`` of the
    template's k-grams are in it. coverage is that share.
    """
    texts = docs.select("text").withColumns({"h": F.xxhash64("text"), "g": F.hash("text"), "words": words(F.col("text"))})
    rolled = texts.select("h", "g", F.posexplode(grams(k)).alias("at", "gram"))
    hits = rolled.join(F.broadcast(template_grams(docs.sparkSession, k)), "gram").select("h", "g", "label", "template", "size", "at", "place").distinct()
    hits = stored(hits.withColumn("diagonal", F.col("at") - F.col("place")), "hits")
    along = Window.partitionBy("h", "g", "template").orderBy("at", "diagonal")
    step = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > slack) | (F.col("at") - F.lag("at").over(along) > reach)
    spans = hits.withColumn("new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(along))
    spans = spans.groupBy("h", "g", "label", "template", "size", "span").agg(F.min("at").alias("first_word"), (F.max("at") + k - 1).alias("last_word"), F.count_distinct("place").alias("found"))
    return spans.where(F.col("found") >= F.col("size") * share).select("h", "g", "label", "template", "first_word", "last_word", (F.col("found") / F.col("size")).alias("coverage"))


def license_labels(docs: DataFrame) -> DataFrame:
    """Base phrases and labels by voting for each row of ``docs`` (doc_id, text).

    n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of
    one, else null), base_labels, labels (with those of verified spans; both distinct, sorted,
    comma-joined) and score: 1 with a base phrase, else the best coverage, else 0. Null text: no
    words. Repeated rows: one result each. No rows: no rows. Further columns are ignored.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), words(F.col("text")).alias("words"))
    base = base.withColumn("places", _phrase_places())
    base = base.select("doc_id", "h", "g", F.size("words").cast("long").alias("n_words"), F.coalesce(F.col("places.at"), F.expr("array()").cast("array<int>")).alias("at"), F.coalesce(F.array_distinct("places.label"), F.expr("array()").cast("array<string>")).alias("base"))
    voted = license_spans(docs).groupBy("h", "g").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    both = base.join(voted, ["h", "g"], "left")
    labels = F.array_distinct(F.concat("base", F.coalesce("more", F.expr("array()").cast("array<string>"))))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), score.alias("score"))


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))
