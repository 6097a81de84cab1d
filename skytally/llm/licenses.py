"""License scans by diagonal voting, in DataFrame functions only.

Templates are short phrases and whole notices. All rolling word k-grams of the documents (2-grams for phrases, 4-grams for
notices) are joined by hash to the places of the same k-grams in templates, and the words are compared. A match at word p
of a document and word t of a template votes for the diagonal p - t. A phrase stands wherever one diagonal has all its
votes. For notices, diagonals at most ``gap`` apart are merged, as words that were added or left out shift the rest, and
the merged span is verified: its matched words must be at least ``share`` of the template and half of the span.

The k-grams are exploded and joined within one stage, with the document's words at hand, and only matches leave it. The
templates are a fixed list of some thousand words, so they are broadcast.

Defined results: null text has no words and no labels, and score 0. Equal rows repeated give equal results. ``labels``
has those of phrases and notices; the score is 1 where a phrase stands, else the largest matched part of a notice.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytally.llm.common import NOT_WORD, lower_ascii, split_words

#: Phrases of the contract with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of public licenses, with the labels that they add.
NOTICES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "warranty-text": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
}
PHRASE_K, NOTICE_K = 2, 4


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """Rows (template, label, is_phrase, size, at, gram) of all k-grams of the templates, and one that stands for the
    document itself."""
    rows = []
    for k, texts in ((PHRASE_K, {text: label for text, label in phrases.items()}), (NOTICE_K, {text: label for label, text in notices.items()})):
        for text, label in texts.items():
            found = template_words(text)
            if len(found) < k:
                raise ValueError(f"a template needs {k} words: {text!r}")
            rows += [(text, label, k == PHRASE_K, len(found), at, found[at : at + k]) for at in range(len(found) - k + 1)]
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = [f"({quote(t)}, {quote(lab)}, {str(p).lower()}, {n}, {at}, array({', '.join(map(quote, g))}))" for t, lab, p, n, at, g in rows]
    grams = spark.sql("SELECT * FROM VALUES " + ", ".join([*values, "(NULL, NULL, NULL, 0, 0, array(' '))"]) + " AS t(template, label, is_phrase, size, at, gram)")
    chained = lambda k: F.xxhash64(*(F.xxhash64(F.get("gram", F.lit(i))) for i in range(k)))
    return grams.withColumn("hash", F.when(F.col("template").isNull(), F.lit(0).cast("long")).when(F.col("is_phrase"), chained(PHRASE_K)).otherwise(chained(NOTICE_K)))


def votes(docs: DataFrame, templates: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows (keep, n_words, template, label, is_phrase, size, place, diagonal): matches of k-grams; and of each document
    one row without a template."""
    cut = docs.select(*keep, split_words(lower_ascii(F.col(text)), NOT_WORD).alias("words"))
    hashed = cut.select("*", F.transform("words", lambda x: F.xxhash64(x)).alias("__g"))
    grams = lambda k: F.transform("__g", lambda x, i: F.xxhash64(x, *(F.get("__g", i + j) for j in range(1, k))))
    rolled = hashed.select(*keep, "words", F.concat(grams(PHRASE_K), grams(NOTICE_K), F.array(F.lit(0).cast("long"))).alias("__h"))
    placed = rolled.select(*keep, "words", F.size("words").alias("n_words"), F.posexplode_outer("__h").alias("__pos", "__hash"))
    joined = placed.join(F.broadcast(templates), placed["__hash"] == templates["hash"])
    n = F.col("n_words")
    place = F.when(F.col("is_phrase"), F.col("__pos")).otherwise(F.col("__pos") - n)
    same = reduce(lambda a, b: a & b, [F.get("words", place + j).eqNullSafe(F.get("gram", F.lit(j))) for j in range(PHRASE_K)])
    more = reduce(lambda a, b: a & b, [F.get("words", place + j).eqNullSafe(F.get("gram", F.lit(j))) for j in range(PHRASE_K, NOTICE_K)])
    itself = F.col("template").isNull() & (F.col("__pos") == 2 * n)
    match = F.col("template").isNotNull() & (place >= 0) & (place < n) & same & (F.col("is_phrase") | more)
    return joined.where(itself | match).select(*keep, n.cast("long").alias("n_words"), "template", "label", "is_phrase", "size", place.alias("place"), (place - F.col("at")).alias("diagonal"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, gap: int = 3, share: float = 0.6) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    keep = ["__key", "__id"]
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__id"), F.col(text))
    found = votes(rows, template_grams(docs.sparkSession, phrases, notices), text, keep)
    # A diagonal's places are those of a template's words, so the sets are bounded by the template.
    lines = found.groupBy(*keep, "template", "label", "is_phrase", "size", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("__rows"), F.collect_set("place").alias("places")
    )
    heads = F.col("template").isNull()
    by = W.partitionBy(*keep, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > gap, F.lit(True)).cast("int")
    spanned = lines.withColumn("__new", apart).withColumn("__span", F.sum("__new").over(by)).withColumn("__span", F.when(F.col("is_phrase") | heads, F.col("diagonal")).otherwise(F.col("__span")))
    whole = spanned.groupBy(*keep, "template", "label", "is_phrase", "size", "__span").agg(
        F.max("n_words").alias("n_words"),
        F.max("__rows").alias("__rows"),
        F.min("diagonal").alias("diagonal"),
        F.flatten(F.collect_list("places")).alias("places"),
    )
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (NOTICE_K - 1)))))
    whole = whole.withColumn("covered", F.when(~F.col("is_phrase"), covered))
    stands = F.col("is_phrase") & (F.size("places") == F.col("size") - (PHRASE_K - 1))
    span = F.array_max("covered") - F.array_min("covered") + 1
    proven = ~F.col("is_phrase") & (F.size("covered") >= F.col("size") * share) & (F.size("covered") * 2 >= span)
    part = F.when(stands, 1.0).when(proven, F.least(F.lit(1.0), F.size("covered") / F.col("size")))
    summed = whole.groupBy(*keep).agg(
        F.max(F.when(heads, F.col("n_words"))).alias("n_words"),
        F.max(F.when(heads, F.col("__rows"))).cast("int").alias("__rows"),
        F.count(F.when(stands, 1)).alias("n_base"),
        F.min(F.when(stands, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(stands, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(stands, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(stands | proven, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(part), F.lit(0.0)).alias("score"),
    )
    return summed.select(
        F.col("__key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), "__rows")).alias("__row")
    ).drop("__row")
