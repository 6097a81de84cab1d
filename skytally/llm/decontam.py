"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``width`` consecutive words (one window if it has fewer). A window is contained
in a document when all its words stand there in a row, so whichever of its words is the rarest must be there as well: in
the order of rarity over all documents, that word is the window's necessary prefix. Document words are joined to windows
by the prefix only; the place of the prefix in the window and the document's length bound the places that can match, and
the words themselves decide. Documents are exploded within one stage with their words at hand, so only windows that
match leave it.

Windows are taken in blocks of at most ``block`` rows (by hash of the item), each small enough to be broadcast; more
items mean more passes, never a larger broadcast.

Defined results: null text has no words and is not contaminated; a null item, or one without words, matches nothing.
Items of equal text all count. Equal rows repeated give equal results. Item_ids are compared as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import NOT_WORD, lower_ascii, split_words, stage

WIDTH, BLOCK = 10, 200_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), NOT_WORD)


def windows(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (item, window): every run of ``width`` words of an item, or all its words if it has fewer."""
    cut = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("__words")).where(F.col("item").isNotNull())
    size = F.size("__words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - (width - 1)))
    placed = cut.where(size > 0).select("item", "__words", F.explode_outer(starts).alias("__start"))
    return placed.select("item", F.slice("__words", F.col("__start"), width).alias("window")).distinct()


def with_prefix(cut: DataFrame, docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Adds each window's rarest word as ``prefix`` and that word's place as ``at``.

    Rarity is the number of occurrences in all documents as written; any order would give the same result.
    """
    kinds = stage(cut.select(F.explode("window").alias("word")).distinct(), "item-words")
    seen = docs.select(F.explode_outer(split_words(F.col(text), NOT_WORD)).alias("word"))
    if kinds.count() <= block:
        seen = seen.join(F.broadcast(kinds), "word", "left_semi")
    known = kinds.join(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    placed = cut.select("item", "window", F.posexplode("window").alias("at", "word")).join(known, "word")
    return placed.groupBy("item", "window").agg(F.min(F.struct("n", "word", "at")).alias("__p")).select("item", "window", F.col("__p.word").alias("prefix"), F.col("__p.at").alias("at"))


def matches(docs: DataFrame, table: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (the columns of ``docs`` but ``words``, item, start, size): places of windows; of each document one row
    without an item. ``docs`` has its words in ``words``; ``table`` is small enough to be broadcast."""
    # After the last word stands one that no text has. It meets the window that stands for the document itself.
    own = table.sparkSession.range(1).select(F.lit(None).cast("string").alias("item"), F.array(F.lit(" ")).alias("window"), F.lit(" ").alias("prefix"), F.lit(0).alias("at"))
    table = F.broadcast(table.unionByName(own))
    keep = [c for c in docs.columns if c != "words"]
    placed = docs.select(*keep, F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer(F.concat("words", F.array(F.lit(" ")))).alias("__pos", "__word"))
    joined = placed.join(table, placed["__word"] == table["prefix"])
    start, size = F.col("__pos") - F.col("at"), F.size("window")
    inside = (start >= 0) & (start + size <= F.col("n_words"))
    same = reduce(lambda a, b: a & b, [(size <= k) | (F.get("words", start + k) == F.get("window", F.lit(k))) for k in range(width)])
    found = joined.where(F.col("item").isNull() | (inside & same))
    return found.select(*keep, "n_words", "item", start.cast("long").alias("start"), size.cast("long").alias("size"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Per row: key, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated."""
    table = stage(with_prefix(windows(items, text=text, width=width), docs, text, block), "windows")
    blocks = max(1, -(-table.count() // block))
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__id"), words_of(F.col(text)).alias("words"))
    parts = [table.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k) if blocks > 1 else table for k in range(blocks)]
    found = reduce(DataFrame.unionByName, (matches(rows, part, width) for part in parts))
    summed = found.groupBy("__key", "__id").agg(
        F.max("n_words").alias("n_words"),
        (F.count(F.when(F.col("item").isNull(), 1)) / blocks).cast("int").alias("__rows"),
        F.collect_set("item").alias("__items"),
        F.collect_set(F.when(F.col("item").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("__hits"),
    )
    # In order of start, each occurrence adds the words behind the end of those before.
    cover = F.aggregate(
        F.sort_array("__hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")),
        lambda acc: acc["n"],
    )
    return summed.select(
        F.col("__key").alias(key),
        "n_words",
        cover.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("__items"), ","), 256).alias("items_sha256"),
        (F.size("__hits") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("__rows"))).alias("__row"),
    ).drop("__row")
