"""Two feeds of the same stations, minute by minute and day by day.

Both sides are joined once on (station, minute); counts, extremes and differences all come from that one
full outer join, so each feed is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from skytally.functions.timeparse import local_time
from skytally.operators.scale import latest_by, top_rows


def last_per_minute(feed: DataFrame, values=("temp_f", "tz", "valid_utc")) -> DataFrame:
    """One point per station and minute, the last one in file order."""
    return latest_by(feed, ["station", "epoch"], [F.col("seq")], list(values))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two deduplicated feeds with a_/b_ values and the local day."""
    left = last_per_minute(a).select("station", "epoch", F.col("temp_f").alias("a_f"), F.col("tz").alias("a_tz"))
    right = last_per_minute(b).select("station", "epoch", F.col("temp_f").alias("b_f"), F.col("tz").alias("b_tz"))
    both = left.join(right, ["station", "epoch"], "full")
    tz = F.coalesce("a_tz", "b_tz")
    return both.select(
        "station", "epoch", "a_f", "b_f",
        F.to_date(local_time(F.timestamp_seconds("epoch"), tz)).alias("local_date"),
    )


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    left = last_per_minute(a).select("station", "epoch", F.col("temp_f").alias("a_f"))
    right = last_per_minute(b).select("station", "epoch", F.col("temp_f").alias("b_f"))
    return left.join(right, ["station", "epoch"])


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = b.select("station", "epoch")
    return last_per_minute(a).join(keys, ["station", "epoch"], "left_anti")


def minute_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every (station, minute) of either feed with its membership: both, a or b. One aggregation gives the
    intersection, both differences and the union."""
    tag = lambda df, n: df.select("station", "epoch", F.lit(n).alias("side"))
    sides = tag(a, 1).unionByName(tag(b, 2)).groupBy("station", "epoch").agg(F.bit_or("side").alias("sides"))
    return sides.withColumn("membership", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("both")), F.col("sides"))).drop("sides")


def daily_feed(feed: DataFrame) -> DataFrame:
    points = last_per_minute(feed)
    day = F.to_date(local_time(F.col("valid_utc"), F.col("tz"))).alias("local_date")
    return points.groupBy("station", day).agg(
        F.count("*").alias("count"), F.max("temp_f").alias("high"), F.min("temp_f").alias("low")
    )


def daily_comparison(both: DataFrame) -> DataFrame:
    """Counts, highs and lows of both feeds per day, and again on common minutes only."""
    a, b = F.col("a_f"), F.col("b_f")
    common = a.isNotNull() & b.isNotNull()
    days = both.groupBy("station", "local_date").agg(
        F.count(a).alias("a_count"), F.count(b).alias("b_count"), F.count_if(common).alias("common_count"),
        F.max(a).alias("a_high"), F.max(b).alias("b_high"), F.min(a).alias("a_low"), F.min(b).alias("b_low"),
        F.max(F.when(common, a)).alias("common_a_high"), F.max(F.when(common, b)).alias("common_b_high"),
        F.min(F.when(common, a)).alias("common_a_low"), F.min(F.when(common, b)).alias("common_b_low"),
    )
    return days.select(
        "*",
        (F.col("b_high") - F.col("a_high")).alias("high_diff"),
        (F.col("b_low") - F.col("a_low")).alias("low_diff"),
        (F.col("common_b_high") - F.col("common_a_high")).alias("common_high_diff"),
        (F.col("common_b_low") - F.col("common_a_low")).alias("common_low_diff"),
    )


def point_summary(both: DataFrame, samples: int = 5) -> DataFrame:
    """Per station and day: counts, exact-match flag, extremes, differences and the first few mismatches.

    Samples are picked by rank before they are collected, so a list never exceeds ``samples``.
    """
    a, b = F.col("a_f"), F.col("b_f")
    common = a.isNotNull() & b.isNotNull()
    keys = ["station", "local_date"]
    day = both.groupBy(*keys).agg(
        F.count(a).alias("a_count"), F.count(b).alias("b_count"), F.count_if(common).alias("common_count"),
        F.count_if(common & (a != b)).alias("mismatch_count"),
        F.count_if(a.isNotNull() & b.isNull()).alias("only_a_count"),
        F.count_if(b.isNotNull() & a.isNull()).alias("only_b_count"),
        F.min(a).alias("a_min"), F.max(a).alias("a_max"), F.min(b).alias("b_min"), F.max(b).alias("b_max"),
    )
    first = top_rows(both.filter(common & (a != b)), keys, [F.col("epoch")], samples)
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("epoch", "a_f", "b_f"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["epoch"], x["a_f"], x["b_f"])), ",")
    out = day.join(lists.select(*keys, text.alias("sample_mismatches")), keys, "left")
    return out.select(
        "*",
        (F.col("mismatch_count") + F.col("only_a_count") + F.col("only_b_count") == 0).alias("exact_match"),
        (F.col("b_min") - F.col("a_min")).alias("low_diff"),
        (F.col("b_max") - F.col("a_max")).alias("high_diff"),
    )


def rollup_days(days: DataFrame) -> DataFrame:
    """Per-station totals and the grand total (station null) of daily comparison rows."""
    off = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != 0))
    return days.rollup("station").agg(
        F.count("*").alias("daily_rows"),
        F.sum("a_count").alias("a_points"), F.sum("b_count").alias("b_points"), F.sum("common_count").alias("common_points"),
        off("high_diff").alias("high_mismatches"), off("low_diff").alias("low_mismatches"),
        off("common_high_diff").alias("common_high_mismatches"), off("common_low_diff").alias("common_low_mismatches"),
        F.max(F.abs("high_diff")).alias("max_abs_high_diff"), F.max(F.abs("low_diff")).alias("max_abs_low_diff"),
    )


def station_ratios(both: DataFrame) -> DataFrame:
    a, b = F.col("a_f"), F.col("b_f")
    common = a.isNotNull() & b.isNotNull()
    out = both.groupBy("station").agg(
        F.count_if(common).alias("matched"), F.count_if(common & (a != b)).alias("mismatched"),
        F.count_if(b.isNull()).alias("only_a"), F.count_if(a.isNull()).alias("only_b"), F.count("*").alias("points"),
    )
    return out.select(
        "*",
        F.try_divide("mismatched", "matched").alias("mismatch_ratio"),
        F.try_divide(F.col("only_a") + F.col("only_b"), F.col("points")).alias("one_sided_ratio"),
    )
