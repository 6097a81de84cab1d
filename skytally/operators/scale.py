"""Building blocks that keep ordered work in bounded partitions.

A window over ``partitionBy(key)`` puts a whole key in one task. Here an ordered series is cut into
blocks instead (a time slice, a price band, a run of sequence numbers):

* ``running``  - unbounded running values: per-block totals, a prefix over the few totals, then a
  window inside each block.
* ``lookback`` - bounded frames: each row is also copied into the later blocks that can see it.
* ``asof``     - last known value of another table, built on ``running``.
* ``exact_percentiles`` - histogram first, then only the bins that hold a wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

BLOCK = "_blk"
CORE = "_core"


def with_block(df: DataFrame, epoch: str | Column, seconds: int) -> DataFrame:
    col = F.col(epoch) if isinstance(epoch, str) else epoch
    return df.withColumn(BLOCK, F.floor(col / F.lit(seconds)).cast("long"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Last row per key; ``max_by`` combines before the shuffle, so copies of one key stay cheap."""
    picked = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    picked = F.min_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter lets Spark cut each map task to k rows before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


_PARTIAL = {
    "sum": lambda c, o: F.sum(c),
    "count": lambda c, o: F.count(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "last": lambda c, o: F.max_by(c, F.when(c.isNotNull(), F.struct(*o))),
    "first": lambda c, o: F.min_by(c, F.when(c.isNotNull(), F.struct(*o))),
    "next": lambda c, o: F.min_by(c, F.when(c.isNotNull(), F.struct(*o))),
}
_OVER_BLOCKS = {
    "sum": F.sum,
    "count": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
    "next": lambda c: F.last(c, ignorenulls=True),  # in descending order
}
_IN_BLOCK = {**_OVER_BLOCKS, "count": F.count}
_COMBINE = {
    "sum": lambda before, here: F.coalesce(before + here, before, here),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
    "last": lambda before, here: F.coalesce(here, before),
    "first": lambda before, here: F.coalesce(before, here),
    "next": lambda after, here: F.coalesce(here, after),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple],
) -> DataFrame:
    """Running values over ``keys`` in ``(block, order)`` order, one task per (key, block).

    ``specs`` maps an output column to ``(kind, expression)``; kinds are sum, count, min, max, last,
    first and next (the last three skip nulls; next looks forward from the row). A third element ``True`` leaves the current row out. ``block`` must be
    a coarsening of the order. Keys and blocks must not be null.
    """
    order_cols = [F.col(c) for c in order]
    before_only = {out for out, spec in specs.items() if len(spec) > 2 and spec[2]}
    specs = {out: spec[:2] for out, spec in specs.items()}
    names = {out: f"_in_{i}" for i, out in enumerate(specs)}
    src = df.select("*", *[expr.alias(names[out]) for out, (_, expr) in specs.items()])
    totals = src.groupBy(*keys, *block).agg(
        *[_PARTIAL[kind](F.col(names[out]), order_cols).alias(f"_t_{out}") for out, (kind, _) in specs.items()]
    )
    # "next" runs in descending order: a frame that ends at the last row would be re-read from every row.
    way = lambda kind, names: [F.desc(c) if kind == "next" else F.asc(c) for c in names]
    over_blocks = lambda kind: Window.partitionBy(*keys).orderBy(*way(kind, block)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        *block,
        *[_OVER_BLOCKS[kind](F.col(f"_t_{out}")).over(over_blocks(kind)).alias(f"_b_{out}") for out, (kind, _) in specs.items()],
    )
    ordered = lambda kind: Window.partitionBy(*keys, *block).orderBy(*way(kind, order))
    here = {
        out: ordered(kind).rowsBetween(Window.unboundedPreceding, -1 if out in before_only else 0)
        for out, (kind, _) in specs.items()
    }
    local = src.select(
        *df.columns,
        *[_IN_BLOCK[kind](F.col(names[out])).over(here[out]).alias(f"_l_{out}") for out, (kind, _) in specs.items()],
    )
    joined = local.join(before, [*keys, *block], "left")
    return joined.select(
        *df.columns,
        *[
            _COMBINE[kind](F.col(f"_b_{out}"), F.col(f"_l_{out}")).alias(out)
            for out, (kind, _) in specs.items()
        ],
    )


def lookback(df: DataFrame, epoch: str, reach: int, width: int) -> DataFrame:
    """Copy each row into every ``width``-long block whose rows can look back at it over ``reach``.

    Window over ``partitionBy(keys, BLOCK)`` with a RANGE frame no longer than ``reach``, then keep
    ``CORE`` rows: the result equals the window over the whole key. Copies are about reach/width rows.
    """
    e = F.col(epoch)
    own = F.floor(e / F.lit(width)).cast("long")
    last = F.floor((e + F.lit(reach)) / F.lit(width)).cast("long")
    spread = df.withColumn("_own", own).withColumn(BLOCK, F.explode(F.sequence(F.col("_own"), last)))
    return spread.withColumn(CORE, F.col(BLOCK) == F.col("_own")).drop("_own")


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: str,
    right_order: str,
    values: Sequence[str],
    width: float,
    first_too: bool = False,
) -> DataFrame:
    """Attach to each left row the right row with the greatest order not after it.

    Both sides share ``keys``; at equal order the right row comes first. With ``first_too`` a left row
    before every right row gets the earliest one.
    """
    payload = F.struct(*[F.col(v) for v in values])
    lcols = [c for c in left.columns]
    l = left.select(*keys, F.col(left_order).alias("_o"), F.lit(1).alias("_side"),
                    F.struct(*lcols).alias("_left"))
    r = right.select(*keys, F.col(right_order).alias("_o"), F.lit(0).alias("_side"), payload.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    both = both.withColumn(BLOCK, F.floor(F.col("_o") / F.lit(width)).cast("long"))
    out = running(both, keys, [BLOCK], ["_o", "_side"], {"_hit": ("last", F.col("_right"))})
    rows = out.filter("_side = 1")
    hit = F.col("_hit")
    if first_too:
        firsts = right.groupBy(*keys).agg(F.min_by(payload, F.col(right_order)).alias("_first"))
        rows = rows.join(firsts, list(keys), "left")
        hit = F.coalesce(hit, F.col("_first"))
    return rows.withColumn("_hit", hit).select("_left.*", *[F.col(f"_hit.{v}").alias(f"asof_{v}") for v in values])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null is one value among others."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, same, how).drop(*names.values())


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], width: float
) -> DataFrame:
    """Linear-interpolated percentiles per key without holding a group in one buffer.

    Pass 1 counts rows per (key, bin of ``width``). The bins that contain a wanted rank are known from
    those counts; pass 2 orders distinct values inside these bins only.
    """
    v = F.col(value)
    binned = df.filter(v.isNotNull()).select(*keys, v.alias("_v"), F.floor(v / F.lit(width)).cast("long").alias("_bin"))
    bins = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select(*keys, "_bin", "_c", F.sum("_c").over(upto).alias("_cum"), F.sum("_c").over(by_key).alias("_n"))
    wanted = []
    for p in probs.values():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        wanted += [F.floor(rank).cast("long"), F.ceil(rank).cast("long")]
    inside = F.filter(
        F.array_distinct(F.array(*wanted)),
        lambda r: (r >= F.col("_cum") - F.col("_c")) & (r < F.col("_cum")),
    )
    targets = bins.select(*keys, "_bin", "_n", (F.col("_cum") - F.col("_c")).alias("_before"), inside.alias("_ranks"))
    targets = targets.filter(F.size("_ranks") > 0)
    members = binned.groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_c"))
    members = null_safe_join(members, targets, [*keys, "_bin"])
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    members = members.withColumn("_end", F.col("_before") + F.sum("_c").over(in_bin))
    hits = members.select(
        *keys,
        "_n",
        "_v",
        F.explode(
            F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))
        ).alias("_rank"),
    )
    out = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.max(F.when(F.col("_rank") == F.floor(rank), F.col("_v")))
        hi = F.max(F.when(F.col("_rank") == F.ceil(rank), F.col("_v")))
        frac = F.max(rank - F.floor(rank))
        out.append((lo + frac * (hi - lo)).alias(name))
    return hits.groupBy(*keys).agg(*out)
