"""Nested feed messages to price rows, fill messages to fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skytally.functions.scalars import finite_double

ASSET_NAMES = ("asset_id", "assetId", "token_id", "tokenId", "asset")


def _text(node: Column, *names: str) -> Column:
    """First non-blank of the fields as text."""
    found = [F.trim(F.try_variant_get(node, f"$.{n}", "string")) for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def _number(node: Column, name: str) -> Column:
    return finite_double(F.try_variant_get(node, f"$.{name}", "string"))


def _best(node: Column, side: str, pick) -> Column:
    prices = F.transform(F.try_variant_get(node, f"$.{side}", "array<variant>"), lambda x: _number(x, "price"))
    return pick(prices)


def _members(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _values(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>")


def _opened(node: Column) -> Column:
    """JSON text as what it holds; anything else as it is. (A variant's schema would be worked out in full depth.)"""
    scalar = _members(node).isNull() & _values(node).isNull()
    return F.coalesce(F.when(scalar, F.try_parse_json(F.try_variant_get(node, "$", "string"))), node)


def _children(nodes: Column) -> Column:
    """Members of lists, text among them opened, and values of objects; scalars have none."""
    return F.flatten(F.transform(nodes, lambda n: F.coalesce(
        F.transform(_members(n), _opened), F.map_values(_values(n)), F.array().cast("array<variant>"))))


def nesting(text: Column) -> Column:
    """How deep brackets and braces nest at most; those inside JSON text count too, so it is never too small."""
    marks = F.split(F.regexp_replace(text, r"[^\[\]{}]+", ""), "")
    step = lambda x: F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(marks, start, lambda acc, x: F.struct(
        (acc["now"] + step(x)).alias("now"), F.greatest(acc["most"], acc["now"] + step(x)).alias("most")), lambda acc: acc["most"])


def _walk(root: Column, levels: Column) -> Column:
    """All nodes of one message, level by level: a loop inside the row that runs as often as this message is deep."""
    none = F.array().cast("array<variant>")
    start = F.struct(F.array_compact(F.array(root)).alias("front"), none.alias("seen"))
    step = lambda acc, _: F.struct(_children(acc["front"]).alias("front"), F.concat(acc["seen"], acc["front"]).alias("seen"))
    return F.aggregate(F.sequence(F.lit(0), levels), start, step, lambda acc: acc["seen"])


def price_rows(df: DataFrame, message: str = "message") -> DataFrame:
    """One row (asset, price, field) per price in a message of any of the feed's shapes.

    The walk goes through lists and objects inside one row, as deep as that message goes, so neither the plan nor other
    messages pay for a deep one, and streams need no depth. Text that is not JSON gives no rows (nor does what Spark's
    parser refuses, more than 1000 levels); JSON text at the top or in a list is opened.
    """
    keep = [c for c in df.columns if c != message]
    root = _opened(F.try_parse_json(F.col(message)))
    # The root and the depth are columns of their own, so that each is worked out once for a row.
    parsed = df.select(*keep, root.alias("_root"), nesting(F.col(message)).alias("_levels")).filter("_root IS NOT NULL")
    nodes = _walk(F.col("_root"), F.col("_levels"))
    out = parsed.select(*keep, F.explode(nodes).alias("n")).filter(_values(F.col("n")).isNotNull())
    n = F.col("n")
    kind = F.coalesce(_text(n, "event_type", "eventType"), F.lit(""))
    trade, book = kind == "last_trade_price", kind == "book"
    row = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("price"))
    bid = F.when(trade, F.lit(None)).when(book, _best(n, "bids", F.array_max)).otherwise(_number(n, "best_bid"))
    ask = F.when(trade, F.lit(None)).when(book, _best(n, "asks", F.array_min)).otherwise(_number(n, "best_ask"))
    last = F.when(trade, _number(n, "price")).when(~book, _number(n, "last_price"))
    rows = F.explode(F.array(row("best_bid", bid), row("best_ask", ask), row("last_price", last)))
    out = out.select(*keep, _text(n, *ASSET_NAMES).alias("asset"), rows.alias("r")).select(*keep, "asset", "r.*")
    return out.filter("asset IS NOT NULL AND price IS NOT NULL")


def fill_rows(df: DataFrame, message: str = "message") -> DataFrame:
    """Order updates and trades to (order_id, shares, price): taker and every maker of a trade."""
    keep = [c for c in df.columns if c != message]
    v = F.try_parse_json(F.col(message))
    event = F.lower(F.coalesce(_text(v, "event_type", "type"), F.lit("")))
    kind = F.upper(F.coalesce(_text(v, "type"), F.lit("")))
    is_order = (event == "order") | kind.isin("UPDATE", "PLACEMENT", "CANCELLATION")
    is_trade = ~is_order & ((event == "trade") | (kind == "MATCHED"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    item = lambda oid, q, p, role: F.struct(oid.alias("order_id"), zero(q).alias("shares"), zero(p).alias("price"), F.lit(role).alias("role"))
    makers = F.transform(
        F.coalesce(F.try_variant_get(v, "$.maker_orders", "array<variant>"), F.array().cast("array<variant>")),
        lambda m: item(_text(m, "order_id"), _number(m, "matched_amount"), F.coalesce(_number(m, "price"), _number(v, "price")), "maker"))
    trade = F.concat(F.array(item(_text(v, "taker_order_id"), _number(v, "size"), _number(v, "price"), "taker")), makers)
    order = F.array(item(_text(v, "id"), _number(v, "size_matched"), _number(v, "price"), "order"))
    rows = F.when(is_order, order).when(is_trade, trade)
    return df.select(*keep, F.explode(rows).alias("f")).select(*keep, "f.*").filter("order_id IS NOT NULL")
