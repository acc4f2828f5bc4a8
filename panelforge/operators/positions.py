"""Trading records: targets to orders, fills to positions, positions at the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.schemas import FILL, ORDER, ORDER_TYPES, POSITION, SIDES, SIGNAL


def invalid(records: DataFrame, kind: str) -> DataFrame:
    """The rows that can't be a record of ``kind`` (signal, order, fill or position), with ``why``; columns that are missing are an error."""
    schema = {"signal": SIGNAL, "order": ORDER, "fill": FILL, "position": POSITION}[kind]
    if missing := [c for c in schema.names if c not in records.columns and c not in ("limit_price", "order_type", "market_price")]:
        raise ValueError(f"a {kind} needs {', '.join(missing)}")
    rules: list[tuple[Column, str]] = [(F.col("ticker").isNull(), "no ticker")]
    if kind != "position":
        rules.append((F.col("timestamp").isNull(), "no timestamp"))
    if "side" in schema.names:
        rules += [(~F.coalesce(F.col("side").isin(*SIDES), F.lit(False)), "no such side"), (~F.coalesce(F.col("quantity") > 0, F.lit(False)), "no quantity")]
    if kind == "order" and "order_type" in records.columns:
        rules += [(~F.coalesce(F.col("order_type").isin(*ORDER_TYPES), F.lit(False)), "no such order type"), ((F.col("order_type") == "LIMIT") & F.col("limit_price").isNull(), "no limit")]
    why = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda x: x.isNotNull())
    return records.withColumn("why", why).where(F.size("why") > 0)


def side_of(quantity: Column) -> Column:
    """BUY for a long position, SELL for a short one, null for none."""
    return F.when(quantity > 0, SIDES[0]).when(quantity < 0, SIDES[1])


def marked(positions: DataFrame) -> DataFrame:
    """Positions with market_value, unrealized_pnl and side; a market price that is missing is 0."""
    price = F.coalesce("market_price", F.lit(0.0))
    return positions.withColumns({"market_value": F.col("quantity") * price, "unrealized_pnl": F.col("quantity") * (price - F.col("avg_entry_price")), "side": side_of(F.col("quantity"))})


def positions(fills: DataFrame, prices: DataFrame) -> DataFrame:
    """ticker, quantity, avg_entry_price, market_price, realized_pnl, commission after all ``fills``, at the last of ``prices`` (ticker, timestamp, price).

    Entry is at average cost: fills that add to a position move its average,
    those that reduce it realise their difference from it, and one that turns it
    round opens the rest at its own price. That depends on the order of a ticker's
    fills, so they are folded one after another, ticker by ticker; a ticker's
    fills are one array in one task. Ties in time go by side, then quantity, then price.
    """
    signed = F.when(F.col("side") == SIDES[0], F.col("quantity")).otherwise(-F.col("quantity"))
    fill = F.struct("timestamp", "side", F.col("quantity").alias("size"), "price", signed.alias("signed"), F.coalesce("commission", F.lit(0.0)).alias("commission"))
    start = F.struct(F.lit(0).cast("long").alias("quantity"), F.lit(0.0).alias("average"), F.lit(0.0).alias("realized"))

    def step(held: Column, x: Column) -> Column:
        after = held["quantity"] + x["signed"]
        same = (held["quantity"] == 0) | (F.signum(held["quantity"]) == F.signum(x["signed"]))
        turned = ~same & (F.abs(x["signed"]) > F.abs(held["quantity"]))
        closed = F.least(F.abs(held["quantity"]), F.abs(x["signed"]))
        gain = F.when(same, 0.0).otherwise(closed * (x["price"] - held["average"]) * F.signum(held["quantity"]))
        moved = F.try_divide(held["quantity"] * held["average"] + x["signed"] * x["price"], after)
        average = F.when(after == 0, 0.0).when(same, moved).when(turned, x["price"]).otherwise(held["average"])
        return F.struct(after.alias("quantity"), average.alias("average"), (held["realized"] + gain).alias("realized"))

    folded = fills.groupBy("ticker").agg(F.array_sort(F.collect_list(fill)).alias("fills"), F.sum(F.coalesce("commission", F.lit(0.0))).alias("commission"))
    held = folded.select("ticker", F.aggregate("fills", start, step).alias("held"), "commission")
    last = prices.where("price is not null").groupBy("ticker").agg(F.max_by("price", F.struct("timestamp", "price")).alias("market_price"))
    out = held.join(last, "ticker", "left")
    return out.select("ticker", F.col("held.quantity").alias("quantity"), F.col("held.average").alias("avg_entry_price"), F.coalesce("market_price", F.lit(0.0)).alias("market_price"), F.col("held.realized").alias("realized_pnl"), "commission")


def orders(signals: DataFrame, held: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    """Market orders (``ORDER``) that bring each ticker to its latest target weight of ``equity``: whole shares toward zero; what has no target is closed."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("timestamp"), F.desc("weight"))
    target = signals.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select("ticker", "timestamp", "weight")
    last = prices.where("price > 0").groupBy("ticker").agg(F.max_by("price", F.struct("timestamp", "price")).alias("_price"), F.max("timestamp").alias("_at"))
    both = target.join(held.select("ticker", F.col("quantity").alias("_held")), "ticker", "full_outer").join(last, "ticker")
    wanted = (F.coalesce("weight", F.lit(0.0)) * F.lit(float(equity)) / F.col("_price")).cast("long")
    change = wanted - F.coalesce("_held", F.lit(0).cast("long"))
    out = both.withColumn("_change", change).where("_change != 0")
    return out.select("ticker", F.coalesce("timestamp", "_at").alias("timestamp"), side_of(F.col("_change")).alias("side"), F.abs("_change").alias("quantity"), F.lit(ORDER_TYPES[0]).alias("order_type"), F.lit(None).cast("double").alias("limit_price"))
