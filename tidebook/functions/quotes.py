"""Column expressions of books and quotes: reference prices, shapes, penalties, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.sources.market import best

EIGHT_HOURS_NS = 8 * 3_600_000_000_000


def mid(bids: str = "bids", asks: str = "asks") -> Column:
    """Null unless both sides are there."""
    return (best(bids) + best(asks)) / 2


def weighted_mid(bids: str = "bids", asks: str = "asks") -> Column:
    """Touch prices weighted by the opposite sizes; the mid if both sizes are zero."""
    b, a, bz, az = best(bids), best(asks), best(bids, "sz"), best(asks, "sz")
    return F.when(bz + az > 0, (b * az + a * bz) / F.nullif(bz + az, F.lit(0.0))).otherwise((b + a) / 2)


def microprice(bids: str = "bids", asks: str = "asks") -> Column:
    """Mid moved by the imbalance of touch sizes times half the spread."""
    b, a, bz, az = best(bids), best(asks), best(bids, "sz"), best(asks, "sz")
    lean = (bz - az) / F.nullif(bz + az, F.lit(0.0)) * (a - b) / 2
    return (b + a) / 2 + F.coalesce(lean, F.lit(0.0))


def size_at(levels: Column, px: Column) -> Column:
    """Visible size at a price, null if no level is there."""
    return F.get(F.filter(levels, lambda l: F.abs(l["px"] - px) <= 1e-9), F.lit(0))["sz"]


def nearest_level(levels: Column, px: Column) -> Column:
    """Price of the visible level nearest to px; of equally near ones the best."""
    far = F.transform(levels, lambda l, i: F.struct(F.abs(l["px"] - px).alias("far"), i.alias("i"), l["px"].alias("px")))
    return F.array_min(far)["px"]


def order(side: int, px: Column, size: Column, idx: int = 0, queue: Column | None = None) -> Column:
    """One resting order; idx keeps orders of a side apart. queue is the visible size at its price where that is known without a search."""
    queue = F.lit(None) if queue is None else queue
    return F.struct(F.lit(side).alias("side"), px.cast("double").alias("px"), size.cast("double").alias("size"), F.lit(idx).alias("idx"), queue.cast("double").alias("queue"))


def at_level(side: int, size: Column, level: int = 0, idx: int = 0, when: Column | None = None) -> Column:
    """An order at a level of its own side's book; its queue is that level's size. when: a condition for it to be there at all."""
    levels = "bids" if side == 1 else "asks"
    px = best(levels, level=level)
    return order(side, px if when is None else F.when(when, px), size, idx, best(levels, "sz", level))


def shape_levels(half: Column, step: float, n: Column) -> Column:
    """Offsets of an evenly spaced ladder of n levels."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: half + k * F.lit(step))


def shape_geometric(half: Column, ratio: float, n: Column) -> Column:
    """Offsets that grow by a ratio."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: half * F.pow(F.lit(ratio), k))


def shape_depth(inv: Column, most: int, threshold: float) -> Column:
    """Number of levels: all of them up to a threshold of inventory, tapering to one at twice that; half rounds to even."""
    share = F.least(F.greatest((F.abs(inv) - threshold) / F.lit(threshold), F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(1), F.bround(most * (1 - share), 0).cast("int"))


def penalty_linear(inv: Column, gamma: float) -> Column:
    return -gamma * inv


def penalty_quadratic(inv: Column, gamma: float) -> Column:
    return -F.signum(inv) * gamma * inv * inv


def penalty_exponential(inv: Column, gamma: float, scale: float) -> Column:
    return -F.signum(inv) * gamma * (F.exp(F.abs(inv) / scale) - 1)


def penalty_asymmetric(inv: Column, long: float, short: float) -> Column:
    return F.when(inv >= 0, -long * inv).otherwise(-short * inv)


def penalty_soft_cap(inv: Column, gamma: float, cap: float) -> Column:
    """Linear, with a quadratic part beyond the cap."""
    over = F.abs(inv) / cap - 1
    return -gamma * inv - F.when(F.abs(inv) > cap, F.signum(inv) * gamma * cap * over * over).otherwise(F.lit(0.0))


def fee(notional: Column, is_maker: Column, maker: float, taker: float, rebate: float = 0.0) -> Column:
    return F.abs(notional) * F.when(is_maker, maker - rebate).otherwise(taker)


def slippage(notional: Column, is_maker: Column, rate: float, maker_pays: bool = False) -> Column:
    """Cost of crossing the book; a resting order fills at its own price and has none, unless maker_pays."""
    return F.when(is_maker & ~F.lit(maker_pays), F.lit(0.0)).otherwise(F.abs(notional) * rate)


def funding(inv: Column, px: Column, dt_ns: Column, rate: float) -> Column:
    """Cost of holding inv over dt at a rate for eight hours."""
    return F.when(dt_ns > 0, F.abs(inv) * F.abs(px) * rate * dt_ns / F.lit(float(EIGHT_HOURS_NS))).otherwise(F.lit(0.0))
