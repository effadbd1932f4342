"""What a row takes from the rows before it, with no window over all time.

A key's rows are cut into slots of a day. Windows hold one key and slot; each slot is
summed up in one row, and what comes over from earlier slots is a window over these
summaries, a row a key and day. Both sides are dealt by key and slot, so the rows are
shuffled once. Keys are never null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_S = 86_400


@dataclass
class Scan:
    """A value over the rows before: within the slot, a slot's summary, what earlier (or later) slots bring, and the two put together."""

    inside: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def previous(value: Column) -> Scan:
    """The value of the row before; a struct, so that a null inside is told from no row."""
    return Scan(lambda w: F.lag(value).over(w), lambda o: F.max_by(value, o), lambda total, over: F.lag(total).over(over), lambda inside, carry: F.coalesce(inside, carry))


def following(value: Column) -> Scan:
    """The value of the row after; a struct."""
    return Scan(lambda w: F.lead(value).over(w), lambda o: F.min_by(value, o), lambda total, over: F.lead(total).over(over), lambda inside, carry: F.coalesce(inside, carry))


def running_sum(value: Column) -> Scan:
    """The sum up to and with this row."""
    return Scan(lambda w: F.sum(value).over(_upto(w)), lambda o: F.sum(value), lambda total, over: F.sum(total).over(_before(over)), lambda inside, carry: F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0)))


def last_known(value: Column, own: bool = True) -> Scan:
    """The last value that is not null, of this row (if ``own``) or one before."""
    reach = _upto if own else _before
    return Scan(lambda w: F.last(value, ignorenulls=True).over(reach(w)), lambda o: F.max_by(value, F.when(value.isNotNull(), o)), lambda total, over: F.last(total, ignorenulls=True).over(_before(over)), lambda inside, carry: F.coalesce(inside, carry))


def next_known(value: Column) -> Scan:
    """The first value that is not null of a row after this one."""
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    return Scan(lambda w: F.first(value, ignorenulls=True).over(after(w)), lambda o: F.min_by(value, F.when(value.isNotNull(), o)), lambda total, over: F.first(total, ignorenulls=True).over(after(over)), lambda inside, carry: F.coalesce(inside, carry))


def carried(rows: DataFrame, keys: list[str], at: str, tie: str, slot_s: int = DAY_S, **scans: Scan) -> DataFrame:
    """``rows`` with a column for each scan, in order of the time ``at`` and then of ``tie``."""
    slotted = rows.withColumn("_slot", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / slot_s))
    order, within = F.struct(at, tie), Window.partitionBy(*keys, "_slot").orderBy(at, tie)
    over = Window.partitionBy(*keys).orderBy("_slot")
    totals = slotted.groupBy(*keys, "_slot").agg(*(s.summary(order).alias(f"_t_{n}") for n, s in scans.items()))
    carry = totals.select(*keys, "_slot", *(s.carry(F.col(f"_t_{n}"), over).alias(f"_c_{n}") for n, s in scans.items()))
    inside = slotted.withColumns({f"_i_{n}": s.inside(within) for n, s in scans.items()})
    return inside.join(carry, [*keys, "_slot"]).select(*rows.columns, *(s.joined(F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in scans.items()))
