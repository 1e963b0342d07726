"""Ordered scans over a vehicle's history that stay parallel when one vehicle is huge.

A plain ``Window.partitionBy(vehicle_id)`` puts all rows of a vehicle into one task. Here the
few vehicles with very many rows are found first, by a narrow pass over keys and times, and
cut into time slices. Windows then run per (vehicle, slice); what a slice hands to the next
ones is one summary row per slice, computed by a map-side combining aggregate. Without a
large vehicle the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A vehicle is large from this many rows on; its slices hold about a quarter as many.
LARGE_ROWS = 2_000_000
_SLICES_PER_LARGE = 4
# Only this many vehicles are ever cut, the largest ones: each of the others then holds less
# than 1/20,000 of all rows. It also bounds what the driver reads and broadcasts, to 2 MB.
MAX_LARGE_VEHICLES = 20_000

_SLICE = "_slice"


@dataclass(frozen=True)
class Order:
    """How a history is keyed and ordered, and when a key counts as large."""
    keys: tuple[str, ...] = ("vehicle_id",)
    time: str = "event_timestamp"
    tie: str = "id"
    large_rows: int = LARGE_ROWS


def by_vehicle(large_rows: int | None = None) -> Order:
    return Order() if large_rows is None else Order(large_rows=large_rows)


@dataclass(frozen=True)
class Slices:
    """The large keys, each with the start and width of its slices in microseconds; no
    frame when there is none."""
    order: Order
    frame: DataFrame | None


def find_slices(table: DataFrame, order: Order) -> Slices:
    """Finds the large keys of a table. Runs a job that reads only keys and times."""
    micros = f"unix_micros({order.time})"
    slices = f"ceil(n * {_SLICES_PER_LARGE} / {order.large_rows})"
    large = (table.groupBy(*order.keys)
             .agg(F.expr("count(*) AS n"), F.expr(f"min({micros}) AS first"), F.expr(f"max({micros}) AS last"))
             .where(f"n >= {order.large_rows}").orderBy(F.desc("n"), *order.keys).limit(MAX_LARGE_VEHICLES)
             .selectExpr(*order.keys, "first AS _start", f"ceil((last - first + 1) / {slices}) AS _width"))
    rows = large.collect()
    return Slices(order, table.sparkSession.createDataFrame(rows, large.schema) if rows else None)


@dataclass(frozen=True)
class History:
    """Rows of a table with what is needed to scan them in order."""
    df: DataFrame
    order: Order
    cut: bool

    @property
    def _keys(self) -> list[str]:
        return [*self.order.keys, _SLICE] if self.cut else [*self.order.keys]

    def _ordered(self):
        return Window.partitionBy(*self._keys).orderBy(self.order.time, self.order.tie)

    def via(self, df: DataFrame) -> "History":
        """The same history with other columns."""
        return replace(self, df=df)

    def shuffled(self) -> "History":
        """Shuffled by vehicle and slice now: the windows to come need no further shuffle."""
        return self.via(self.df.repartition(*self._keys))

    def rows(self) -> DataFrame:
        return self.df.drop(_SLICE)

    def _carried(self, df: DataFrame, summary: list[Column], carry: dict[str, Column]) -> DataFrame:
        """``df`` joined with what the earlier slices of its key hand over."""
        slices = df.where(f"{_SLICE} IS NOT NULL").groupBy(*self._keys).agg(*summary)
        return df.join(slices.select(*self._keys, *[c.alias(name) for name, c in carry.items()]), self._keys, "left")

    def _earlier(self):
        return Window.partitionBy(*self.order.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)

    def with_previous(self, name: str, value: Column, where: Column | None = None) -> "History":
        """Adds ``name``: the value at the nearest earlier row (of those satisfying ``where``).
        ``value`` must be a struct, so that a null field can be told from a missing row."""
        known = value if where is None else F.when(where, value)
        if where is None:
            nearest = F.lag(known).over(self._ordered())
        else:
            nearest = F.last(known, ignorenulls=True).over(self._ordered().rowsBetween(Window.unboundedPreceding, -1))
        if not self.cut:
            return self.via(self.df.withColumn(name, nearest))
        held = self.df.withColumns({"_known": known, "_local": nearest})
        position = F.when(F.col("_known").isNotNull(), F.struct(self.order.time, self.order.tie))
        carried = self._carried(held, [F.max_by("_known", position).alias("_tail")],
                                {"_carry": F.last("_tail", ignorenulls=True).over(self._earlier())})
        return self.via(carried.withColumn(name, F.coalesce("_local", "_carry")).drop("_known", "_local", "_carry"))

    def with_running(self, sums: dict[str, Column], maxima: dict[str, Column]) -> "History":
        """Adds running sums and maxima up to and including each row."""
        upto = self._ordered().rowsBetween(Window.unboundedPreceding, 0)
        if not self.cut:
            return self.via(self.df.withColumns({**{n: F.sum(c).over(upto) for n, c in sums.items()},
                                                 **{n: F.max(c).over(upto) for n, c in maxima.items()}}))
        agg = {**{n: F.sum for n in sums}, **{n: F.max for n in maxima}}
        held = self.df.withColumns({f"_in_{n}": c for n, c in {**sums, **maxima}.items()})
        held = held.withColumns({f"_local_{n}": f(f"_in_{n}").over(upto) for n, f in agg.items()})
        carried = self._carried(held, [f(f"_in_{n}").alias(f"_tail_{n}") for n, f in agg.items()],
                                {f"_carry_{n}": f(f"_tail_{n}").over(self._earlier()) for n, f in agg.items()})
        total = {n: F.col(f"_local_{n}") + F.coalesce(f"_carry_{n}", F.lit(0)) for n in sums}
        peak = {n: F.greatest(f"_local_{n}", f"_carry_{n}") for n in maxima}
        return self.via(carried.withColumns({**total, **peak})
                        .drop(*[f"_{kind}_{n}" for kind in ("in", "local", "carry") for n in agg]))


def history(df: DataFrame, slices: Slices) -> History:
    """Rows ready for ordered scans; large keys are cut, other rows have no slice number."""
    order = slices.order
    if slices.frame is None:
        return History(df, order, cut=False)
    number = f"floor((unix_micros({order.time}) - _start) / _width)"
    cut = (df.join(F.broadcast(slices.frame), [*order.keys], "left")
           .withColumn(_SLICE, F.expr(number)).drop("_start", "_width"))
    return History(cut, order, cut=True)
