"""Exact order statistics and quantiles of any number of values, by selection in rounds.

A round has two aggregations of a few numbers. The first proposes two values around each wanted rank from
Spark's bounded quantile sketch; the second counts what lies below, at, between and above them. The cell
with the rank is what is left, some thousandth of the last one; values that fill much of a cell are met as
its ends and leave it at once. When a cell is small its values are counted and put in order by one task.
Nothing rests on the sketch's precision but the number of rounds, and no task holds more than a cell.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmer.shared import cut

#: Rows of a cell that is put in order by one task.
SMALL = 100_000
#: Of the sketch: ranks are off by one part in so many, mostly.
ACCURACY = 10_000


@dataclass
class Cell:
    """The rows of one column that lie strictly between two values, if any; a rank is looked for among them."""

    col: str
    rank: int
    rows: int
    low: Any = None
    high: Any = None
    found: Any = None

    def holds(self) -> Column:
        inside = F.col(self.col).isNotNull()
        if self.low is not None:
            inside &= F.col(self.col) > F.lit(self.low)
        return inside if self.high is None else inside & (F.col(self.col) < F.lit(self.high))

    def narrow(self, ends: Sequence[Any], below: int, at_first: int, between: int, at_second: int) -> None:
        """Go on with the part of the cell that has the rank."""
        first, second = ends
        for size, low, high, value in (
            (below, self.low, first, None), (at_first, None, None, first), (between, first, second, None), (at_second, None, None, second),
        ):
            if self.rank < size:
                self.rows, self.low, self.high, self.found = size, low, high, value
                return
            self.rank -= size
        self.rows, self.low = self.rows - below - at_first - between - at_second, second


def order_statistics(values: DataFrame, ranks: Mapping[str, Sequence[int]], small: int = SMALL) -> dict[tuple[str, int], Any]:
    """{(column, rank): value}: the values of these ranks from 0 among each column's values that aren't null.

    `values` is read several times, so it should be a written table. Ranks must be below the columns' counts.
    """
    sizes = values.agg(*[F.count(c).alias(c) for c in ranks]).first()
    cells = {(c, r): Cell(c, r, sizes[c]) for c, rs in ranks.items() for r in rs}
    while wide := [x for x in cells.values() if x.found is None and x.rows > small]:
        around = [[max(0.0, (x.rank - 2 * x.rows / ACCURACY) / x.rows), min(1.0, (x.rank + 2 * x.rows / ACCURACY) / x.rows)] for x in wide]
        ends = values.agg(*[F.percentile_approx(F.when(x.holds(), F.col(x.col)), p, ACCURACY).alias(f"e{k}") for k, (x, p) in enumerate(zip(wide, around))]).first()
        counts = []
        for k, x in enumerate(wide):
            (a, b), v = ends[k], F.col(x.col)
            other = F.lit(b) != F.lit(a)
            for m, part in enumerate((v < F.lit(a), v == F.lit(a), (v > F.lit(a)) & (v < F.lit(b)), (v == F.lit(b)) & other)):
                counts.append(F.count_if(x.holds() & part).alias(f"c{k}_{m}"))
        told = values.agg(*counts).first()
        for k, x in enumerate(wide):
            x.narrow(ends[k], *told[4 * k : 4 * k + 4])
    for col in ranks:
        narrow = {r: x for (c, r), x in cells.items() if c == col and x.found is None}
        if not narrow:
            continue
        own = F.explode(F.array_compact(F.array(*[F.when(x.holds(), F.lit(r)) for r, x in narrow.items()]))).alias("of")
        counted = values.select(F.col(col).alias("v"), own).groupBy("of", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("of").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        wanted = F.element_at(F.create_map(*[F.lit(n) for r, x in narrow.items() for n in (r, x.rank)]), F.col("of"))
        placed = counted.withColumn("upto", upto).filter((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted))
        for row in placed.select("of", "v").collect():  # a row for each rank
            narrow[row["of"]].found = row["v"]
    return {k: x.found for k, x in cells.items()}


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], small: int = SMALL) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns; nulls don't count, and a column of nulls alone has none."""
    values = cut(df.select(*wanted))
    sizes = values.agg(*[F.count(c).alias(c) for c in wanted]).first()
    places = {c: [q * (sizes[c] - 1) for q in qs] for c, qs in wanted.items() if sizes[c]}
    ranks = {c: sorted({f(p) for p in ps for f in (math.floor, math.ceil)}) for c, ps in places.items()}
    found = order_statistics(values, ranks, small) if ranks else {}

    def between(c: str, p: float) -> float:
        low, high = float(found[c, math.floor(p)]), float(found[c, math.ceil(p)])
        return low if low == high else low * (math.ceil(p) - p) + high * (p - math.floor(p))

    return {c: [between(c, p) for p in places[c]] if c in places else [None] * len(qs) for c, qs in wanted.items()}


def quantile(df: DataFrame, col: str, q: float | Sequence[float], name: str = "quantile") -> DataFrame:
    """Exact, linearly interpolated quantiles, one row; an array if `q` is a list."""
    qs = [q] if isinstance(q, (int, float)) else list(q)
    found = [F.lit(x).cast("double") for x in exact_quantiles(df, {col: qs})[col]]
    return df.sparkSession.range(1).select((found[0] if isinstance(q, (int, float)) else F.array(*found)).alias(name))
