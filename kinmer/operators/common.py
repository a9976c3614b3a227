"""General transforms: groups, windows, chunk numbers, quantiles, histograms, set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinmer.shared import cut


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores: only an input of very few splits is dealt anew.

    For work on long texts, where a small file of one row group would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as keep it apart from the frame's columns in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Each row with aggregates of its group; null keys are a group like any other.

    Sums fold in the map tasks and are joined back, so a large group's rows are dealt out, where a window would bring
    them together.
    """
    own = {k: unused(df, f"{k}_of") for k in keys}
    found = df.groupBy(*[F.col(k).alias(o) for k, o in own.items()]).agg(*[c.alias(n) for n, c in totals.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()])
    return df.drop(*totals).join(found, same).drop(*own.values())


def group_sum(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """The group's sum on each of its rows."""
    return with_totals(df, keys, **{name: F.sum(col)})


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each group in its map tasks before the shuffle."""
    rank, place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), unused(df, "rank")
    return df.withColumn(place, rank).filter(F.col(place) <= n).drop(place)


def first_per_group(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each group in the order of one column, by a combined minimum, not a window."""
    rest, row = [c for c in df.columns if c not in keys], unused(df, "row")
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias(row)).select(*keys, f"{row}.*")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    return top_n_per_group(df, keys, order, 1)


def number_chunks(df: DataFrame, size: int, keys: Sequence[str], order: Sequence[Column | str], name: str = "chunk") -> DataFrame:
    """Chunk numbers of `size` rows within each group, in order. For one global order see `number_rows`."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(name, F.floor(row / size).cast("long"))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """0-based positions in a global order, without sending all rows through one task.

    Rows are range-partitioned and sorted once and written to the shared folder with the partition and
    the place in it, which are data from there on: a plan that is run anew can't deal rows differently.
    The counts' running sum (one number a partition) is joined back. Rows equal in the order keep the
    place they got.
    """
    at, part, first = unused(df, "at"), unused(df, "part"), unused(df, "first")
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    # The identifier holds the partition above its 33 lowest bits and the row within it in those.
    placed = ranged.withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(part, F.coalesce(before, F.lit(0)).alias(first))
    # One row a partition of the shuffle: bounded by the number of partitions, so it is broadcast.
    position = F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(firsts), part).withColumn(name, position).drop(part, first, at)


def number_global_chunks(df: DataFrame, size: int, order: Sequence[str], name: str = "chunk") -> DataFrame:
    """W5 over the whole table."""
    row = unused(df, "row")
    return number_rows(df, order, row).withColumn(name, F.floor(F.col(row) / size).cast("long")).drop(row)


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A10: counts of values, largest first, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), col)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lower, upper, n) over equal bins from minimum to maximum, empty ones included.

    The maximum falls in the last bin; nulls are left out; a single value fills the first bin.
    """
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    low, high = ends.select("_lo").scalar(), ends.select("_hi").scalar()  # two numbers, read once
    place = F.floor((F.col(col) - low) * bins / F.nullif(high - low, F.lit(0.0)))
    at = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(col).isNotNull()).select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = ends.filter("_lo IS NOT NULL").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("lower"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def sort_desc(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """descending, ties in the order of keys that the caller names."""
    return df.orderBy(F.desc(col), *ties)


def top_k(df: DataFrame, col: str, k: int, *ties: str) -> DataFrame:
    """each task keeps its own best k before they meet."""
    return sort_desc(df, col, *ties).limit(k)


def head(df: DataFrame, n: int) -> DataFrame:
    """N rows."""
    return df.limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Union, then the first row of each key in an explicit order."""
    return dedup(union_all(a, b), keys, order)


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) with side `both`, `left` or `right`; one aggregation over both key sets."""
    sides = left.select(key).withColumn("_side", F.lit(1)).union(right.select(key).withColumn("_side", F.lit(2)))
    side = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.bit_or("_side"))
    return sides.groupBy(key).agg(side.alias("side"))


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and metrics that are there once an action has run on them."""
    seen = Observation()
    return df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), seen
