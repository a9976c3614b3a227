"""Running values over rows in order, without a window over a file or a group: scans of segments in two passes.

A segment is what one task has in order: a split of a file as the scan gives it, or a part of a range
partitioning. The first pass takes from each segment what goes on beyond it, one row each: how many rows
it has and the last value in it. A running sum and a carry over these rows, of which there are no more than
splits, are joined back in the second pass. So a file or a group of any size is worked on by as many tasks
as it has segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinmer.operators.common import unused
from kinmer.shared import cut


def scan_runs(df: DataFrame, keys: Sequence[str], place: str, counts: dict[str, str] | None = None, fills: dict[str, str] | None = None) -> DataFrame:
    """`df` in the order its tasks have it, with running columns over runs of equal `keys` in a task.

    `place` is a row's number from 0 in its run. `counts` maps new columns to boolean ones: how many rows before
    this one in the run had it true. `fills` maps new columns to others: the last value that isn't null in the run so
    far, this row's included. Nulls among the keys are equal. Nothing is held but one batch and the last row's values.
    """
    counts, fills = counts or {}, fills or {}
    kinds = {f.name: f.dataType for f in df.schema}
    added = [StructField(n, LongType()) for n in (place, *counts)] + [StructField(n, kinds[c]) for n, c in fills.items()]
    own = [unused(df, f"key{k}") for k in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, n_before, counted, filled = None, 0, dict.fromkeys(counts, 0), {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.arange(n)
            begins = np.zeros(n, bool)
            for k in own:
                code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                begins[1:] |= code[1:] != code[:-1]
            key = [batch.column(k)[0].as_py() for k in own]
            goes_on = last_key is not None and key == last_key
            begins[0] = not goes_on
            start = np.maximum.accumulate(np.where(begins, at, 0))
            first = (start == 0) & goes_on  # still in the run of the batch before
            told = [pa.array(at - start + np.where(first, n_before, 0))]
            for name, flag in counts.items():
                true = batch.column(flag).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(true) - true
                value = before - before[start] + np.where(first, counted[name], 0)
                told.append(pa.array(value))
                counted[name] = int(value[-1] + true[-1])
            for name, col in fills.items():
                values = batch.column(col)
                known = values.is_valid().to_numpy(zero_copy_only=False)
                newest = np.maximum.accumulate(np.where(known, at, -1))
                held = filled.get(name, pa.nulls(1, values.type))
                take = np.where(newest >= start, newest + 1, 0)
                nothing = (newest < start) & ~first
                told.append(pa.concat_arrays([held, values]).take(pa.array(take, mask=nothing)))
                filled[name] = told[-1].slice(n - 1, 1)
            n_before = int(told[0][-1].as_py()) + 1
            last_key = [batch.column(k)[n - 1].as_py() for k in own]
            kept = [batch.column(c) for c in batch.schema.names if c not in own]
            yield pa.RecordBatch.from_arrays([*kept, *told], [*[c for c in batch.schema.names if c not in own], *[f.name for f in added]])

    with_keys = df.select("*", *[F.col(k).alias(o) for k, o in zip(keys, own)])
    return with_keys.mapInArrow(run, StructType([*df.schema.fields, *added]))


def number_lines(lines: DataFrame, place: str, counts: dict[str, str] | None = None, fills: dict[str, str] | None = None) -> DataFrame:
    """`lines` of files as `read_lines` gives them (file, at, ...), with running columns over each whole file.

    As `scan_runs`, but for a file instead of a run: a split's rows are numbered by the scan that reads them, and what
    its file has before it is joined from one row a split. Rows must not have been dealt anew since they were read.
    """
    return join_splits(scan_splits(lines, place, counts, fills), place, counts, fills)


def scan_splits(lines: DataFrame, place: str, counts: dict[str, str] | None = None, fills: dict[str, str] | None = None) -> DataFrame:
    """The first half of `number_lines`: running columns over each split. Its rows may be written and dealt anew."""
    one = unused(lines, "block")
    return scan_runs(lines.withColumn(one, F.col("at.block")), ["file", one], place, counts, fills).drop(one)


def join_splits(local: DataFrame, place: str, counts: dict[str, str] | None = None, fills: dict[str, str] | None = None) -> DataFrame:
    """The second half of `number_lines`: the rows of `scan_splits`, and what their files have before their splits added."""
    counts, fills = counts or {}, fills or {}
    columns = [c for c in local.columns if c not in (place, *counts, *fills)]
    flags, one = {n: f"count_if({c})" for n, c in counts.items()}, unused(local, "block")
    local = local.withColumn(one, F.col("at.block"))
    order = Window.partitionBy("file").orderBy(one)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = {place: F.count(F.lit(1)), **{n: F.expr(f) for n, f in flags.items()}, **{n: F.max_by(F.when(F.col(n).isNotNull(), F.col(n)), F.when(F.col(n).isNotNull(), F.col("at"))) for n in fills}}
    names = {n: unused(local, f"{n}_before") for n in totals}
    split = local.groupBy("file", one).agg(*[t.alias(names[n]) for n, t in totals.items()])
    running = {m: F.last(m, ignorenulls=True).over(before) if n in fills else F.coalesce(F.sum(m).over(before), F.lit(0)) for n, m in names.items()}
    carried = split.select(F.col("file").alias(f"{one}_file"), F.col(one).alias(f"{one}_no"), *[c.alias(m) for m, c in running.items()])
    back = local.join(carried, (F.col("file") == F.col(f"{one}_file")) & (F.col(one) == F.col(f"{one}_no")))
    whole = {n: F.coalesce(F.col(n), F.col(m)) if n in fills else F.col(n) + F.col(m) for n, m in names.items()}
    return back.withColumns(whole).select(*columns, *names)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: str, at: str) -> DataFrame:
    """`df` range-partitioned and sorted by keys and order, written once with its part and its place `at`."""
    ranged = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id()))
    return ranged.withColumn(part, F.shiftright(at, 33))  # the identifier holds the partition above its 33 lowest bits


def _carried(local: DataFrame, keys: Sequence[str], part: str, at: str, value: str, how: Callable[[str], Column], name: str) -> DataFrame:
    """`local` with `name`: what earlier parts leave to a row's group, `how` (an aggregate) of the values of their last rows.

    Only a part's last group goes on in later parts, and only a part's first one has come from earlier ones: two rows a
    part meet in a window, one row a part is broadcast.
    """
    group = F.struct(*keys)
    ends = local.groupBy(part).agg(F.min_by(group, at).alias("first"), F.max_by(group, at).alias("last"), F.max_by(F.struct(value), at)[value].alias("value"))
    leaves = ends.select(F.col("last").alias("of"), part, F.lit(1).alias("side"), "value")
    asks = ends.select(F.col("first").alias("of"), part, F.lit(0).alias("side"), F.lit(None).cast(ends.schema["value"].dataType).alias("value"))
    before = Window.partitionBy("of").orderBy(part, "side").rowsBetween(Window.unboundedPreceding, -1)
    found = leaves.union(asks).withColumn("carried", how("value").over(before)).filter("side = 0 AND carried IS NOT NULL")
    own, of = unused(local, "carried_part"), unused(local, "carried_of")
    found = found.select(F.col(part).alias(own), F.col("of").alias(of), F.col("carried").alias(name))
    return local.join(F.broadcast(found), (F.col(part) == F.col(own)) & group.eqNullSafe(F.col(of)), "left")


def carry_forward(df: DataFrame, col: str, keys: Sequence[str], pos: str, name: str) -> DataFrame:
    """The last value that isn't null at or before each row of its group, in the order of `pos`.

    Rows are range-partitioned by group and place and written once, so a large group lies in many parts. Each part
    is scanned by itself; only its last row goes on to the parts that begin in the same group.
    """
    part, at, filled, place, before = (unused(df, n) for n in ("part", "at", "filled", "place", "before"))
    local = scan_runs(_ranged(df, keys, [pos], part, at), [part, *keys], place, fills={filled: col})
    back = _carried(local, keys, part, at, filled, lambda v: F.last(v, ignorenulls=True), before)
    return back.withColumn(name, F.coalesce(filled, before)).select(*df.columns, name)


def number_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based places of rows in their groups, in order; a group of any size is numbered by many tasks.

    The ranges that `carry_forward` works on; a part's last group leaves the number of its rows there. Rows equal in
    the order keep the place they got.
    """
    part, at, place, size, before = (unused(df, n) for n in ("part", "at", "place", "size", "before"))
    local = scan_runs(_ranged(df, keys, order, part, at), [part, *keys], place).withColumn(size, F.col(place) + 1)
    back = _carried(local, keys, part, at, size, F.sum, before)
    return back.withColumn(name, F.col(place) + F.coalesce(before, F.lit(0))).select(*df.columns, name)
