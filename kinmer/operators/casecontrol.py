"""Case and control cohorts: replicate-confirmed hits, proportions, Fisher's exact test."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinmer.operators.common import unused, with_totals


def confirm_hits(assay: DataFrame, z: float = 3.5, replicates: int = 2, timeser: str | None = None) -> DataFrame:
    """Rows with `hit` (z-score above z) and `hit_both` (as many hits over person and peptide as replicates).

    A missing z-score makes the whole (person, peptide) unknown: its hit_both is null.
    """
    rows = assay if timeser is None else assay.filter(F.col("timeser") == timeser)
    rows = rows.withColumn("hit", (F.col("zscore") > z).cast("int"))
    total = F.when(F.count_if(F.col("hit").isNull()) == 0, F.sum("hit"))
    return with_totals(rows, ["id1", "pep_id"], hit_both=(total == replicates).cast("int"))


def confirmed_once(confirmed: DataFrame) -> DataFrame:
    """Replicate-1 rows of peptides with a confirmed hit; one unknown row makes its peptide go.

    Peptides are counted in the map tasks and joined back, so a frequent one never meets in one task.
    """
    first = confirmed.filter("repnum = 1")
    told = first.groupBy("pep_id").agg(F.count_if(F.col("hit_both").isNull()).alias("unknown"), F.sum("hit_both").alias("hits"))
    return first.join(told.filter("unknown = 0 AND hits >= 1").select("pep_id"), "pep_id", "left_semi")


def case_control_table(rows: DataFrame, n: int = 30) -> DataFrame:
    """Proportions of confirmed rows among controls and cases of each peptide, and counts of a cohort of n.

    Counts are the proportion times n, rounded half to even. A peptide seen in one cohort only has
    null numbers for the other.
    """
    def mean(case: int) -> Column:
        return F.avg(F.when(F.col("casestat") == case, F.col("hit_both")))

    out = rows.groupBy("pep_id").agg(mean(0).alias("Prop_controls"), mean(1).alias("Prop_cases"))
    for side in ("cases", "controls"):
        with_hit = F.bround(F.col(f"Prop_{side}") * n).cast("int")
        out = out.withColumns({f"{side}_with": with_hit, f"{side}_without": F.lit(n) - with_hit})
    return out


def _tables(rows: list[int], cols: list[int]) -> list[tuple[float, list[int]]]:
    """(log probability, first row) of all tables of two rows with these margins."""
    log = [0.0]
    for k in range(1, sum(rows) + 1):
        log.append(log[-1] + math.log(k))
    fixed = sum(log[c] for c in cols) + sum(log[r] for r in rows) - log[sum(rows)]
    partial = [(0.0, [])]
    for c in cols:
        partial = [(p - log[x] - log[c - x], [*top, x]) for p, top in partial for x in range(c + 1) if sum(top) + x <= rows[0]]
    return [(fixed + p, top) for p, top in partial if sum(top) == rows[0]]


def fisher_p(table: list[tuple[int, int]]) -> float:
    """Two-sided p-value of a table given as its columns (upper, lower): the total probability of tables
    no likelier than it, with a relative tolerance of 1e-7 for rounding."""
    rows, cols = [sum(c[0] for c in table), sum(c[1] for c in table)], [sum(c) for c in table]
    every = _tables(rows, cols)
    seen = next(p for p, top in every if top == [c[0] for c in table])
    return min(1.0, math.fsum(math.exp(p) for p, _ in every if p <= seen + math.log1p(1e-7)))


def fisher_exact(counts: DataFrame, mode: str = "2x2") -> DataFrame:
    """`p_value` of cases and controls with and without a hit; null where a count is.

    The number of distinct tables depends on the cohort sizes alone, (n+1) x (m+1) at most, so each
    distinct one is tested once and joined back. mode `compat` adds a column that holds both
    proportions rounded to 0 or 1, as in tests over a nested table whose matrix has it.
    """
    side = ["cases_with", "cases_without", "controls_with", "controls_without"]
    pc, pk = unused(counts, "rounded_controls"), unused(counts, "rounded_cases")
    rounded = [F.bround("Prop_controls").cast("int").alias(pc), F.bround("Prop_cases").cast("int").alias(pk)]
    key = side if mode == "2x2" else [*side, pc, pk]
    rows = counts if mode == "2x2" else counts.select("*", *rounded)

    def test(batches):
        for pdf in batches:
            p = []
            for t in pdf[key].itertuples(index=False):
                columns = [(int(t[0]), int(t[1])), (int(t[2]), int(t[3]))]
                p.append(fisher_p(columns if mode == "2x2" else [(int(t[4]), int(t[5])), *columns]))
            yield pdf.assign(p_value=p)

    distinct = rows.select(*key).dropna().distinct()
    tested = distinct.mapInPandas(test, ", ".join(f"{c} int" for c in key) + ", p_value double")
    return rows.join(tested, key, "left").drop(pc, pk)


def with_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Results with their peptide's metadata, keys compared as strings; the metadata has one row a peptide."""
    named = metadata.withColumn("pep_id", F.col("pep_id").cast("string"))
    return results.withColumn("pep_id", F.col("pep_id").cast("string")).join(named, "pep_id", "left")


#: Rows of a part of a group; a group of fewer is one part.
ROWS_A_PART = 100_000


def with_parts(df: DataFrame, keys: list[str], by: str, name: str, rows: int = ROWS_A_PART) -> DataFrame:
    """`df` with a number from 0 that deals a group of n rows, by the hash of `by`, to n / rows parts; most groups are one.

    Groups are counted first. Only those of several parts are broadcast: at most one for each `rows` rows.
    """
    own, parts = {k: unused(df, f"{k}_of") for k in keys}, unused(df, "parts")
    counted = df.groupBy(*[F.col(k).alias(o) for k, o in own.items()]).agg(F.ceil(F.count(F.lit(1)) / rows).alias(parts))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()])
    dealt = df.join(F.broadcast(counted.filter(F.col(parts) > 1)), same, "left")
    return dealt.withColumn(name, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(*own.values(), parts)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A function on each group's rows, for tests that no expression states. A group is held by one task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
