"""Variants by significance and sub-matrices of linkage disequilibrium in long form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinmer.functions.names import parse_variant, variant_id
from kinmer.operators.common import number_chunks, number_rows, unused
from kinmer.shared import cut

THRESHOLDS = (0.001, 0.005, 0.01, 0.05)


def threshold_variants(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, mode: str = "neglog10", p: str | None = None) -> DataFrame:
    """A row for each threshold that a variant passes (lists nest), inclusive, in one pass.

    mode neglog10: p is -log10 of the p-value and is compared with -log10 of the threshold, the
    latter computed once; mode p: the p-value itself.
    """
    col = F.col(p or ("neglog10_pval_EUR" if mode == "neglog10" else "pval"))
    cuts = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(-math.log10(t)).alias("c")) for t in thresholds])
    passes = F.filter(cuts, lambda s: (col >= s["c"]) if mode == "neglog10" else (col <= s["t"]))
    own = unused(df, "cut")
    return df.withColumn(own, F.explode(passes)).withColumn("threshold", F.col(f"{own}.t")).drop(own)


def with_variant_id(df: DataFrame, name: str = "variant") -> DataFrame:
    """H8 on a table of chr, pos, ref, alt."""
    return df.withColumn(name, variant_id(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt")))


def split_variants(variants: DataFrame, keys: Sequence[str] = ("trait", "threshold"), size: int = 3000) -> DataFrame:
    """Chromosome and chunk of `size` variants within each list, in order of position and id."""
    own = unused(variants, "parsed")
    parts = variants.withColumn(own, parse_variant(F.col("variant"))).withColumns({c: F.col(f"{own}.{c}") for c in ("chr", "pos")}).drop(own)
    return number_chunks(parts, size, [*keys, "chr"], ["pos", "variant"])


def match_variants(variants: DataFrame, index: DataFrame) -> tuple[DataFrame, Observation]:
    """Variants (variant, input_pos) with `idx`, null where unmatched, and counts matched/total.

    The counts are there once an action has run; see `require_match`.
    """
    own = unused(variants, "parsed")
    split = variants.withColumn(own, parse_variant(F.col("variant"))).withColumns({c: F.col(f"{own}.{c}") for c in ("chr", "pos", "ref", "alt")}).drop(own)
    seen = Observation()
    matched = split.join(index.select("chr", "pos", "ref", "alt", "idx"), ["chr", "pos", "ref", "alt"], "left")
    return matched.observe(seen, F.count("idx").alias("matched"), F.count(F.lit(1)).alias("total")), seen


def require_match(seen: Observation) -> dict[str, int]:
    """The counts of `match_variants`; no match at all is an error."""
    if not seen.get["matched"]:
        raise ValueError(f"none of {seen.get['total']} variants is in the index")
    return seen.get


def subset_ld(triples: DataFrame, matched: DataFrame) -> DataFrame:
    """Stored triples with both ends among the matched indices, of which repeats count once.

    A task hashes its share of the indices and streams triples by; these are never sorted.
    """
    ids = matched.select("idx").dropna().distinct().hint("shuffle_hash")
    rows = triples.join(ids.withColumnRenamed("idx", "i"), "i", "left_semi")
    return rows.join(ids.withColumnRenamed("idx", "j"), "j", "left_semi")


#: Variants of a tile's side.
TILE = 50_000
#: Folders of a store in tiles, in each direction.
FOLDERS = 16


def with_tiles(triples: DataFrame, tile: int = TILE) -> DataFrame:
    """Triples with the tile (ti, tj) that each lies in, and that tile's folder (fi, fj); see `write_ld_tiles`.

    Tiles are dealt to FOLDERS x FOLDERS folders in turn: neighbours lie apart, and a store of any size has no more folders.
    """
    tiled = triples.withColumns({"ti": F.floor(F.col("i") / tile).cast("int"), "tj": F.floor(F.col("j") / tile).cast("int")})
    return tiled.withColumns({"fi": F.pmod("ti", F.lit(FOLDERS)), "fj": F.pmod("tj", F.lit(FOLDERS))})


def subset_tiles(tiles: DataFrame, matched: DataFrame, tile: int = TILE) -> DataFrame:
    """J14 on a tiled store: as `subset_ld`, but only what may hold wanted variants in both directions is read.

    The wanted tiles follow from the list of indices. Their folders are chosen by dynamic partition pruning (`explain`
    shows it at the scan); in these, files lie in order of tiles, and row groups outside the first and last wanted tile
    are skipped by their statistics. Indices are numbers from 0.
    """
    ids = matched.select("idx").dropna().distinct()
    own = ids.filter("idx >= 0").select(F.floor(F.col("idx") / tile).cast("int").alias("t"))
    least, most = own.agg(F.min("t"), F.max("t")).first()
    rows = tiles
    for c, folder in (("ti", "fi"), ("tj", "fj")):
        rows = rows.filter(F.col(c).between(least, most))
        rows = rows.join(F.broadcast(own.select(F.pmod("t", F.lit(FOLDERS)).alias(folder)).distinct()), folder, "left_semi")
    return subset_ld(rows.select("i", "j", "r"), matched)


def complete_symmetric(subset: DataFrame, matched: DataFrame) -> DataFrame:
    """(i, j, r, r2) with the upper triangle mirrored and a diagonal of 1.

    Cells that aren't stored are zero and stay implicit; `dense_matrix` writes them out.
    """
    upper = subset.filter("i < j").select("i", "j", "r")
    ids = matched.select(F.col("idx").alias("i")).dropna().distinct()
    ends = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    mirrored = upper.select(F.explode(ends).alias("_at"), "r").select("_at.i", "_at.j", "r")
    both = mirrored.union(ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("r")))
    return both.withColumn("r2", F.col("r") * F.col("r"))


def dense_matrix(cells: DataFrame, matched: DataFrame, value: str = "r", limit: int = 3000) -> DataFrame:
    """The square matrix of one chunk, a row for each matched variant in input order.

    A chunk has at most `limit` variants, which bounds rows, columns and what the driver lists.
    """
    labels = matched.filter("idx IS NOT NULL").select("input_pos", "variant", "idx").orderBy("input_pos").limit(limit + 1).collect()
    if len(labels) > limit:
        raise ValueError(f"more than {limit} variants: split them in chunks")
    rows = matched.filter("idx IS NOT NULL").select("input_pos", "variant", F.col("idx").alias("i"))
    by_j = F.map_from_entries(F.collect_list(F.struct("j", value)))
    filled = cells.groupBy("i").agg(by_j.alias("_m"))
    cell = [F.coalesce(F.try_element_at("_m", F.lit(r.idx).cast("long")), F.lit(0.0)).alias(r.variant if n == 0 else f"{r.variant}#{n}") for r, n in _repeats(labels)]
    return rows.join(filled, "i", "left").orderBy("input_pos").select("variant", *cell)


#: Variants of a side of a file of `matrix_blocks`.
BLOCK = 1000


def matrix_blocks(cells: DataFrame, matched: DataFrame, value: str = "r", block: int = BLOCK) -> DataFrame:
    """Lines (file, at, value) of the square matrix of any number of variants, in files of at most `block` rows and columns."""
    return matrix_rows(cells, matched, value, block).select("file", "at", matrix_line().alias("value"))


def matrix_line() -> Column:
    """The line of a row of `matrix_rows`: its label and all its cells, those that aren't stored 0.0; work follows the stored cells."""
    zero = F.lit("\t0.0")

    def after(c: Column, k: Column) -> Column:
        """A stored cell, and before it the zeros since the last one."""
        last = F.coalesce(F.get("cells", k - 1)["col"], F.lit(-1))
        return F.concat(F.repeat(zero, c["col"] - last - 1), F.lit("\t"), F.coalesce(c["r"], F.lit(0.0)).cast("string"))

    last = F.coalesce(F.get("cells", F.size("cells") - 1)["col"], F.lit(-1))
    row = F.concat("variant", F.array_join(F.transform("cells", after), ""), F.repeat(zero, F.col("n") - last - 1))
    return F.when(F.col("at") < 0, F.concat_ws("\t", F.lit("variant"), "names")).otherwise(row)


def matrix_rows(cells: DataFrame, matched: DataFrame, value: str = "r", block: int = BLOCK, ending: str = ".tsv") -> DataFrame:
    """Rows (file, at, variant, n, cells, names) that `matrix_line` makes lines of: they hold stored cells only, so they move instead of lines.

    Variants are numbered in input order; file rows_<a>_cols_<b> has the rows of block a and the columns of block b,
    a header (at -1) with their variants and a label before each row.
    """
    told = number_rows(matched.filter("idx IS NOT NULL").select("input_pos", "variant", F.col("idx").cast("long").alias("idx")), ["input_pos"], "place")
    placed = cut(told.select("variant", "idx", "place", F.floor(F.col("place") / block).alias("block"), (F.col("place") % block).cast("int").alias("col")))
    columns = placed.groupBy(F.col("block").alias("b")).agg(F.sort_array(F.collect_list(F.struct("col", "variant")))["variant"].alias("names"))
    ends = placed.select(F.col("idx").alias("j"), F.col("block").alias("b"), "col")
    stored = cells.select("i", F.col("j").cast("long").alias("j"), F.col(value).cast("double").alias("r")).join(ends, "j")
    by_col = F.map_from_entries(F.collect_list(F.struct("col", "r")))  # a cell that is stored twice is an error
    filled = stored.groupBy(F.col("i").alias("idx"), "b").agg(by_col.alias("cells")).withColumn("cells", F.sort_array(F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].alias("col"), e["value"].alias("r")))))
    grid = placed.select(F.col("block").alias("a"), "idx", "place", "variant").crossJoin(F.broadcast(columns.select("b", F.size("names").alias("n"))))
    file = F.format_string(f"rows_%05d_cols_%05d{ending}", "a", "b").alias("file")
    none = F.array().cast("array<struct<col int, r double>>")
    rows = grid.join(filled, ["idx", "b"], "left").select(file, F.col("place").alias("at"), "variant", "n", F.coalesce("cells", none).alias("cells"))
    heads = columns.crossJoin(F.broadcast(columns.select(F.col("b").alias("a")))).select(file, F.lit(-1).cast("long").alias("at"), "names")
    return rows.unionByName(heads, allowMissingColumns=True)



def _repeats(labels: list) -> list[tuple]:
    """Each label with how often its variant came before."""
    seen: dict[str, int] = {}
    out = []
    for r in labels:
        out.append((r, seen.get(r.variant, 0)))
        seen[r.variant] = seen.get(r.variant, 0) + 1
    return out
