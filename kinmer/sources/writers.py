"""Sinks: CSV, TSV parts, partitioned Parquet, FASTA, id lists, matrices."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs  # noqa: F401 - makes pa.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmer.functions.sequences import pair_record_id
from kinmer.operators.common import number_rows, observed, unused
from kinmer.operators.ld import TILE, matrix_line, with_tiles
from kinmer.shared import cut
from kinmer.sources.formats import file_system, list_files, register_formats


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; a key that should lead is put first by the caller."""
    df.write.mode(mode).option("header", True).csv(path)


def write_tsv_parts(df: DataFrame, path: str, max_rows: int = 1_000_000, mode: str = "append") -> None:
    """K3: gz TSV parts with a header, none of more than max_rows rows."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).csv(path, sep="\t", header=True, compression="gzip")


def write_numbered_parts(df: DataFrame, path: str, order: list[str], max_rows: int = 1_000_000, stem: str = "part") -> DataFrame:
    """K3: gz TSV parts <stem>_00001.tsv.gz and so on, of max_rows rows each but the last, in a global order; (file, n_rows) of this run.

    Numbers go on from the highest part that is there, so runs add to a folder. All parts of a run appear together
    when its job is done (format `named_files`). Rows are placed by `number_rows`; no task holds more than a part.
    """
    register_formats(df.sparkSession)
    system, root = file_system(path)
    there = list_files(path) if system.get_file_info(root).type != pa.fs.FileType.NotFound else []
    numbers = [int(m[1]) for name, _ in there if (m := re.search(rf"/{re.escape(stem)}_(\d+)\.tsv\.gz$", name))]
    last, row = max(numbers, default=0), unused(df, "row")
    file = F.format_string(f"{stem}_%05d.tsv.gz", F.floor(F.col("at") / max_rows) + 1 + last)
    line = F.to_csv(F.struct(*df.columns), {"sep": "\t"}).alias("value")
    rows = number_rows(df, order, row).select(F.col(row).alias("at"), line).withColumn("file", file)
    dealt, seen = observed(rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value"), n=F.count(F.lit(1)))
    dealt.write.format("named_files").option("header", "\t".join(df.columns)).mode("append").save(path)
    n = seen.get["n"]
    told = df.sparkSession.range(-(-n // max_rows))
    return told.select(F.format_string(f"{stem}_%05d.tsv.gz", F.col("id") + 1 + last).alias("file"), F.least(F.lit(max_rows), F.lit(n) - F.col("id") * max_rows).alias("n_rows"))


def write_annotated(df: DataFrame, path: str, mode: str = "append", max_rows: int = 20_000_000, rows_per_file: int = 2_000_000) -> None:
    """K4: Snappy Parquet in a folder for each allele, in files of at most about `rows_per_file` rows.

    Alleles are counted first. One of n rows more than `rows_per_file` gets n / rows_per_file salts, so it is written by
    many tasks, in files of even sizes. Rare ones lie whole in tasks of several, filled in order of their names: tasks
    follow the rows (a few for each core at least), not the number of alleles.
    """
    key, n, parts, first, salt = (unused(df, c) for c in ("allele_key", "n", "parts", "first", "salt"))
    counts = df.groupBy(F.col("allele_safe").alias(key)).agg(F.count(F.lit(1)).alias(n)).withColumn(parts, F.ceil(F.col(n) / rows_per_file))
    counts = cut(counts)
    rare, tasks = F.col(parts) == 1, 4 * df.sparkSession.sparkContext.defaultParallelism
    total, n_salts = counts.agg(F.sum(F.when(rare, F.col(n))), F.sum(F.when(~rare, F.col(parts)))).first()
    fill = min(rows_per_file, -(-(total or 1) // tasks))
    # A row an allele: salts of frequent ones are neighbours, rare ones come after them by the rows before.
    before = Window.partitionBy(rare.alias(salt)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.when(rare, F.col(n)).otherwise(F.col(parts))).over(before), F.lit(0))
    counts = counts.select(key, parts, F.when(rare, F.floor(upto / fill) + (n_salts or 0)).otherwise(upto).alias(first))
    place = (F.col(first) + F.pmod(F.xxhash64("pair_id", "allele_safe"), F.col(parts))).cast("int")
    dealt = df.join(counts, F.col("allele_safe").eqNullSafe(F.col(key))).repartitionById((n_salts or 0) + -(-(total or 1) // fill), place)
    dealt.select(*df.columns).write.mode(mode).option("maxRecordsPerFile", max_rows).partitionBy("allele_safe").parquet(path)


def fasta_record(header: Column, seq: Column, width: int | None = 60) -> Column:
    """A record's text; lines of `width` letters."""
    body = seq if width is None else F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq: str = "seq", mode: str = "error") -> None:
    """K5: FASTA text files."""
    df.select(fasta_record(F.col(id_col), F.col(seq)).alias("value")).write.mode(mode).text(path)


def write_named_files(rows: DataFrame, path: str, mode: str = "error", line: Column | None = None, dealt: bool = False) -> int:
    """Text files with names of the caller's: rows (file, at, value) are lines, in the order of `at`; how many were written.

    With `line` rows have any columns beside file and at, and are made into lines once they lie in their files' tasks, in order.
    Rows that are `dealt` lie so already, as a window over files leaves them, and don't move again.

    `file` may name folders too; an ending .bgz makes block-gzip files. A file is written by one task, line by
    line, in a file system that executors share. With mode `overwrite` files of these names are replaced; otherwise
    the folder must not exist. The format `named_files` makes all files visible when the job is done, and none if it fails.
    """
    system, root = file_system(path)
    if mode != "overwrite" and system.get_file_info(root).type != pa.fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    register_formats(rows.sparkSession)
    ordered = rows.select("file", "at", "value") if line is None else rows
    ordered = ordered if dealt else ordered.repartition("file").sortWithinPartitions("file", "at")
    lines, seen = observed(ordered.select("file", (F.col("value") if line is None else line).alias("value")), n=F.count(F.lit(1)))
    lines.write.format("named_files").mode("overwrite" if mode == "overwrite" else "append").save(path)
    return seen.get["n"]


def write_fasta_chunks(pairs: DataFrame, path: str, order: list[str], n: int = 100, per_dir: int = 50, mode: str = "error") -> None:
    """Pairs as alternating viral and human records in chunk_<d>/matched_pairs_chunk_<c>.fasta.

    `pairs` has pep, i, uniprot_viral, uniprot_human, peptide_viral and peptide_human. A file has n
    records, a folder per_dir files, both numbered from 1; `read_pair_headers` knows the chunk from the
    name. n must be even: a chunk holds whole pairs. Files appear together when the job is done (format `fasta_chunks`).
    """
    if n % 2:
        raise ValueError("an odd number of records would part a pair")
    system, root = file_system(path)
    if mode != "overwrite" and system.get_file_info(root).type != pa.fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    register_formats(pairs.sparkSession)
    row = unused(pairs, "row")
    both = F.concat_ws(
        "\n",
        fasta_record(pair_record_id("VIRAL", F.col("pep"), F.col("i"), F.col("uniprot_viral")), F.col("peptide_viral"), None),
        fasta_record(pair_record_id("HUMAN", F.col("pep"), F.col("i"), F.col("uniprot_human")), F.col("peptide_human"), None),
    )
    numbered = number_rows(pairs, order, row).select(F.col(row).alias("row"), both.alias("value"))
    dealt = numbered.repartition(F.floor(F.col("row") * 2 / n)).sortWithinPartitions("row")
    writer = dealt.write.format("fasta_chunks").option("records", n).option("per_dir", per_dir)
    writer.mode("overwrite" if mode == "overwrite" else "append").save(path)


def write_kmer_index(rows: DataFrame, path: str, mode: str = "error") -> None:
    """K7: the index's rows range-partitioned and sorted by k-mer, so lookups skip row groups by their statistics."""
    rows.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode(mode).parquet(path)


def write_ids(df: DataFrame, path: str, col: str, by: list[str] | None = None, mode: str = "error") -> None:
    """A bare list, one id a line; a folder for each value of `by`."""
    writer = df.select(*(by or []), F.col(col).cast("string").alias("value")).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).text(path)


def write_ld_tiles(triples: DataFrame, path: str, tile: int | None = None, mode: str = "error") -> None:
    """Triples in order of the tiles of the matrix, (i // tile, j // tile), in at most 256 folders that tiles are dealt to.

    `read_ld_tiles` and `subset_tiles` read it. Folders share tasks or, large ones, take several (a rebalance), so that
    files are few however many tiles there are.
    """
    dealt = with_tiles(triples, tile or TILE).hint("rebalance", "fi", "fj")
    dealt.sortWithinPartitions("fi", "fj", "ti", "tj", "i", "j").write.mode(mode).partitionBy("fi", "fj").parquet(path)


def write_matrix(matrix: DataFrame, path: str, mode: str = "error") -> None:
    """K9: a chunk's square matrix as one gz TSV with labels, in its order."""
    matrix.coalesce(1).write.mode(mode).csv(path, sep="\t", header=True, compression="gzip")


def write_matrix_blocks(lines: DataFrame, path: str, mode: str = "error") -> int:
    """K9: a square matrix of any size as files of blocks, of the lines of `matrix_blocks` or the rows of `matrix_rows`; `read_matrix` reads it.

    Rows become lines behind the shuffle. With the ending .tsv.gz the zeros take next to nothing on disk either.
    """
    return write_named_files(lines, path, mode, None if "value" in lines.columns else matrix_line())


def write_mapping(mapping: DataFrame, path: str, mode: str = "error") -> None:
    """The representatives' mapping, tab separated, in its order."""
    mapping.write.mode(mode).csv(path, sep="\t", header=True)
