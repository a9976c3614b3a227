"""Binding predictions: zip with headers, count guard, viral rows joined to human rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmer.operators.hits import drop_identical


def guard_counts(predictions: DataFrame, headers: DataFrame, file: str = "source_file", chunk: str = "chunk") -> DataFrame:
    """Prediction files with as many rows as their chunk has header records, whole files only."""
    have = predictions.groupBy(file, chunk).agg(F.count(F.lit(1)).alias("_n"))
    want = headers.groupBy(chunk).agg(F.count(F.lit(1)).alias("_n"))
    return predictions.join(have.join(want, [chunk, "_n"]).select(file).hint("shuffle_hash"), file, "left_semi")  # names are hashed, rows stream by


def zip_with_headers(predictions: DataFrame, headers: DataFrame, chunk: str = "chunk") -> DataFrame:
    """The n-th prediction of a file with the n-th record of the chunk of the same number."""
    return predictions.join(headers, [chunk, "row_no"])


def pair_predictions(
    zipped: DataFrame, file: str = "source_file", allele: str = "Allele", extra_key: tuple[str, ...] = ()
) -> DataFrame:
    """Viral rows joined to human rows of the same file, pair and allele; other columns get suffixes.

    A pair that repeats gives every combination within its file. `extra_key` narrows the key.
    """
    keys = [file, "pair_id", allele, *extra_key]
    rest = [c for c in zipped.columns if c not in (*keys, "type")]

    def side(kind: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{kind.lower()}") for c in rest]
        return zipped.filter(F.upper("type") == kind).select(*keys, *named)

    return side("VIRAL").join(side("HUMAN"), keys)


def drop_identical_peptides(pairs: DataFrame) -> DataFrame:
    """P10: pairs whose peptides differ; one missing counts as different."""
    return drop_identical(pairs, "Peptide_viral", "Peptide_human", keep_nulls=True)


def keep_candidates(df: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the candidates' first column."""
    wanted = candidates.select(F.col(candidates.columns[0]).alias(key)).distinct()
    return df.join(wanted, key, "left_semi")
