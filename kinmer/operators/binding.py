"""Binding classes of viral and human peptides for each allele."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.functions.names import chunk_no, hla_letter, safe_allele


def number(col: Column | str) -> Column:
    """A double with NaN as null, so that comparisons with it are false as in the source data's rules."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(value), value)


def delta(viral: str = "BA_score_viral", human: str = "BA_score_human") -> Column:
    """Viral minus human score. Positive is called human-dominant below; the sign is the source's."""
    return number(viral) - number(human)


def binding_class(
    require: str = "viral",
    edge: str = "dominant",
    max_rank: float = 2.0,
    threshold: float = 0.5,
    difference: Column | None = None,
    rank_viral: str = "BA_Rank_viral",
    rank_human: str = "BA_Rank_human",
) -> Column:
    """The class of a row.

    require: whose rank must be at most `max_rank`, `viral` or `both`. edge: what a difference of
    exactly the threshold is, `dominant` or `equivalent`. Missing ranks or scores give Non_binder.
    Presets: P18a viral/dominant, P18b viral/equivalent, P18c both/equivalent.
    """
    d = delta() if difference is None else difference
    binds = number(rank_viral) <= max_rank
    if require == "both":
        binds &= number(rank_human) <= max_rank
    human, viral = (d >= threshold, d <= -threshold) if edge == "dominant" else (d > threshold, d < -threshold)
    return (
        F.when(binds & human, "Human_dominant")
        .when(binds & viral, "Viral_dominant")
        .when(binds & (F.abs(d) <= threshold), "Equivalent_binding")
        .otherwise("Non_binder")
    )


def annotate(
    wide: DataFrame, require: str = "viral", edge: str = "dominant", k: int = 9, mhc_type: str = "I", colon: bool = False
) -> DataFrame:
    """The long annotated table of pair and allele, from the wide prediction table.

    The safe allele name keeps its colons by default, as existing datasets of this layout do.
    """
    source = F.col("source_file_human_human") if "source_file_human_human" in wide.columns else F.lit(None).cast("string")
    return wide.select(
        "pair_id",
        "uniprot_viral",
        "uniprot_human",
        F.col("Peptide_viral").alias("peptide_viral"),
        F.col("Peptide_human").alias("peptide_human"),
        F.lit("human").alias("prot2_origin"),
        F.col("Allele").alias("allele"),
        number("BA_score_viral").alias("BA_score_viral"),
        number("BA_score_human").alias("BA_score_human"),
        delta().alias("BA_score_diff"),
        number("BA_Rank_viral").alias("BA_Rank_viral"),
        number("BA_Rank_human").alias("BA_Rank_human"),
        binding_class(require, edge).alias("Binding_Class"),
        safe_allele(F.col("Allele"), colon).alias("allele_safe"),
        chunk_no(source).alias("chunk_source"),
        F.lit(f"{k}-mer").alias("k_mer"),
        F.lit(mhc_type).alias("mhc_type"),
        hla_letter(F.col("Allele"), "ABC").alias("hla_class"),
    )
