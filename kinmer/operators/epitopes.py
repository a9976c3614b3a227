"""T-cell assays and receptors: filters, joins, de-duplication and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmer.functions.names import has_items, join_sorted
from kinmer.operators.common import dedup, value_counts

# Fixed value: the human species in the OBO rendering of the NCBI taxonomy.
HUMAN = "http://purl.obolibrary.org/obo/NCBITaxon_9606"
LENGTHS = {"I": (8, 14), "II": (12, 25)}
ASSAY_COLUMNS = (
    "structure_id", "linear_sequence", "parent_source_antigen_names", "parent_source_antigen_source_org_names",
    "parent_source_antigen_source_org_iris", "mhc_allele_names", "mhc_class", "qualitative_measure", "assay_type",
    "reference_iris", "receptor_ids",
)


def filter_assays(assays: DataFrame, mhc_class: str, host: str = HUMAN, measure: str = "Positive", structure: str = "Linear peptide") -> DataFrame:
    """Assays of one class with the given host, measure and structure type, and their columns."""
    kept = assays.filter(
        (F.col("mhc_class") == mhc_class)
        & (F.col("qualitative_measure") == measure)
        & (F.col("structure_type") == structure)
        & F.array_contains("host_organism_iris", host)
    )
    return kept.select(*[c for c in ASSAY_COLUMNS if c in assays.columns])


def filter_length(df: DataFrame, lo: int, hi: int, seq: str = "linear_sequence") -> DataFrame:
    """`peptide_length` within lo..hi; null sequences go."""
    return df.withColumn("peptide_length", F.length(seq)).filter(F.col("peptide_length").between(lo, hi))


def foreign_source(df: DataFrame, iris: str = "parent_source_antigen_source_org_iris", human: str = HUMAN) -> DataFrame:
    """P5: rows with any organism that is not human; null and empty lists go."""
    return df.filter(F.coalesce(F.exists(iris, lambda x: x != human), F.lit(False)))


def with_alleles(df: DataFrame) -> DataFrame:
    """Rows that name an allele, with the flag `has_receptor`."""
    return df.filter(has_items(F.col("mhc_allele_names"))).withColumn("has_receptor", has_items(F.col("receptor_ids")))


def epitopes(assays: DataFrame, mhc_class: str) -> DataFrame:
    """The epitope table of a class with its joined name columns."""
    lo, hi = LENGTHS[mhc_class]
    rows = with_alleles(foreign_source(filter_length(filter_assays(assays, mhc_class), lo, hi)))
    return rows.withColumns(
        {
            "alleles": join_sorted(F.col("mhc_allele_names"), distinct=False),
            "organisms": join_sorted(F.col("parent_source_antigen_source_org_names")),
            "antigens": join_sorted(F.col("parent_source_antigen_names")),
        }
    )


def unique_epitopes(rows: DataFrame, keys: Sequence[str] = ("linear_sequence", "alleles")) -> DataFrame:
    """One row for each sequence and allele string, the one of the lowest structure id."""
    return dedup(rows, list(keys), ["structure_id"])


def with_chain_flags(receptors: DataFrame) -> DataFrame:
    """P25: `paired` if both chains have a CDR3, else `single_chain`."""
    both = F.col("chain_1_cdr3_sequence").isNotNull() & F.col("chain_2_cdr3_sequence").isNotNull()
    return receptors.withColumns({"paired": both, "single_chain": ~both})


def receptors_for(rows: DataFrame, receptors: DataFrame) -> DataFrame:
    """Receptors that the rows name."""
    wanted = rows.select(F.explode("receptor_ids").alias("receptor_id")).distinct()
    return receptors.join(wanted, "receptor_id", "left_semi")


def epitope_receptor(rows: DataFrame, receptors: DataFrame) -> DataFrame:
    """A row for each epitope and receptor id, repeats kept; clashing names get _epitope and _receptor."""
    left = rows.withColumn("receptor_id", F.explode("receptor_ids")).drop("receptor_ids")
    clash = (set(left.columns) & set(receptors.columns)) - {"receptor_id"}
    left = left.withColumnsRenamed({c: f"{c}_epitope" for c in clash})
    return left.join(receptors.withColumnsRenamed({c: f"{c}_receptor" for c in clash}), "receptor_id")


def unique_pairs(linked: DataFrame) -> DataFrame:
    """One row for each sequence, allele string and receptor."""
    return dedup(linked, ["linear_sequence", "alleles", "receptor_id"], ["structure_id"])


def top_items(df: DataFrame, items: str, k: int = 10) -> DataFrame:
    """The k most frequent items of an array column."""
    return value_counts(df.select(F.explode(items).alias("item")), "item").limit(k)


def length_profile(df: DataFrame, by: str = "mhc_class", length: str = "peptide_length") -> DataFrame:
    """How many rows of each class have each length."""
    return df.groupBy(by, length).agg(F.count(F.lit(1)).alias("n"))
