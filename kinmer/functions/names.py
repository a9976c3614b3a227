"""Column expressions on alleles, variants, file names and array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hla_letter(allele: Column, letters: str = "ABC", upper: bool = True, default: str | None = "Unknown", strict: bool = False) -> Column:
    """H6: the HLA type letter of an allele name, `default` if there is none.

    strict takes `HLA-` in capitals only; otherwise case and the separator are free.
    """
    last = max(letters)
    found = F.regexp_extract(allele, f"HLA-([A-{last}])" if strict else f"(?i)HLA[-_: ]?([A-{last}])", 1)
    found = F.nullif(F.upper(found) if upper else found, F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def safe_allele(allele: Column, colon: bool = True) -> Column:
    """H7: `*` and, unless colon is false, `:` as underscores."""
    return F.translate(allele, "*:" if colon else "*", "__" if colon else "_")


def allele_group(name: Column) -> Column:
    """HLA-A, HLA-B or HLA-C by prefix, else HLA-others."""
    out = F.lit("HLA-others")
    for prefix in ("HLA-C", "HLA-B", "HLA-A"):
        out = F.when(name.startswith(prefix), prefix).otherwise(out)
    return out


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """H8: `chr:pos:ref:alt`."""
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def parse_variant(variant: Column) -> Column:
    """H8: struct<chr, pos, ref, alt>; fields that are missing or no number are null."""
    part = F.split(variant, ":")
    return F.struct(
        F.get(part, 0).alias("chr"), F.get(part, 1).try_cast("long").alias("pos"), F.get(part, 2).alias("ref"), F.get(part, 3).alias("alt")
    )


def chunk_no(name: Column) -> Column:
    """H5: the number after the first `chunk_`; null without one."""
    return F.nullif(F.regexp_extract(name, r"chunk_(\d+)", 1), F.lit("")).cast("int")


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def parse_list_name(name: Column) -> Column:
    """struct<trait, threshold> of names like `trait_p0.01.txt`; the allele of `ALLELE_matched_...` is `allele`."""
    return F.struct(
        F.nullif(F.regexp_extract(name, r"^(.*?)_p?[0-9.]+\.txt", 1), F.lit("")).alias("trait"),
        F.nullif(F.regexp_extract(name, r"_p?([0-9]+(?:\.[0-9]+)?)\.txt", 1), F.lit("")).try_cast("double").alias("threshold"),
        F.when(name.contains("_matched_"), F.substring_index(name, "_matched_", 1)).alias("allele"),
    )


def join_sorted(items: Column, distinct: bool = True, sep: str = "|") -> Column:
    """Array items sorted, without repeats if `distinct`, joined; null gives an empty string."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(items) if distinct else items), sep), F.lit(""))


def has_items(items: Column) -> Column:
    """Whether an array has items; null has none."""
    return F.coalesce(F.size(items) > 0, F.lit(False))
