"""Allele lists, representatives and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmer.functions.names import allele_group
from kinmer.operators.common import number_chunks, unused


def with_names(members: DataFrame, names: DataFrame, key: str = "member") -> DataFrame:
    """`name` of each member, NA if it has none."""
    known = names.select(F.col("id").alias(key), "name").dropDuplicates([key])
    return members.join(known, key, "left").withColumn("name", F.coalesce("name", F.lit("NA")))


def attach_pseudoseq(alleles: DataFrame, pseudo: DataFrame, key: str = "id") -> DataFrame:
    """Alleles with their pseudo-sequence; unmatched ones drop."""
    return alleles.join(pseudo.select(F.col("id").alias(key), "seq"), key)


def allele_chunks(alleles: DataFrame, size: int = 30, name: str = "name") -> DataFrame:
    """Group and zero-padded chunk index of each allele, in order of name; empty groups have none."""
    grouped = alleles.withColumn("allele_group", allele_group(F.col(name)))
    chunk = unused(grouped, "chunk")
    numbered = number_chunks(grouped, size, ["allele_group"], [name], chunk)
    return numbered.withColumn("chunk_name", F.lpad(F.col(chunk).cast("string"), 3, "0")).drop(chunk)


def mapping_table(named: DataFrame, names: DataFrame) -> DataFrame:
    """K10's rows: each representative with its members and names, in member order, sorted by representative.

    `named` has representative, member, name and pos; a cluster is a list of equal pseudo-sequences
    and as short as that list is written out.
    """
    def joined(c: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c]), ",")

    lists = named.groupBy("representative").agg(joined("member").alias("Equivalent_IDs"), joined("name").alias("Equivalent_Names"))
    first = with_names(lists, names, "representative").withColumnRenamed("name", "Representative_Name")
    return first.select(F.col("representative").alias("Representative_ID"), "Representative_Name", "Equivalent_IDs", "Equivalent_Names").orderBy("Representative_ID")
