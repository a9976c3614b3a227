"""Summaries of annotated pairs: by pair, allele, protein pair and human protein."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.functions.names import hla_letter
from kinmer.operators.common import number_rows, top_k, top_n_per_group, unused, value_counts
from kinmer.operators.selection import exact_quantiles
from kinmer.schemas import BOUND, CLASSES
from kinmer.shared import cut

PAIR_KEY = ("pair_id",)


def class_counts(annotated: DataFrame, key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """Distinct alleles for each key and class; rows without a class go."""
    known = annotated.filter(F.col("Binding_Class").isNotNull())
    return known.groupBy(*key, "Binding_Class").agg(F.count_distinct("allele").alias("n_alleles"))


def pivot_classes(counts: DataFrame, key: Sequence[str] = PAIR_KEY, classes: Sequence[str] = BOUND, value: str = "n_alleles") -> DataFrame:
    """A3: a column for each class, 0 where absent. Sums under a condition, one shuffle on the key."""
    sums = [F.coalesce(F.sum(F.when(F.col("Binding_Class") == c, F.col(value))), F.lit(0)).cast("long").alias(c) for c in classes]
    return counts.groupBy(*key).agg(*sums)


def share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where the whole is."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def pair_metadata(annotated: DataFrame, key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """A5: proteins of a key sorted and joined by `;`, and one peptide each, the least in order."""
    def names(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c)

    return annotated.groupBy(*key).agg(
        names("uniprot_viral"), names("uniprot_human"), F.min("peptide_viral").alias("peptide_viral"), F.min("peptide_human").alias("peptide_human")
    )


def with_fractions(counts: DataFrame) -> DataFrame:
    """A4: alleles tested (all but Non_binder; an allele in two classes counts twice) and class fractions."""
    tested = sum((F.col(c) for c in BOUND[1:]), F.col(BOUND[0]))
    out = counts.withColumn("n_alleles_tested", tested)
    return out.withColumns({f"{c}_fraction": share(F.col(c), F.col("n_alleles_tested")) for c in BOUND})


def pair_summary(annotated: DataFrame, key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """One row for each pair: class counts, metadata, alleles tested and fractions.

    Rows without a class don't count, and pairs that have none else are absent. Counts and metadata
    are aggregated apart and joined on the pair, both already partitioned by it: folding them into one
    pass takes object aggregation at the finest grain and was measured to take twice as long. Alleles are
    made distinct first, so that their counts by class are one conditional count on the pair: a shuffle
    less than counting by class and then by pair.
    """
    known = annotated.filter(F.col("Binding_Class").isNotNull())
    once = known.select(*key, "Binding_Class", "allele").distinct()
    counts = once.groupBy(*key).agg(*[F.count(F.when(F.col("Binding_Class") == c, F.col("allele"))).alias(c) for c in BOUND])
    return with_fractions(counts.join(pair_metadata(known, key), list(key), "left"))


def pair_category(threshold: float = 0.05) -> Column:
    """Human, Viral or Mixed; the human fraction is looked at first."""
    return (
        F.when(F.col("Human_dominant_fraction") >= threshold, "Human_dominant")
        .when(F.col("Viral_dominant_fraction") >= threshold, "Viral_dominant")
        .otherwise("Mixed")
    )


def with_bias(summary: DataFrame) -> DataFrame:
    """P20: human minus viral fraction."""
    return summary.withColumn("bias_score", F.col("Human_dominant_fraction") - F.col("Viral_dominant_fraction"))


def with_flag(summary: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Whether the human fraction reaches the threshold."""
    return summary.withColumn("human_flag", F.coalesce(F.col("Human_dominant_fraction") >= threshold, F.lit(False)))


def protein_pair_summary(flagged: DataFrame, key: Sequence[str] = ("uniprot_viral", "uniprot_human")) -> DataFrame:
    """Peptides, flagged peptides and their fraction for each pair of proteins; also the summed bias where rows have one."""
    bias = [F.sum("bias_score").alias("bias")] if "bias_score" in flagged.columns else []
    return (
        flagged.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_peptides"), F.count_if("human_flag").alias("n_flagged"), *bias)
        .withColumn("flagged_fraction", F.col("n_flagged") / F.col("n_peptides"))
    )


def allele_class_table(annotated: DataFrame, key: str = "allele_safe") -> DataFrame:
    """Class counts, their total and percentages for each allele."""
    counts = annotated.groupBy(key).agg(*[F.count_if(F.col("Binding_Class") == c).alias(c) for c in CLASSES])
    out = counts.withColumn("Total", sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])))
    return out.withColumns({f"{c}_pct": 100 * share(F.col(c), F.col("Total")) for c in CLASSES})


def allele_summary_pct(annotated: DataFrame, key: str = "allele_safe") -> DataFrame:
    """Total, human and viral percentages, equivalent and non-binder counts for each allele."""
    def n(c: str) -> Column:
        return F.count_if(F.col("Binding_Class") == c)

    return annotated.groupBy(key).agg(
        F.count(F.lit(1)).alias("Total"),
        (100 * n("Human_dominant") / F.count(F.lit(1))).alias("Human_pct"),
        (100 * n("Viral_dominant") / F.count(F.lit(1))).alias("Viral_pct"),
        n("Equivalent_binding").alias("Equivalent"),
        n("Non_binder").alias("Non_binder"),
        F.min("allele").alias("allele"),
    )


def dominance(summary: DataFrame, q: float = 0.95, human: str = "Human_pct", viral: str = "Viral_pct") -> DataFrame:
    """Category of each allele against the q quantiles of both percentages (at or above).

    The summary, a row an allele, is written once; the two quantiles are read from that.
    """
    summary = cut(summary)
    found = exact_quantiles(summary, {human: [q], viral: [q]})
    h, v = found[human][0], found[viral][0]
    high_h, high_v = F.col(human) >= F.lit(h), F.col(viral) >= F.lit(v)
    category = F.when(high_h & high_v, "Dual_high").when(high_h, "Human_dominant").when(high_v, "Viral_dominant").otherwise("Neutral")
    return summary.withColumn("category", category)


def volcano_points(categorised: DataFrame, colours: dict[str, str]) -> DataFrame:
    """Colour of the category, log10(Total + 1), and a size of 40 to 100 by its share of the largest.

    `categorised` comes from `dominance`, so reading its largest total is cheap.
    """
    logs = categorised.withColumn("log_total", F.log10(F.col("Total") + 1))
    largest = F.lit(logs.agg(F.max("log_total")).first()[0])
    pairs = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    size = 40 + 60 * F.coalesce(F.try_divide(F.col("log_total"), largest), F.lit(0.0))
    return logs.withColumns({"colour": F.try_element_at(pairs, F.col("category")), "size": size})


def dense_ids(values: DataFrame, name: str) -> DataFrame:
    """(value, id): the distinct values of one column, nulls left out, numbered from 1 without gaps."""
    col = values.columns[0]
    return number_rows(values.filter(F.col(col).isNotNull()).distinct(), [col], name).withColumn(name, F.col(name) + 1)


def distinct_by_bits(df: DataFrame, keys: Sequence[str], col: str, wanted: dict[str, Column]) -> DataFrame:
    """Exact counts of distinct values of `col` by group, one for each condition of `wanted`, in one aggregation.

    Values are numbered once and become bits of Spark's bitmaps, 32768 numbers each, which fold in the map tasks; with
    several distinct counts Spark would multiply every row instead. For columns of few values: a group holds a bitmap
    for every 32768 numbers that it meets.
    """
    number, bucket, at = unused(df, "number"), unused(df, "bucket"), unused(df, "at")
    ids = dense_ids(df.select(col), number)
    rows = df.join(ids, col).withColumns({bucket: F.bitmap_bucket_number(number), at: F.bitmap_bit_position(number)})
    sets = rows.groupBy(*keys, bucket).agg(*[F.bitmap_construct_agg(F.when(c, F.col(at))).alias(n) for n, c in wanted.items()])
    return sets.groupBy(*keys).agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in wanted])


def protein_dominance(annotated: DataFrame, protein: str = "uniprot_human", peptide: str = "peptide_human", cls: str = "Human_dominant") -> DataFrame:
    """Unique dominant and total peptides, percentage, and alleles of dominant rows for each protein.

    Proteins without a dominant row have null dominant counts and a percentage of 0.
    """
    dominant = F.coalesce(F.col("Binding_Class") == cls, F.lit(False))
    # Peptides are made distinct by grouping, which folds in the map tasks; alleles, which are few, are bits.
    each = annotated.groupBy(protein, peptide).agg(F.bool_or(dominant).alias("_own"))
    peptides = each.groupBy(protein).agg(F.nullif(F.count_if(F.col("_own") & F.col(peptide).isNotNull()), F.lit(0)).alias("dominant_peptides"), F.count(peptide).alias("total_peptides"))
    alleles = distinct_by_bits(annotated.filter(dominant), [protein], "allele", {"dominant_alleles": F.lit(True)})
    out = peptides.join(alleles.withColumnRenamed(protein, "_p"), F.col(protein).eqNullSafe(F.col("_p")), "left").drop("_p")
    return out.withColumn("dominant_pct", 100 * share(F.col("dominant_peptides"), F.col("total_peptides")))


def hla_breakdown(annotated: DataFrame, protein: str = "uniprot_human", letters: str = "ABC", cls: str = "Human_dominant") -> DataFrame:
    """Distinct alleles of dominant rows by HLA type for each protein; alleles of no type drop."""
    typed = annotated.filter(F.col("Binding_Class") == cls).select(protein, "allele", hla_letter(F.col("allele"), letters, default=None, strict=True).alias("_t"))
    wanted = {f"HLA_{t}": F.col("_t") == t for t in letters} | {"total": F.lit(True)}
    return distinct_by_bits(typed.filter("_t IS NOT NULL"), [protein], "allele", wanted)


def alleles_per_peptide(annotated: DataFrame, peptide: str = "peptide_human", cls: str = "Human_dominant") -> DataFrame:
    """Distinct alleles in which each peptide dominates."""
    return annotated.filter(F.col("Binding_Class") == cls).groupBy(peptide).agg(F.count_distinct("allele").alias("n_alleles"))


def alleles_histogram(per_peptide: DataFrame) -> DataFrame:
    """How many peptides have each number of alleles."""
    return per_peptide.groupBy("n_alleles").agg(F.count(F.lit(1)).alias("n_peptides"))


def alleles_described(per_peptide: DataFrame) -> DataFrame:
    """Number of peptides, mean and largest number of alleles of one, one row."""
    return per_peptide.agg(F.count(F.lit(1)).alias("n_peptides"), F.avg("n_alleles").alias("mean"), F.max("n_alleles").alias("most"))


def top_peptides(per_peptide: DataFrame, k: int = 10, peptide: str = "peptide_human") -> DataFrame:
    """The k peptides with most alleles, ties by name."""
    return top_k(per_peptide, "n_alleles", k, peptide)


def describe_pct(df: DataFrame, col: str = "dominant_pct", above: float = 50) -> DataFrame:
    """Mean, exact median and the count above a bound, one row."""
    values = cut(df.select(col))
    median = F.lit(exact_quantiles(values, {col: [0.5]})[col][0]).cast("double")
    return values.agg(F.avg(col).alias("mean"), F.first(median).alias("median"), F.count_if(F.col(col) > above).alias("n_above"))


def richest_protein(dominance_table: DataFrame, protein: str = "uniprot_human") -> DataFrame:
    """The protein with most dominant peptides, the first by name of several."""
    return dominance_table.orderBy(F.desc_nulls_last("dominant_peptides"), protein).limit(1).select(protein)


def incidence(annotated: DataFrame, proteins: DataFrame, protein: str = "uniprot_human", peptide: str = "peptide_human", cls: str = "Human_dominant") -> DataFrame:
    """(peptide, allele, n) of dominant rows of the given proteins, in long form."""
    rows = annotated.filter(F.col("Binding_Class") == cls).join(proteins, protein, "left_semi")  # sent to all tasks if Spark finds it small
    return rows.groupBy(peptide, "allele").agg(F.count(F.lit(1)).alias("n"))


def peptides_of_protein(annotated: DataFrame, n: int = 3, protein: str = "uniprot_human", peptide: str = "peptide_human", cls: str = "Human_dominant") -> DataFrame:
    """The first n dominant peptides of each protein in order, with their allele counts."""
    rows = annotated.filter(F.col("Binding_Class") == cls).groupBy(protein, peptide).agg(F.count_distinct("allele").alias("n_alleles"))
    return top_n_per_group(rows, [protein], [peptide], n)


def protein_report(annotated: DataFrame, protein: str = "uniprot_human", peptide: str = "peptide_human", n: int = 3) -> DataFrame:
    """One line of text for each protein, from A14 and W3."""
    first = peptides_of_protein(annotated, n, protein, peptide).groupBy(protein).agg(
        F.array_sort(F.collect_list(F.concat(peptide, F.lit(" ("), "n_alleles", F.lit(" alleles)")))).alias("_first")
    )
    told = F.concat_ws(
        "; ",
        F.col(protein),
        F.format_string("%d of %d peptides dominant (%.1f%%)", F.coalesce("dominant_peptides", F.lit(0)), "total_peptides", "dominant_pct"),
        F.array_join("_first", ", "),
    )
    return protein_dominance(annotated, protein, peptide).join(first, protein, "left").select(protein, told.alias("report"))


def category_counts(summary: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pairs in each category, most first."""
    return value_counts(summary.withColumn("category", pair_category(threshold)), "category")
