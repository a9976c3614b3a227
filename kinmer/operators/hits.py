"""Alignment hits: similarity, retired accessions, sequences, positional k-mer pairs, peptides cut from proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.functions.sequences import accession, accession_or_null, cut_range, upper_letters
from kinmer.operators.common import unused


def with_similarity(hits: DataFrame) -> DataFrame:
    """Identity weighted by coverage, in this order of evaluation, and the subject's accession."""
    return hits.withColumns(
        {
            "similarity": F.col("pident") * (F.col("length") / F.col("qlen")),
            "hu_prot_id": accession_or_null(F.col("sseqid")),
        }
    )


def filter_similarity(hits: DataFrame, lo: float = 75, hi: float = 95) -> DataFrame:
    """Lo <= similarity <= hi; null similarity goes."""
    return hits.filter(F.col("similarity").between(lo, hi))


def drop_retired(hits: DataFrame, retired: DataFrame, key: str = "hu_prot_id") -> DataFrame:
    """Rows whose accession is not in the retired list's first column; a null accession stays."""
    name = unused(hits, "retired")
    gone = retired.select(F.col(retired.columns[0]).alias(name)).distinct()
    return hits.join(gone, F.col(key) == F.col(name), "left_anti")


def drop_reversed(hits: DataFrame) -> DataFrame:
    """Alignments that run forwards."""
    return hits.filter("sstart <= send")


def lookup_sequences(proteins: DataFrame) -> DataFrame:
    """S1's lookup form: one sequence for each accession, of duplicates the last record."""
    return proteins.groupBy("acc").agg(F.max_by("seq", "rec_no").alias("seq"))


def attach_sequence(hits: DataFrame, proteins: DataFrame, key: str = "hu_prot_id") -> tuple[DataFrame, DataFrame]:
    """(hits with `seq`, distinct keys that have no sequence)."""
    named = proteins.select(F.col("acc").alias(key), "seq")
    return hits.join(named, key), hits.select(key).distinct().join(named, key, "left_anti")


def _peptide(name: Column) -> Column:
    """The peptide's own id: the first field of `pep|acc|start-end`."""
    return F.get(F.split(name.cast("string"), r"\|"), 0)


def attach_both(hits: DataFrame, peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Hits with `pep` and `uniprot_viral` out of the query's id `pep|acc|...`, and both sequences.

    The subject's accession is `hu_prot_id` if that is there, else the second field of sseqid or all of
    it. Peptides are known by the first field of their id too. Rows missing either sequence go.
    """
    named = hits.withColumns({"pep": _peptide(F.col("qseqid")), "uniprot_viral": accession_or_null(F.col("qseqid").cast("string"))})
    if "hu_prot_id" not in hits.columns:
        named = named.withColumn("hu_prot_id", accession(F.col("sseqid")))
    viral = peptides.select(_peptide(F.col("id")).alias("pep"), F.col("seq").alias("seq_viral"))
    human = proteins.select(F.col("acc").alias("hu_prot_id"), F.col("seq").alias("seq_human"))
    return named.join(viral, "pep").join(human, "hu_prot_id").filter("seq_viral != '' AND seq_human != ''")


def resolve_ids(df: DataFrame, mapping: DataFrame, key: str = "UniProt_acc") -> DataFrame:
    """`resolved`, the mapped accession or the original."""
    known = mapping.select(F.col("Original_ID").alias(key), "Mapped_ID").dropDuplicates([key])
    return df.join(known, key, "left").withColumn("resolved", F.coalesce("Mapped_ID", key)).drop("Mapped_ID")


def cut_peptides(meta: DataFrame, proteins: DataFrame, key: str = "UniProt_acc") -> tuple[DataFrame, DataFrame]:
    """(rows with their `peptide`, failures with a `reason`)."""
    seq = unused(meta, "seq")
    named = proteins.select(F.col("acc").alias(key), F.col("seq").alias(seq))
    peptide = cut_range(F.col(seq), F.col("start"), F.col("end"))
    missing = F.col(seq).isNull() | (F.col(seq) == "")
    reason = F.when(missing, "Sequence not found").when(peptide.isNull(), "Out of bounds")
    cut = meta.join(named, key, "left").select(*meta.columns, peptide.alias("peptide"), reason.alias("reason"))
    return cut.filter("reason IS NULL").drop("reason"), cut.filter("reason IS NOT NULL").drop("peptide")


def positional_pairs(hits: DataFrame, k: int = 9, align_query: bool = False) -> DataFrame:
    """k-mer pairs of hits with seq_viral and seq_human: the n-th window of each side, from 1.

    The human side is the slice sstart..send. The viral side starts at the peptide's first letter,
    or at qstart with align_query. Hits whose slice or peptide is shorter than k give none.
    """
    first = F.col("qstart") if align_query else F.lit(1)
    viral = upper_letters(F.substr("seq_viral", first, F.length("seq_viral")))
    human = upper_letters(F.substr("seq_human", F.col("sstart"), F.col("send") - F.col("sstart") + 1))
    v, h, n = (unused(hits, c) for c in ("viral_side", "human_side", "n_windows"))
    sides = drop_reversed(hits).withColumns({v: viral, h: human})
    at = F.explode(F.sequence(F.lit(1), F.col(n))).alias("i")
    dealt = sides.withColumn(n, F.least(F.length(v), F.length(h)) - k + 1).filter(F.col(n) >= 1).select("*", at)
    return dealt.withColumns(
        {
            "pair_id": F.concat_ws("_", _peptide(F.col("qseqid")), F.col("i").cast("string")),
            "peptide_viral": F.substr(v, F.col("i"), F.lit(k)),
            "peptide_human": F.substr(h, F.col("i"), F.lit(k)),
        }
    ).drop(v, h, n)


def drop_identical(pairs: DataFrame, a: str = "peptide_viral", b: str = "peptide_human", keep_nulls: bool = False) -> DataFrame:
    """Pairs that differ; with keep_nulls also those missing a side (and case counts)."""
    x, y = (F.col(a), F.col(b)) if keep_nulls else (upper_letters(F.col(a)), upper_letters(F.col(b)))
    return pairs.filter(F.coalesce(x != y, F.lit(keep_nulls)))


def identical(a: str = "peptide_viral", b: str = "peptide_human") -> Column:
    """P9's count, as a metric for `observed` or an aggregate."""
    return F.count_if(upper_letters(F.col(a)) == upper_letters(F.col(b)))
