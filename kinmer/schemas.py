"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
STRINGS = T.ArrayType(S)

HITS = _struct(
    qseqid=S, sseqid=S, pident=D, length=I, mismatch=I, gapopen=I, qlen=I, slen=I, qstart=I, qend=I, sstart=I, send=I,
    evalue=D, bitscore=D,
)
ID_MAPPING = _struct(Original_ID=S, Mapped_ID=S)
WIDE = _struct(
    pair_id=S, Allele=S, uniprot_viral=S, uniprot_human=S, Peptide_viral=S, Peptide_human=S, source_file_human_human=S,
    BA_score_viral=D, BA_score_human=D, BA_Rank_viral=D, BA_Rank_human=D,
)
GWAS_P = _struct(variant=S, pval=D)
LD_INDEX = _struct(chr=S, pos=L, ref=S, alt=S, idx=L)
LD_TRIPLES = _struct(pop=S, i=L, j=L, r=D)
TCELL = _struct(
    structure_id=L, linear_sequence=S, structure_type=S, parent_source_antigen_names=STRINGS,
    parent_source_antigen_source_org_names=STRINGS, parent_source_antigen_source_org_iris=STRINGS, host_organism_names=S,
    host_organism_iris=STRINGS, mhc_allele_names=STRINGS, mhc_class=S, qualitative_measure=S, assay_type=S,
    reference_iris=STRINGS, receptor_ids=T.ArrayType(L),
)

CLASSES = ("Equivalent_binding", "Human_dominant", "Non_binder", "Viral_dominant")
#: Classes in which a binding event took place; the others don't count as tested.
BOUND = ("Equivalent_binding", "Human_dominant", "Viral_dominant")
