"""Column expressions on protein sequences, and the alignment score of pairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty amino acids.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# The BLOSUM62 substitution scores of the twenty amino acids, lower triangle.
_BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def _both_orders(triangle: str) -> dict[tuple[str, str], float]:
    rows = [line.split() for line in triangle.split("\n") if line]
    letters = [r[0] for r in rows]
    given = {(r[0], letters[k]): float(v) for r in rows for k, v in enumerate(r[1:])}
    return given | {(b, a): v for (a, b), v in given.items()}


BLOSUM62 = _both_orders(_BLOSUM62)


def kmers(seq: Column, k: int) -> Column:
    """H1: array<struct<pos0, kmer>> of all windows, with the window's own offset; empty if shorter than k."""
    windows = F.transform(
        F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.struct(i.alias("pos0"), F.substr(seq, i + 1, F.lit(k)).alias("kmer"))
    )
    # The guard comes first: sequence(0, -1) would count down.
    return F.when(F.length(seq) >= k, windows).otherwise(F.array().cast("array<struct<pos0:int,kmer:string>>"))


def kmer_strings(seq: Column, k: int) -> Column:
    """The k-mers alone, repeats included."""
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, windows).otherwise(F.array().cast("array<string>"))


def upper_letters(seq: Column) -> Column:
    """A-z as capitals. Other letters stay, so offsets never shift as they would where ß becomes SS."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def valid_kmer(kmer: Column) -> Column:
    """Whether only the twenty letters occur."""
    return kmer.rlike(f"^[{ALPHABET}]+$")


def cut_range(seq: Column, start: Column, end: Column) -> Column:
    """H2: 1-based inclusive [start, end]; null where the range is not one inside the sequence."""
    return F.when((start >= 1) & (end >= start) & (end <= F.length(seq)), F.substr(seq, start, end - start + 1))


def accession(header: Column) -> Column:
    """H3: the second field of a `|`-separated id, or the whole id if there is none."""
    return F.coalesce(F.get(F.split(header, r"\|"), 1), header)


def accession_or_null(header: Column) -> Column:
    """H3 without the fallback."""
    return F.get(F.split(header, r"\|"), 1)


def pair_header(header: Column) -> Column:
    """H4: struct<type, pair_id, uniprot> of `TYPE_pep_i_ACC`; null with fewer than four parts."""
    parts = F.split(header, "_")
    told = F.struct(
        F.get(parts, 0).alias("type"), F.concat_ws("_", F.get(parts, 1), F.get(parts, 2)).alias("pair_id"), F.get(parts, 3).alias("uniprot")
    )
    return F.when(F.size(parts) >= 4, told)


def peptide_id(pep: Column, acc: Column, start: Column, end: Column) -> Column:
    """`pep|acc|start-end`."""
    return F.concat(pep, F.lit("|"), acc, F.lit("|"), start, F.lit("-"), end)


def segment_id(pep: Column, acc: Column, start: Column, end: Column, similarity: Column) -> Column:
    """`pep|HUMAN_acc|start-end|sim=0.00`."""
    return F.format_string("%s|HUMAN_%s|%s-%s|sim=%.2f", pep.cast("string"), acc, start.cast("string"), end.cast("string"), similarity)


def pair_record_id(kind: str, pep: Column, i: Column, acc: Column) -> Column:
    """`VIRAL_pep_i_acc` or `HUMAN_pep_i_acc`."""
    return F.concat_ws("_", F.lit(kind), pep.cast("string"), i.cast("string"), acc)


def jaccard(a: Column, b: Column, k: int = 3) -> Column:
    """Jaccard similarity of the two k-mer sets; 0 if both are empty."""
    x, y = kmer_strings(a, k), kmer_strings(b, k)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def _align(a: list[str], b: list[str], scores: Mapping[tuple[str, str], float]) -> np.ndarray:
    """Best global alignment scores of pairs of one shape, with free gaps, all pairs in step."""
    letters = sorted({c for pair in scores for c in pair})
    code = {c: k for k, c in enumerate(letters)}
    table = np.zeros((len(letters) + 1, len(letters) + 1))  # letters without a score count as zero
    for (x, y), s in scores.items():
        table[code[x], code[y]] = s
    x, y = (np.array([[code.get(c, len(letters)) for c in s] for s in side], np.int64).reshape(len(side), -1) for side in (a, b))
    best = np.zeros((len(a), y.shape[1] + 1))
    for i in range(x.shape[1]):
        match = best[:, :-1] + table[x[:, i, None], y]
        row = np.maximum(best[:, 1:], match)
        best = np.column_stack([np.zeros(len(a)), np.maximum.accumulate(np.maximum(row, 0.0), axis=1)])
    return best[:, -1]


def alignment_of_pairs(scores: Mapping[tuple[str, str], float]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """H13 on two series: see `alignment_score`."""
    matrix = dict(scores)

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index)
        known = a.notna() & b.notna()
        shapes = pd.DataFrame({"a": a[known].str.len(), "b": b[known].str.len()})
        for (m, n), rows in shapes.groupby(["a", "b"]).groups.items():
            longest = max(m, n)
            out[rows] = _align(a[rows].tolist(), b[rows].tolist(), matrix) / longest if min(m, n) else 0.0
        return out.astype(object).where(known, None)

    return score


def alignment_score(scores: Mapping[tuple[str, str], float] = BLOSUM62) -> Callable[[Column, Column], Column]:
    """Global alignment score with zero gap cost over the longer length, for pairs of sequences.

    `scores` is the substitution matrix, both orders given. With free gaps a score is never below
    zero; two empty sequences score 0 and a null one gives null. Pairs of equal lengths are aligned
    together in numpy.
    """
    of_pairs = alignment_of_pairs(scores)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return of_pairs(a, b)

    return score
