"""k-mer index, peptide similarity, position frequencies, clusters of identical sequences."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.functions.sequences import ALPHABET, BLOSUM62, alignment_of_pairs, kmer_strings, upper_letters
from kinmer.operators.segments import number_in_groups
from kinmer.shared import cut

#: Windows cut from one block of a sequence.
BLOCK = 256
#: Rows of a k-mer that meet all others of it in one task.
PART = 5_000


def kmer_rows(proteins: DataFrame, k: int = 8, acc: str = "acc", seq: str = "seq") -> DataFrame:
    """(kmer, acc, pos0) of all valid k-mers; offsets are those of the windows.

    A long sequence is first cut into overlapping blocks: finding a letter by its number takes time in
    proportion to it, so windows are cut from short blocks and the cost stays linear. Letters outside
    the alphabet are blanked once for each sequence; a valid window is then one without a blank. Null
    and short sequences give none.
    """
    blanked = F.upper(F.regexp_replace(seq, f"[^{ALPHABET}{ALPHABET.lower()}]", " "))
    upper = proteins.select(F.col(acc).alias("acc"), blanked.alias("_s")).filter(F.length("_s") >= k)
    starts = F.explode(F.sequence(F.lit(0), F.length("_s") - k, F.lit(BLOCK))).alias("_b")
    blocks = upper.select("acc", "_s", starts).select("acc", "_b", F.substr("_s", F.col("_b") + 1, F.lit(BLOCK + k - 1)).alias("_s"))
    at = blocks.select("acc", "_b", "_s", F.explode(F.sequence(F.lit(0), F.length("_s") - k)).alias("_i"))
    windows = at.select(F.substr("_s", F.col("_i") + 1, F.lit(k)).alias("kmer"), "acc", (F.col("_b") + F.col("_i")).alias("pos0"))
    return windows.filter(F.instr("kmer", " ") == 0)


#: Hits or members in one row of a blocked list.
LIST_BLOCK = 1000


def kmer_index(proteins: DataFrame, k: int = 8, acc: str = "acc", seq: str = "seq", size: int = LIST_BLOCK) -> DataFrame:
    """A1: the index in blocks: (kmer, block_no, n, postings), `size` hits a block in order of protein and offset.

    `postings` has a struct for each protein of a block: acc, its first offset and the gaps to the next ones. A k-mer
    of any frequency is that many more blocks, numbered by many tasks (`number_in_groups`); `kmer_counts` is the
    directory, and `posting_rows` gives the hits back.
    """
    numbered = number_in_groups(kmer_rows(proteins, k, acc, seq), ["kmer"], ["acc", "pos0"], "at")
    at = F.array_sort(F.collect_list("pos0"))
    each = numbered.groupBy("kmer", F.floor(F.col("at") / size).alias("block_no"), "acc").agg(at.alias("p"))
    gaps = F.slice(F.zip_with(F.slice("p", F.lit(2), F.size("p")), "p", lambda b, a: b - a), F.lit(1), F.size("p") - 1)
    coded = F.struct("acc", F.get("p", 0).alias("first"), gaps.alias("gaps"))
    return each.groupBy("kmer", "block_no").agg(F.sum(F.size("p")).alias("n"), F.array_sort(F.collect_list(coded)).alias("postings"))


def posting_rows(index: DataFrame) -> DataFrame:
    """(kmer, acc, pos0) of a blocked index."""
    each = index.select("kmer", F.explode("postings").alias("x")).select("kmer", "x.*")
    places = F.transform(F.sequence(F.lit(0), F.size("gaps")), lambda i: F.col("first") + F.aggregate(F.slice("gaps", F.lit(1), i), F.lit(0), lambda s, g: s + g))
    return each.select("kmer", "acc", F.explode(places).alias("pos0"))


def kmer_counts(proteins: DataFrame, k: int = 8, acc: str = "acc", seq: str = "seq") -> DataFrame:
    """A1's counters for each k-mer, without its list: (kmer, n_hits, n_proteins)."""
    per = kmer_rows(proteins, k, acc, seq).groupBy("kmer", "acc").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("kmer").agg(F.sum("_n").alias("n_hits"), F.count(F.lit(1)).alias("n_proteins"))


def shared_kmer_pairs(peptides: DataFrame, k: int = 3, peptide: str = "peptide") -> DataFrame:
    """(a, b, jaccard) of distinct peptides a < b that share a k-mer.

    All other pairs have similarity 0 and are not made: an equi join on k-mers replaces all pairs. A
    frequent k-mer's rows are dealt into parts on one side and sent to each part on the other.
    """
    sets = peptides.select(F.col(peptide).alias("p")).dropna().distinct().select("p", F.array_distinct(kmer_strings(F.col("p"), k)).alias("_k"))
    rows = sets.select("p", F.size("_k").alias("n"), F.explode("_k").alias("kmer"))
    parts = rows.groupBy("kmer").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(parts, "kmer", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = rows.select(F.col("p").alias("a"), F.col("n").alias("n_a"), "kmer", F.pmod(F.xxhash64("p"), "parts").cast("int").alias("part"))
    right = rows.select(F.col("p").alias("b"), F.col("n").alias("n_b"), "kmer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    shared = left.join(right, ["kmer", "part"]).filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("_m"))
    return shared.select("a", "b", (F.col("_m") / (F.col("n_a") + F.col("n_b") - F.col("_m"))).alias("jaccard"))


def similar_pairs(peptides: DataFrame, threshold: float, k: int = 3, peptide: str = "peptide") -> DataFrame:
    """(a, b, jaccard) of distinct peptides a < b of at least this similarity of k-mer sets; threshold above 0.

    Prefix filter: with k-mers in order from rare to frequent, two sets of that similarity share one of the first
    n - ceil(threshold * n) + 1 of each, so frequent k-mers are hardly ever joined on. Length filter: the smaller set
    has at least threshold times the larger one's size. What is left is compared exactly.
    """
    sets = cut(peptides.select(F.col(peptide).alias("p")).dropna().distinct().select("p", F.array_distinct(kmer_strings(F.col("p"), k)).alias("k")).filter(F.size("k") > 0))
    rows = sets.select("p", F.explode("k").alias("kmer"))
    frequency = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("f"))
    ranked = F.array_sort(F.collect_list(F.struct("f", "kmer")))
    n = F.size("s")
    # A little below the threshold, so that rounding never shortens a prefix.
    kept = F.slice("s", F.lit(1), (n - F.ceil(n * (threshold - 1e-9)) + 1).cast("int"))
    first = rows.join(frequency, "kmer").groupBy("p").agg(ranked.alias("s")).select("p", n.alias("n"), F.explode(kept).alias("x")).select("p", "n", "x.kmer")
    left, right = (first.select(F.col("p").alias(c), F.col("n").alias(f"n_{c}"), "kmer") for c in "ab")
    likely = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9)) & (F.col("a") < F.col("b"))
    pairs = left.join(right, "kmer").filter(likely).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("p").alias("a"), F.col("k").alias("x")), "a").join(sets.select(F.col("p").alias("b"), F.col("k").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


#: Peptides of a block whose k-mers meet those of another in one task, and k-mers multiplied at once.
GRAM_BLOCK, GRAM_COLUMNS = 1024, 4096


def _block_pairs(names: DataFrame, block: int) -> DataFrame:
    """`names` once for each pair of blocks its own is in: (..., own, i, j), i <= j. All pairs of blocks are the definition's."""
    n_blocks = max(1, -(-names.count() // block))
    own = F.pmod(F.xxhash64("p"), F.lit(n_blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    return names.select("*", own.alias("own"), every).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _shared_sums(first: list[np.ndarray], second: list[np.ndarray], columns: int) -> np.ndarray:
    """How many codes each set of the one side shares with each of the other: a product of two incidence matrices."""
    out = np.zeros((len(first), len(second)), np.float32)

    def incidence(sets: list[np.ndarray], low: int) -> np.ndarray:
        matrix = np.zeros((len(sets), columns), np.float32)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        code = np.concatenate(sets)
        inside = (code >= low) & (code < low + columns)
        matrix[row[inside], code[inside] - low] = 1
        return matrix

    if first and second:
        for low in range(0, int(max(s.max(initial=-1) for s in [*first, *second])) + 1, columns):
            out += incidence(first, low) @ incidence(second, low).T
    return out


def mean_similarity(peptides: DataFrame, k: int = 3, peptide: str = "peptide", block: int = GRAM_BLOCK) -> DataFrame:
    """(n_sharing, mean_similarity): pairs of distinct peptides that share a k-mer, and the mean Jaccard over all pairs.

    A blocked Gram product: a task multiplies the k-mer incidence of two blocks of peptides, some columns at a time, and
    only two sums leave it. The work of a pair of blocks is the same however frequent a k-mer is; no pair is a row.
    Fewer than two peptides have a mean of 0.
    """
    sets = cut(peptides.select(F.col(peptide).alias("p")).dropna().distinct().select("p", F.array_distinct(kmer_strings(F.col("p"), k)).alias("k")))
    pairs = sets.count()
    pairs = pairs * (pairs - 1) / 2

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, codes = np.unique(np.concatenate([np.array([], object), *rows["k"]]).astype(str), return_inverse=True)
        each = np.split(codes, np.cumsum([len(x) for x in rows["k"]])[:-1])
        own = rows["own"].to_numpy()
        first = [c for c, o in zip(each, own) if o == key[0]]
        second = first if key[0] == key[1] else [c for c, o in zip(each, own) if o == key[1]]
        shared = _shared_sums(first, second, GRAM_COLUMNS).astype(np.float64)
        if key[0] == key[1]:
            shared = np.triu(shared, 1)
        sizes = np.add.outer(np.array([len(x) for x in first]), np.array([len(x) for x in second])) - shared
        jaccard = np.divide(shared, sizes, out=np.zeros_like(shared), where=shared > 0)
        return pd.DataFrame({"n": [int((shared > 0).sum())], "total": [float(jaccard.sum())]})

    sums = _block_pairs(sets, block).groupBy("i", "j").applyInPandas(total, "n long, total double")
    mean = F.coalesce(F.try_divide(F.coalesce(F.sum("total"), F.lit(0.0)), F.lit(float(pairs))), F.lit(0.0))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_sharing"), mean.alias("mean_similarity"))


def pfm(peptides: DataFrame, peptide: str = "peptide", letters: str = ALPHABET) -> DataFrame:
    """(pos, one column a letter) of distinct peptides, upper-cased, rows normalised to 1.

    Letters outside the alphabet don't count; a position with none of it has zeros.
    """
    distinct = peptides.select(upper_letters(F.col(peptide)).alias("_p")).dropna().distinct()
    at = distinct.select("_p", F.explode(F.sequence(F.lit(1), F.length("_p"))).alias("pos")).filter("length(_p) > 0")
    placed = at.select("pos", F.substr("_p", "pos", F.lit(1)).alias("_c"))
    counts = placed.groupBy("pos").agg(*[F.count_if(F.col("_c") == c).alias(c) for c in letters])
    total = sum((F.col(c) for c in letters[1:]), F.col(letters[0]))
    return counts.select("pos", *[F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)).alias(c) for c in letters])


def _same(seq: str) -> Column:
    """A digest in the place of a sequence: long ones never move."""
    return F.sha2(F.col(seq).cast("binary"), 256)


def cluster_identical(sequences: DataFrame, id_col: str = "id", seq: str = "seq", order: str = "input_pos", size: int = LIST_BLOCK) -> DataFrame:
    """(representative, block_no, members, n) of identical sequences; members in input order, the first represents.

    A cluster's members are listed in blocks of `size`; n is the cluster's size. `cluster_rows` has a row a member.
    """
    digests = sequences.select(_same(seq).alias("digest"), F.col(id_col).alias("id"), F.col(order).alias("input"))
    numbered = number_in_groups(digests, ["digest"], ["input", "id"], "at")
    counts = numbered.groupBy("digest").agg(F.min_by("id", "at").alias("representative"), F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"])
    blocks = numbered.groupBy("digest", F.floor(F.col("at") / size).alias("block_no")).agg(listed.alias("members"))
    return blocks.join(counts, "digest").select("representative", "block_no", "members", "n")


def cluster_rows(sequences: DataFrame, id_col: str = "id", seq: str = "seq", order: str = "input_pos") -> DataFrame:
    """A23 in long form, for clusters of any size: (representative, member); no list is gathered."""
    digests = sequences.select(_same(seq).alias("digest"), F.col(id_col).alias("member"), F.col(order).alias("at"))
    first = digests.groupBy("digest").agg(F.min_by("member", "at").alias("representative"))
    return digests.join(first, "digest").select("representative", "member")


def mean_alignment(peptides: DataFrame, scores: Mapping[tuple[str, str], float] = BLOSUM62, peptide: str = "peptide", block: int = 256) -> DataFrame:
    """(n_pairs, mean_score) of the alignment scores of all pairs of distinct peptides.

    All pairs are the definition, so the work is quadratic in the distinct peptides; these are dealt into
    blocks, a task holds two blocks at a time, and only sums leave it. Fewer than two peptides: no mean.
    """
    dealt = _block_pairs(cut(peptides.select(F.col(peptide).alias("p")).dropna().distinct()), block)
    score = alignment_of_pairs(scores)

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = sorted(rows["p"][rows["own"] == key[0]])
        second = sorted(rows["p"][rows["own"] == key[1]])
        found, n = 0.0, 0
        for k, a in enumerate(first):
            others = first[k + 1 :] if key[0] == key[1] else second
            if others:
                found += float(score(pd.Series([a] * len(others)), pd.Series(others)).sum())
                n += len(others)
        return pd.DataFrame({"total": [found], "n": [n]})

    sums = dealt.groupBy("i", "j").applyInPandas(total, "total double, n long")
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean_score"))
