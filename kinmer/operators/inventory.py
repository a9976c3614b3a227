"""Completeness of prediction work: what the grid expects against what the inventory holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmer.operators.common import number_rows, unused
from kinmer.shared import cut


def work_grid(chunks: DataFrame, alleles: DataFrame) -> DataFrame:
    """Every chunk with every allele. The result is the product by definition: a work list.

    The alleles, one axis of the grid and of some thousands, are one array that every chunk unfolds; nothing is joined.
    """
    row = unused(chunks, "row")
    every = alleles.agg(F.collect_list(F.struct(*alleles.columns))).scalar()
    return chunks.withColumn(row, F.explode(every)).select(*chunks.columns, *[F.col(f"{row}.`{c}`").alias(c) for c in alleles.columns])


#: Numbers in one word of a set.
WORD = 64


def _words(ids: DataFrame, keys: tuple[str, ...] = (), name: str = "bits") -> DataFrame:
    """(keys, word, bits): sets of numbers `number` as words of 64 bits; words fold in the map tasks."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD).cast("int"))
    return ids.groupBy(*keys, F.floor(F.col("number") / WORD).alias("word")).agg(F.bit_or(bit).alias(name))


def _sets(chunks: DataFrame, alleles: DataFrame, done: DataFrame, keys: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(chunk, word, every, have): the alleles wanted and done of each chunk as words; (allele, number) of the alleles."""
    chunk, allele = keys
    numbered = cut(number_rows(alleles.select(allele).dropna().distinct(), [allele], "number"))
    every = _words(numbered, name="every").agg(F.collect_list(F.struct("word", "every"))).scalar()
    wanted = chunks.select(chunk).distinct().withColumn("x", F.explode(every)).select(chunk, "x.*")
    have = _words(done.select(*keys).join(numbered, allele), (chunk,), "have")
    both = wanted.join(have, [chunk, "word"], "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return both, numbered


def missing_work(chunks: DataFrame, alleles: DataFrame, done: DataFrame, keys: tuple[str, str] = ("chunk", "allele")) -> DataFrame:
    """Combinations of chunks and alleles that are not done.

    The grid is never made: a chunk's alleles are words of 64 bits, what is done is taken out of them, and only what is
    missing is unfolded. Done rows of other chunks or alleles don't count; null chunks have nothing done.
    """
    chunk, allele = keys
    both, numbered = _sets(chunks, alleles, done, keys)
    left = both.select(chunk, "word", F.col("every").bitwiseAND(F.bitwise_not("have")).alias("left")).filter("left != 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("left", i) == 1)
    each = left.select(chunk, "word", F.explode(bits).alias("bit")).select(chunk, (F.col("word") * WORD + F.col("bit")).alias("number"))
    return each.join(numbered, "number").select(chunk, allele)


def unprocessed_batches(missing: DataFrame, chunk: str = "chunk", batch: str = "allele_chunk") -> DataFrame:
    """Batches with any allele missing, and how many."""
    return missing.groupBy(chunk, batch).agg(F.count(F.lit(1)).alias("n_missing"))


def split_done(every: DataFrame, done: DataFrame, key: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """(processed, unprocessed) rows by key."""
    ids = done.select(key).distinct()
    return every.join(ids, key, "left_semi"), every.join(ids, key, "left_anti")


def completeness(chunks: DataFrame, alleles: DataFrame, done: DataFrame, keys: tuple[str, str] = ("chunk", "allele"), complete: int | None = None) -> DataFrame:
    """Done, expected and percent for each chunk, with a status complete, partial or none.

    Complete is all alleles, or `complete` of them if that is given. Counted on the words of `missing_work`.
    """
    both, _ = _sets(chunks, alleles, done, keys)
    out = both.groupBy(keys[0]).agg(F.sum(F.bit_count("have")).alias("n_done"), F.sum(F.bit_count("every")).alias("n_expected"))
    full = F.col("n_expected") if complete is None else F.lit(complete)
    status = F.when(F.col("n_done") >= full, "complete").when(F.col("n_done") > 0, "partial").otherwise("none")
    return out.withColumns({"percent": 100 * F.col("n_done") / F.col("n_expected"), "status": status})


def having_count(done: DataFrame, n: int = 200, key: str = "chunk") -> DataFrame:
    """Keys with exactly n rows."""
    return done.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n)
