"""Exact de-duplication: 128-bit content hash, bytes compared inside the groups, one row stays.

Plan: rows are counted by the MD5 of their text; only digests move, and copies fold in the scan's own
tasks. A filter of the digests that repeat, of bounded size (`sieve`), is tested in the scan at any number
of them: a text that fails it has no copy and never moves. Those that pass are compared by their bytes:
they are grouped by (hash, text), again folded in the scan, so a text that fills a third of the table
reaches its reducer as one row from each task, and rows share a group only if their bytes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.llm.shared import cut, text_or_empty, unused
from kinmer.llm.sieve import MOST_BITMAPS, Sieve, build_sieve


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def repeated_digests(docs: DataFrame, text: str, most: int = MOST_BITMAPS) -> Sieve:
    """A filter of the digests of texts that more than one row may have."""
    counts = docs.select(_digest(text).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return build_sieve(cut(counts.filter("n > 1").select("digest")), most)


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "largest") -> DataFrame:
    """One row for each distinct text: (_hash, _sha, keep_id, group_size).

    `_hash` is the 128-bit MD5 of the text's UTF-8 bytes, `_sha` their SHA-256. Texts that share an MD5
    are told apart by their bytes here; what is joined later is told apart by both digests.
    """
    best = F.max if keep == "largest" else F.min
    return (
        docs.select(F.col(id_col).alias("_id"), _digest(text).alias("_hash"), text_or_empty(text).alias("_text"))
        .groupBy("_hash", "_text")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), "keep_id", "group_size")
    )


def mark_exact_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "largest", most: int = MOST_BITMAPS
) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Null text counts as empty. Rows that repeat an id as well as a text all share the group; each of
    those with the kept id is `kept`, so use `drop_exact_duplicates` for one row per text. A null id
    is never kept unless its whole group has null ids (keep_id is then null and kept true). Extra
    columns of `docs` are ignored; an empty table gives an empty result.
    """
    repeated = repeated_digests(docs, text, most)
    moved = repeated.passing(docs, _digest(text))
    groups = cut(exact_groups(moved, text, id_col, keep).filter("group_size > 1"))
    sha = F.sha2(text_or_empty(text).cast("binary"), 256)
    unlike = repeated.failing(docs, _digest(text)).select(
        F.col(id_col).alias("doc_id"), F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256")
    )
    rows = moved.select(F.col(id_col).alias("doc_id"), _digest(text).alias("_hash"), sha.alias("_sha")).join(groups, ["_hash", "_sha"], "left")
    alone = F.col("group_size").isNull()
    told = rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "_sha")
    return unlike.union(told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "_sha"))


def drop_exact_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "largest", most: int = MOST_BITMAPS
) -> DataFrame:
    """The rows of `docs` that stay, one for each distinct text, with all their columns.

    A text that no other row has stays where it is. Of the others the rest of a row travels beside its
    id in the aggregation. Null text counts as empty and stays null in the row that stays. A null id
    loses to any other; rows with the same text and id are told apart by their other plain columns.
    """
    repeated = repeated_digests(docs, text, most)
    return repeated.failing(docs, _digest(text)).union(_one_of_each(repeated.passing(docs, _digest(text)), text, id_col, keep))


def _one_of_each(docs: DataFrame, text: str, id_col: str, keep: str) -> DataFrame:
    pick, null = F.max_by if keep == "largest" else F.min_by, unused(docs, "null")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(text).isNull().alias(null))
    plain = [c for c, kind in docs.dtypes if c not in (text, id_col) and "<" not in kind and kind != "variant"]
    rank = F.struct(F.col(id_col).isNotNull() if keep == "largest" else F.col(id_col).isNull(), F.col(id_col), *[F.col(f"`{c}`") for c in plain])
    kept = (
        docs.select(_digest(text).alias("_hash"), text_or_empty(text).alias("_text"), own.alias("_own"), rank.alias("_rank"))
        .groupBy("_hash", "_text")
        .agg(pick("_own", "_rank").alias("_own"))
    )
    back = F.when(~F.col(f"_own.{null}"), F.col("_text")).alias(text)
    return kept.select(*[back if c == text else F.col(f"_own.`{c}`").alias(c) for c in docs.columns])


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
