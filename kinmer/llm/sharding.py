"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows are dealt by hash to source partitions of about the same size.
2. How many rows each source sends to each shard is drawn exactly, as a uniform permutation of all
   rows would have it: rows of a multivariate hypergeometric matrix whose column sums are the shard
   sizes. The matrix has a bounded number of entries whatever the table.
3. Each source permutes its rows (rank of a random key) and cuts them at the matrix's row.
4. Rows are exchanged, and each shard permutes again: a second key's rank, in blocks so that no
   shard is one task; a block's first slot is the sum of the blocks before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmer.llm.shared import cut

SHARDS = 24
ROWS_PER_PART = 1000
#: Most source partitions, and most blocks over all shards: bounds the matrix and what is broadcast.
MAX_PARTS = 1 << 16


def communication_matrix(parts: list[int], shards: int, seed: int = 42) -> np.ndarray:
    """(len(parts), shards) counts: rows sum to `parts`, columns to sizes at most one apart."""
    total, rng = sum(parts), np.random.default_rng(seed)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(parts), shards), np.int64)
    for p, n in enumerate(parts):
        ahead = int(left.sum())
        for s in range(shards):
            ahead -= int(left[s])
            out[p, s] = _draw(rng, int(left[s]), ahead, n)
            n -= int(out[p, s])
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw. Urns beyond numpy's limit of 1e9 are drawn by inverting the distribution
    over 40 standard deviations each side of its mean, which holds all of it in double precision."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    wide = 40 * math.sqrt(n * share * (1 - share)) + 40
    low, high = max(0, n - bad, int(n * share - wide)), min(n, good, int(n * share + wide))
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - x) * (n - x)) - np.log((x + 1) * (bad - n + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    odds = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))


def _rank(by: list[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def shuffle_into_shards(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = SHARDS, seed: int = 42
) -> DataFrame:
    """One row per input row: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is `rows`: shard counts differ by at most one, and each assignment with these counts is
    as likely as any other under the hash. size is the text's UTF-8 bytes plus 8 (null: 8), slot
    runs from 0 without gaps in each shard. Copies of a text are placed independently of each other.
    A row's place in the written table is part of its keys, so rows that repeat entirely are dealt like
    any others. Null ids are ordinary values; extra columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    n = rows.count()
    parts = min(MAX_PARTS, max(1, math.ceil(n / ROWS_PER_PART)))
    blocks = max(1, parts // shards)

    def key(k: int) -> Column:
        return F.xxhash64(F.lit(seed + k), "doc_id", "size", "text_crc32", "at")

    dealt = rows.select("*", F.pmod(key(0), F.lit(parts)).cast("int").alias("part"))
    counts = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    matrix = communication_matrix([c for _, c in counts], shards, seed)
    ends = [(p, row) for (p, _), row in zip(counts, np.cumsum(matrix, axis=1).tolist())]
    ends_df = docs.sparkSession.createDataFrame(ends, "part int, ends array<long>")

    ranked = dealt.select("*", key(1).alias("k1")).select("*", _rank(["part"], "k1", "at").alias("r"))
    shard = sum(((F.col("r") >= F.col("ends")[s]).cast("int") for s in range(shards - 1)), F.lit(0))
    sent = ranked.join(F.broadcast(ends_df), "part").select(
        "doc_id", "size", "text_crc32", "at", shard.cast("int").alias("shard"), key(2).alias("k2")
    )
    # The block is the key's rank among equal ranges, so blocks in order are the keys in order.
    block = F.floor((F.shiftright(F.col("k2"), 20) + (1 << 43)) * blocks / (1 << 44)).cast("int")
    sent = cut(sent.select("*", block.alias("block")))
    sizes = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = sent.select("*", _rank(["shard", "block"], "k2", "at").alias("r"))
    return placed.join(F.broadcast(firsts), ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first") + F.col("r")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
