"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's tokens are cut at multiples of the capacity; the full pieces fill a sequence each and
the rest is packed. Tokens stay in the task that makes them: only a piece's numbers are shuffled.
Groups are drawn by hash and hold about the same few thousand documents at any table size, so the
tree of a group fits in cache and no group grows with the table.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
DOCS_PER_GROUP = 2000
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long, place long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def byte_bpe(path: str | None = None) -> Callable[[str], list[int]]:
    """Encoder of the byte-level BPE vocabulary with 50,257 ids, loaded once a worker.

    The rank file holds the same vocabulary as the tokenizers file of that name; its one special
    token is recognised inside texts, as that library does. Texts that tiktoken's expression engine
    gives up on (runs of about a million white-space characters) are encoded by that library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )
    library = functools.cache(lambda: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))

    def encode(text: str) -> list[int]:
        try:
            return coder.encode(text, allowed_special="all")
        except ValueError:
            return library().encode(text, add_special_tokens=False).ids

    return encode


class TournamentTree:
    """Largest free capacity of any bin below each node; finds the first bin that fits in log time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, free capacity before) of the first bin that holds `length`; takes the room."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        before = free[at]
        free[at] = before - length
        where = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return where, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length, none of them over the capacity; equal lengths in input order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = TournamentTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        where, before = tree.place(int(lengths[i]))
        bins[i], offsets[i] = where, capacity - before
    return bins, offsets


def pieces(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Each document's tokens and the end id, cut into pieces of at most `capacity`: PIECE columns.

    `place` is that of the document's row in its task's input, which tells rows apart that are equal in all else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, body, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.array(encode(body.as_py() or "") + [END_ID], "<u4")
                salt = zlib.crc32(ids)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((doc_id, start, len(part), zlib.crc32(part), len(ids), salt, place))
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names)

    place = F.monotonically_increasing_id().alias("place")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), place).mapInArrow(run, PIECE)


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY, seed: int = 42) -> DataFrame:
    """Sequences for `pieces`, each group packed on its own: PACKED columns."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "salt", "ids_crc32"], kind="stable", ignore_index=True)
        rows["sequence_id"], rows["offset"] = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] += key[0] << 32
        return rows[[c.split()[0] for c in PACKED.split(", ")]]

    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "salt", "place"), F.lit(groups)).alias("group")
    return pieces.select("*", group).groupBy("group").applyInPandas(run, PACKED)


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    capacity: int = CAPACITY,
    docs_per_group: int = DOCS_PER_GROUP,
    n_docs: int | None = None,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every document, the end id included, lies in exactly one piece; null and empty
    texts are the end id alone. Offsets in a sequence have no gaps. sequence_id is the group's
    number times 2^32 plus the bin's. Rows that repeat are packed each by itself, in groups drawn by
    their places too, so that no number of equal rows makes a group large. Extra columns are ignored; an empty table gives an empty result.
    """
    n = docs.count() if n_docs is None else n_docs
    return pack(pieces(docs, text, id_col, capacity), max(1, math.ceil(n / docs_per_group)), capacity)
