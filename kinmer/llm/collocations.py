"""Collocations: phrases whose words occur together more often than their parts let expect.

Top-order marginalisation: of all n-grams only the longest windows are counted. Each word position gives
one window, the word and its leads (the next words of its piece, shifted columns), padded where the piece
ends. Every occurrence of a shorter phrase is the prefix of just one window, so its count is a sum over
windows: Spark's ROLLUP makes the sums for all shorter prefixes, and no n-gram of lower order is exploded.

Plan, three steps, each a shuffle of packed tables (distinct keys with their counts, Arrow and zstd, some ten
bytes a row, where rows of strings would take four times that):

1. A task counts the windows of some megabytes of text and deals the distinct ones out by all their words.
2. A group of windows, a bounded share of the corpus, is summed: those that reach the least count go out,
   and the sums over the last word are dealt out by the words before it.
3. These are summed. A prefix that can't reach the least count is folded into the shorter ones, so that
   what ROLLUP moves is small.

Keys are dealt by a hash of all their words in each step, and a key is one row from each task or group, so
no word, however frequent, makes a group large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmer.llm.shared import cut
from kinmer.llm.tokens import classes, cut_words, row_chunks

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
GAPS = " \t"
#: Bytes of text whose windows are counted together in a task.
CHUNK = 8 << 20
#: Bytes of text whose windows, wherever they occur, are summed together.
GROUP = 6 << 20
ROWS_AT_ONCE = 100_000


def _release() -> None:
    """Give memory that Arrow keeps for later back to the system: workers live on, and wait beside other stages' tasks."""
    pa.default_memory_pool().release_unused()


def _hashes(names: pa.Array) -> np.ndarray:
    """A number for each word by its letters, the same in every task; equal numbers do no harm."""
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    ends = ends - ends[0]
    size = np.diff(ends)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers[np.arange(len(data)) - np.repeat(ends[:-1], size)], dtype=np.uint64)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _parts(hashes: list[np.ndarray], parts: int) -> np.ndarray:
    """The part of each row, by the hashes of its words."""
    mixed = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        mixed = (mixed ^ h) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(parts)).astype(np.int64)


def _pack(names: pa.Array, keys: list[np.ndarray], n: np.ndarray, place: np.ndarray) -> bytes:
    """Rows of words, given by their places in `names`, and counts, as one compressed Arrow batch; `place` is room for a number for each name."""
    there = np.zeros(len(names), bool)
    for k in keys:
        there[k] = True
    used = np.flatnonzero(there)
    place[used] = np.arange(len(used), dtype=np.int32)
    columns = [names.take(pa.array(used)), *[pa.array(place[k]) for k in keys], pa.array(n)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    batch = pa.RecordBatch.from_arrays(lists, ["names", *[f"k{k}" for k in range(len(keys))], "n"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(blobs: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """What `_pack` packed, of all blobs together over one table of names."""
    names, keys, counts, first = [], [], [], 0
    for blob in blobs:
        batch = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
        own, *codes, n = (c.flatten() for c in batch.columns)
        names.append(own)
        keys.append([c.to_numpy() + first for c in codes])
        counts.append(n.to_numpy())
        first += len(own)
    coded = pa.concat_arrays(names).dictionary_encode()
    place = coded.indices.to_numpy()
    return coded.dictionary, [place[np.concatenate(k)] for k in zip(*keys)], np.concatenate(counts)


def _sums(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Each combination of keys once, in their order, with the sum of its counts, or how often it is there."""
    if not len(keys[0]):
        return keys, np.zeros(0, np.int64)
    there = np.zeros(int(keys[0].max()) + 1, bool)  # languages are few: their numbers are made small
    there[keys[0]] = True
    few = np.flatnonzero(there).astype(np.int32)
    keys = [(np.cumsum(there) - 1)[keys[0]], *keys[1:]]
    bits = [max(1, int(k.max()).bit_length()) for k in keys]
    if sum(bits) > 63:
        names = [f"k{k}" for k in range(len(keys))]
        table = pa.table({**dict(zip(names, keys)), "n": np.ones(len(keys[0]), np.int64) if n is None else n})
        found = table.group_by(names, use_threads=False).aggregate([("n", "sum")]).sort_by([(k, "ascending") for k in names])
        first, *rest = (found[k].combine_chunks().to_numpy() for k in names)
        return [few[first], *rest], found["n_sum"].combine_chunks().to_numpy()
    one = np.zeros(len(keys[0]), np.int64)  # all keys in one number
    for key, size in zip(keys, bits):
        one <<= size
        one |= key
    if n is None:
        one.sort()
    else:
        order = np.argsort(one)
        one, n = one[order], n[order]
    first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    sums = np.diff(np.append(first, len(one))) if n is None else np.add.reduceat(n, first)
    one, out = one[first], []
    for size in reversed(bits):
        out.append((one & ((1 << size) - 1)).astype(np.int32))
        one >>= size
    out[-1] = few[out[-1]]
    return out[::-1], sums


def _dealt(names: pa.Array, keys: list[np.ndarray], n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of all rows; they stay in order within each."""
    hashes = _hashes(names)
    part = _parts([hashes[k] for k in keys], parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    keys, n, part = [k[order] for k in keys], n[order], part[order]
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else []
    place = np.empty(len(names), np.int32)
    for first, end in zip([0, *ends[:-1]], ends):
        yield int(part[first]), _pack(names, [k[first:end] for k in keys], n[first:end], place)


def packed_windows(docs: DataFrame, longest: int, parts: int, text: str = "text", lang: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """(part, blob): the distinct windows of each stretch of text with their counts; a pad is an empty word."""
    kinds = classes(GAPS, SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in row_chunks(batch.column(1), chunk):
                cuts = cut_words(batch.column(1).slice(first, end - first), kinds)
                n = len(cuts.row)
                if not n:
                    continue
                langs = batch.column(0).slice(first, end - first).dictionary_encode()
                words = cuts.words.dictionary_encode()
                code, pad = words.indices.to_numpy(), len(words.dictionary)
                leads = [langs.indices.to_numpy()[cuts.row] + pad + 1]
                for k in range(longest):
                    lead = np.full(n, pad, np.int32)
                    if k < n:
                        goes_on = np.flatnonzero(cuts.piece[k:] == cuts.piece[: n - k])
                        lead[goes_on] = code[goes_on + k]
                    leads.append(lead)
                names = pa.concat_arrays([words.dictionary.cast(pa.large_string()), pa.array([""], pa.large_string()), langs.dictionary.cast(pa.large_string())])
                rows = list(_dealt(names, *_sums(leads), parts))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["part", "blob"])
                del cuts, langs, words, code, leads, names, rows
                _release()

    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "part long, blob binary")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang", chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(lang, w1, ..., words, n): every phrase of up to `longest` words with n >= least, and with 0 words each language's n.

    Of a phrase of k words the columns after wk are null.
    """
    *prefix, last = columns = [f"w{k + 1}" for k in range(longest)]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, math.ceil(size / group))
    prefix_parts = max(1, math.ceil(parts / 3))  # of about as many rows as those of windows, since prefixes are fewer and counted once a group

    def out(names: pa.Array, keys: list[np.ndarray], n: np.ndarray, empty: int = 0) -> list[pa.Array]:
        """Columns of words, those of the shorter phrases' missing words null."""
        return [names.take(pa.array(k)).cast(pa.string()) for k in keys] + [pa.nulls(len(n), pa.string())] * empty + [pa.array(n)]

    def whole(table: pa.Table) -> pa.Table:
        names, keys, n = _unpack(table["blob"])
        keys, n = _sums(keys, n)
        _release()
        pad = names.index(pa.scalar("", names.type)).as_py()
        full = np.flatnonzero((n >= least) & (keys[-1] != pad))
        shorter = list(_dealt(names, *_sums(keys[:-1], n), prefix_parts))
        told = out(names, [k[full] for k in keys], n[full])
        told = [pa.concat_arrays([c, pa.nulls(len(shorter), c.type)]) for c in told]
        part = pa.array([None] * len(full) + [p for p, _ in shorter], pa.int64())
        return pa.table([*told, part, pa.array([None] * len(full) + [b for _, b in shorter], pa.binary())], ["lang", *columns, "n", "part", "blob"])

    def prefixes(table: pa.Table) -> pa.Table:
        names, keys, n = _unpack(table["blob"])
        keys, n = _sums(keys, n)
        _release()
        names, pad = pa.concat_arrays([names, pa.array([""], names.type)]), len(names)
        # A prefix too rare to count stands for its first words only.
        keys, n = _sums([*keys[:-1], np.where(n >= least, keys[-1], pad)], n)
        return pa.table(out(names, keys, n), ["lang", *prefix, "n"])

    kinds = ", ".join(f"{c} string" for c in ["lang", *columns])
    # Both uses of these share the shuffle below them.
    windows = packed_windows(docs, longest, parts, text, lang, chunk).groupBy("part").applyInArrow(whole, f"{kinds}, n long, part long, blob binary")
    full = windows.filter("blob IS NULL").select("lang", *columns, F.lit(longest).alias("words"), "n")
    kept = windows.filter("blob IS NOT NULL").select("part", "blob").groupBy("part").applyInArrow(prefixes, ", ".join(f"{c} string" for c in ["lang", *prefix]) + ", n long")
    sums = kept.rollup("lang", *prefix).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    words = reduce(lambda so_far, k: F.when(F.col("level") == (1 << (len(prefix) - k)) - 1, k).otherwise(so_far), range(len(prefix) + 1), F.lit(-1))
    ends_in_pad = F.coalesce(F.try_element_at(F.filter(F.array(*prefix), lambda w: w.isNotNull()), F.lit(-1)) == "", F.lit(False))
    shorter = sums.select("lang", *prefix, F.lit(None).cast("string").alias(last), words.cast("int").alias("words"), "n")
    shorter = shorter.filter((F.col("words") == 0) | ((F.col("words") > 0) & (F.col("n") >= least) & ~ends_in_pad))
    return cut(full.union(shorter))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits, which hold it up to counts of 10^16."""
    big = "decimal(38,0)"
    part = F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)") * a.cast("decimal(16,0)")
    return F.call_function("div", part.cast(big), (left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).cast(big))


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, text: str = "text", lang: str = "lang", chunk: int = CHUNK, group: int = GROUP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    A phrase with a = f(phrase) >= least is a candidate; of its cuts in two the one of the lowest score counts,
    the first of several. A candidate inside a longer one that has `covered` percent of its occurrences or more
    drops out. Null texts count as empty, a null language as `und`; empty texts and an empty table give no rows.
    Ids are not looked at: rows that repeat count each time. Texts of any length are counted whole.
    """
    counts = phrase_counts(docs, longest, least, text, lang, chunk, group)
    columns = [f"w{k + 1}" for k in range(longest)]

    def of(size: int, at: int, name: str) -> DataFrame:
        """Counts of phrases of this size, keyed as the words from place `at` on."""
        keys = [F.col(columns[k]).alias(columns[at + k]) for k in range(size)]
        return counts.filter(F.col("words") == size).select("lang", *keys, F.col("n").alias(name))

    scored, inside = [], []
    for size in range(2, longest + 1):
        found = counts.filter(F.col("words") == size).select("lang", *columns[:size], F.col("n").alias("a"))
        for k in range(1, size):
            found = found.join(of(k, 0, f"l{k}"), ["lang", *columns[:k]]).join(of(size - k, k, f"r{k}"), ["lang", *columns[k:size]])
        cuts = F.array(*[F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)])
        phrase = F.concat_ws(" ", *columns[:size])
        scored.append(found.select("lang", phrase.alias("phrase"), "a", F.array_min(cuts).alias("cut")))
        for part in range(2, size):
            parts = F.explode(F.array(*[F.concat_ws(" ", *columns[k : k + part]) for k in range(size - part + 1)]))
            inside.append(counts.filter(F.col("words") == size).select("lang", parts.alias("phrase"), F.col("n").alias("longer")))
    candidates = reduce(DataFrame.union, scored)
    if inside:
        longer = reduce(DataFrame.union, inside).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        hides = 100 * F.coalesce("longer", F.lit(0)) >= covered * F.col("a")
        candidates = candidates.join(longer, ["lang", "phrase"], "left").filter(~hides)
    n = counts.filter("words = 0 AND lang IS NOT NULL").select("lang", "n")
    rows = candidates.join(n, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each of some parts of a language, so that no task meets all its candidates.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), f1 AS (
  SELECT lang, w[i] AS a, count(*) AS n FROM starts GROUP BY ALL
), f2 AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS n FROM starts WHERE i + 1 <= len(w) GROUP BY ALL
), f3 AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS n FROM starts WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.n AS f, 1 AS k, x.n AS l, y.n AS r
  FROM f2 JOIN f1 x ON (x.lang, x.a) = (f2.lang, f2.a) JOIN f1 y ON (y.lang, y.a) = (f2.lang, f2.b)
  WHERE f2.n >= 10
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.n, 1, x.n, y.n
  FROM f3 JOIN f1 x ON (x.lang, x.a) = (f3.lang, f3.a) JOIN f2 y ON (y.lang, y.a, y.b) = (f3.lang, f3.b, f3.c)
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.n, 2, x.n, y.n
  FROM f3 JOIN f2 x ON (x.lang, x.a, x.b) = (f3.lang, f3.a, f3.b) JOIN f1 y ON (y.lang, y.a) = (f3.lang, f3.c)
), scored AS (
  SELECT *, ((1000000::HUGEINT * f * f) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, a || ' ' || b AS phrase, n FROM f3 UNION ALL SELECT lang, b || ' ' || c, n FROM f3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE NOT coalesce(100 * longer.n >= 50 * f, false)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, totals.n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
