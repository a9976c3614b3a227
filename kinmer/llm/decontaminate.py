"""Test passages found in training texts through a distributed positional inverted index.

The index: documents are laid out word after word in blocks of some two million words, a place left free
between two of them. Each block stores, for every word in it, the sorted places (postings), a row for each
(block, word), and one row that says which document lies where. It is written once as Parquet and serves any
number of searches.

A search: phrases are windows of test words. The number of postings of each test word is a sum over the
index, without the postings themselves; a window with a word of none is gone. A block gets the windows whose
rarest word it holds, and the postings of test words; there the list of the rarest word, shifted by its offset,
is intersected with the shifted lists of the others from rare to frequent, for all windows in step. What is
left are exact occurrences. Proximity takes the same lists, with a distance instead of an offset.

No text moves, no phrase passes the driver, and a task holds one block: a word that fills a third of a
corpus is a longer list in each block, no larger task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.llm.shared import ascii_lower, cut, text_or_empty, unused
from kinmer.llm.tokens import classes, cut_words, row_chunks
from kinmer.shared import delete_folder, shared_folder

#: Bytes that no word has, once A-Z are lower case.
GAPS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Bytes of text in a block; a longer text has a block of its own.
BLOCK = 12 << 20
ROWS_AT_ONCE = 50_000
#: Places looked at together when lists are intersected.
PLACES_AT_ONCE = 1 << 20
INDEX = "block long, term string, n int, postings binary, ids array<long>, starts array<long>, lengths array<long>"


def index_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The index's rows: (block, term, n, postings) for each word of a block, and its documents in a row without a term.

    Postings are the places' differences, 32-bit numbers. A null text has no words.
    """
    kinds = classes(GAPS)
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            for first, end in row_chunks(batch.column(1), block):
                yield from rows((task << 32) + n, batch.slice(first, end - first))
                n += 1

    def rows(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = cut_words(batch.column(1), kinds)
        lengths = np.bincount(found.row, minlength=batch.num_rows)
        place = np.arange(len(found.row)) + found.row  # one free place behind each document
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])

        def whole(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), values.cast(pa.int64()))

        documents = [whole(batch.column(0)), whole(pa.array(starts)), whole(pa.array(lengths))]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([None], pa.binary()), *documents], names)
        coded = found.words.dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=len(coded.dictionary))
        gaps = np.diff(place[order], prepend=0)
        heads = np.cumsum(counts) - counts
        if len(heads):
            gaps[heads] = place[order][heads]
        offsets = np.append(heads, len(order)) * 4
        terms = coded.dictionary.cast(pa.large_string()).cast(pa.string())
        lists = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(gaps.astype("<u4"))])
        for at in range(0, len(counts), ROWS_AT_ONCE):
            part = slice(at, min(at + ROWS_AT_ONCE, len(counts)))
            size = part.stop - part.start
            none = pa.nulls(size, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, number)), terms[part], pa.array(counts[part].astype(np.int32)), lists[part].cast(pa.binary()), none, none, none], names
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, INDEX)


@dataclass
class Index:
    """A written index."""

    spark: SparkSession
    folder: str

    @staticmethod
    def build(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folder: str | None = None, block: int = BLOCK) -> Index:
        folder = folder or f"{shared_folder(docs.sparkSession)}/positions-{uuid.uuid4().hex}"
        index_rows(docs, text, id_col, block).write.parquet(folder)
        return Index(docs.sparkSession, folder)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def delete(self) -> None:
        delete_folder(self.spark, self.folder)


def words_of(text: Column) -> Column:
    """The words of a text in Spark's functions, in lower case."""
    return F.array_remove(F.split(ascii_lower(text), WORDS), "")


def windows(items: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item, terms): every `window` consecutive words of an item, or all of its words where it has fewer.

    An item without a word has none; a null id counts as an empty one; repeated windows of an item count once.
    """
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text)).alias("w"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at")
    return words.filter(F.size("w") > 0).select("item", "w", starts).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("terms")).distinct()


def _placed(phrases: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, item, terms, order) of phrases in the blocks that hold their rarest word, and (term) of all of these.

    `order` lists a phrase's offsets from its rarest word to the most frequent one.
    """
    numbered = cut(phrases.select("item", "terms", F.monotonically_increasing_id().alias("phrase")))
    wanted = cut(numbered.select(F.explode("terms").alias("term")).distinct())
    counts = index.filter("term IS NOT NULL").select("term", "block", "n").join(wanted, "term", "left_semi")
    totals = counts.groupBy("term").agg(F.sum("n").alias("total"))
    each = numbered.select("phrase", F.posexplode("terms").alias("offset", "term")).join(totals, "term")
    ranked = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("total", "offset", "term"))).alias("ranked"))
    ready = ranked.join(numbered, "phrase").filter(F.size("ranked") == F.size("terms"))
    ready = ready.select("item", "terms", F.col("ranked.offset").alias("order"), F.get("ranked", 0)["term"].alias("term"))
    return counts.select("term", "block").join(ready, "term").select("block", "item", "terms", "order"), wanted


class Postings:
    """The lists of one block as one sorted array of (term number, place)."""

    def __init__(self, terms: pa.Array, postings: pa.Array):
        self.terms = terms
        gaps = [np.frombuffer(p, "<u4").astype(np.int64) for p in postings.to_pylist()]
        self.size = np.array([len(g) for g in gaps], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.keys = np.concatenate([np.cumsum(g) + (k << 32) for k, g in enumerate(gaps)]) if gaps else np.zeros(0, np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, -1 for a word without a list here."""
        return pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, place): all places of each of these terms, by the position in `term`."""
        owner = np.repeat(np.arange(len(term)), self.size[term])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(self.size[term]) - self.size[term], self.size[term])
        return owner, self.keys[self.begin[term][owner] + within] & 0xFFFFFFFF

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term stands at each place."""
        return self.next_place(term, place) == place

    def next_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each term that is not before `place`; -1 if there is none."""
        at = np.searchsorted(self.keys, (term << 32) + place)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (found >> 32 == term), found & 0xFFFFFFFF, -1)


def occurrences(lists: Postings, number: np.ndarray, begin: np.ndarray, order: np.ndarray, within: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of all occurrences in a block, of phrases that lie one after the other in `number`.

    Phrase p has the term numbers number[begin[p]:begin[p + 1]] and, at the same places of `order`, its offsets from
    rare to frequent. Exact occurrences are given by their first word. With `within`, those of the rarest word that
    have every other word of the phrase at most so many places away, in any order.
    """
    size = np.diff(begin)
    whole = np.logical_and.reduceat(number >= 0, begin[:-1]) if len(size) else np.zeros(0, bool)
    live = np.flatnonzero(whole)
    rarest = number[begin[live] + order[begin[live]]]
    cost = np.cumsum(lists.size[rarest])
    out_phrase, out_place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = 0
    while first < len(live):  # so many phrases at a time that their candidates stay within bounds
        end = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + PLACES_AT_ONCE, side="right")))
        some = live[first:end]
        owner, place = lists.places(rarest[first:end])
        phrase = some[owner]
        place = place - (order[begin[phrase]] if within is None else 0)
        for step in range(1, int(size[some].max())):
            going = size[phrase] > step
            at = begin[phrase[going]] + order[begin[phrase[going]] + step]
            kept = ~going
            if within is None:
                kept[going] = lists.holds(number[at], place[going] + (at - begin[phrase[going]]))
            else:
                near = lists.next_place(number[at], np.maximum(place[going] - within, 0))
                kept[going] = (near >= 0) & (near <= place[going] + within)
            phrase, place = phrase[kept], place[kept]
        out_phrase.append(phrase)
        out_place.append(place)
        first = end
    return np.concatenate(out_phrase), np.concatenate(out_place)


def _in_blocks(index: Index, phrases: DataFrame, run, schema: str) -> DataFrame:
    """`run(block's lists, ids, starts, lengths, items, terms' numbers, begins, orders)` for each block, a task a block."""
    rows = index.rows()
    placed, wanted = _placed(phrases, rows)
    lists = rows.join(wanted, "term", "left_semi").select("block", "term", "postings")
    documents = rows.filter("term IS NULL").select("block", "ids", "starts", "lengths")
    none = {"term": "string", "postings": "binary", "ids": "array<long>", "starts": "array<long>", "lengths": "array<long>", "item": "string", "terms": "array<string>", "order": "array<int>"}

    def full(df: DataFrame) -> DataFrame:
        return df.select("block", *[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in none.items()])

    def of_block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs = table.filter(pc.is_valid(table["ids"]))
        own = table.filter(pc.is_valid(table["postings"]))
        asked = table.filter(pc.is_valid(table["terms"]))
        postings = Postings(own["term"].combine_chunks(), own["postings"].combine_chunks())
        terms, order = asked["terms"].combine_chunks(), asked["order"].combine_chunks()
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ids, starts, lengths = (docs[c].combine_chunks().flatten() for c in ("ids", "starts", "lengths"))
        number = postings.numbers(terms.flatten())
        return run(postings, ids, starts.to_numpy(), lengths.to_numpy(), asked["item"].combine_chunks(), number, begin, order.flatten().to_numpy().astype(np.int64))

    together = full(documents).union(full(lists)).union(full(placed))
    return together.groupBy("block").applyInArrow(of_block, schema)


def matches(index: Index, phrases: DataFrame, within: int | None = None) -> DataFrame:
    """(doc_id, item, place, length): every occurrence of phrases (item, terms) in the documents, by their places in these.

    With `within` these are proximity matches: places of a phrase's rarest word that have all its others at most so
    many words away in the same document, in any order; length is then the phrase's. Repeated phrases repeat matches.
    """

    def run(lists, ids, starts, lengths, items, number, begin, order) -> pa.Table:
        phrase, place = occurrences(lists, number, begin, order, within)
        row = np.searchsorted(starts, place, side="right") - 1
        size = np.diff(begin)[phrase]
        if within is not None and len(phrase):
            # A word of another document doesn't count: every word must also be near within the bounds of this one.
            low, high = np.maximum(place - within, starts[row]), np.minimum(place + within, starts[row] + lengths[row] - 1)
            inside = np.ones(len(phrase), bool)
            for step in range(int(size.max())):
                going = size > step
                near = lists.next_place(number[begin[phrase[going]] + step], low[going])
                inside[going] &= (near >= 0) & (near <= high[going])
            phrase, place, row, size = phrase[inside], place[inside], row[inside], size[inside]
        told = [ids.take(pa.array(row)), items.take(pa.array(phrase)), pa.array(place - starts[row]), pa.array(size)]
        return pa.table(dict(zip(["doc_id", "item", "place", "length"], told)))

    return _in_blocks(index, phrases, run, "doc_id long, item string, place long, length long")


def hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document of the index.

    A word inside any occurrence of a phrase is hit; items are told once each, sorted as strings.
    """

    def run(lists, ids, starts, lengths, items, number, begin, order) -> pa.Table:
        phrase, place = occurrences(lists, number, begin, order)
        change = np.zeros(int((starts[-1] + lengths[-1] if len(starts) else 0) + 2), np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + np.diff(begin)[phrase], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
        n_hit = covered[starts + lengths] - covered[starts]
        names = items.dictionary_encode()
        row = np.searchsorted(starts, place, side="right") - 1
        found = np.unique(np.column_stack([row, names.indices.to_numpy()[phrase]]), axis=0) if len(phrase) else np.zeros((0, 2), np.int64)
        told: dict[int, list[str]] = {}
        for at, item in zip(found[:, 0].tolist(), names.dictionary.take(pa.array(found[:, 1])).to_pylist()):
            told.setdefault(at, []).append(item)
        own = [sorted(told.get(k, ())) for k in range(len(starts))]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]
        columns = [ids, pa.array(lengths), pa.array(n_hit), pa.array([len(x) for x in own], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0)]
        return pa.table(dict(zip(["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], columns)))

    return _in_blocks(index, phrases, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row for each document: how many of its words lie in passages of test items, and of which items.

    A null text has no words, like an empty one; each row counts for itself, rows that repeat too. A null
    item_id counts as an empty string. Other columns are ignored. The index is deleted once it is searched.
    """
    index = Index.build(docs, text, id_col, block=block)
    found = cut(hits(index, windows(items, window)))
    index.delete()
    return found


def is_clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` with no contaminated row of their id in `found`; those with a null id stay."""
    name = unused(docs, "found_id")
    return docs.join(found.filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), F.col(f"`{id_col}`") == F.col(name), "left_anti")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), asked AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM asked
), spans AS (
  SELECT row, size, i AS start, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT row, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), found AS (
  SELECT row, start, size, item FROM spans JOIN asked USING (size, phrase)
), covered AS (
  SELECT row, count(DISTINCT place) AS n_hit
  FROM (SELECT row, unnest(range(start, start + size)) AS place FROM (SELECT DISTINCT row, start, size FROM found)) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""
