"""What each of five filters removes in every order of applying them.

A document's failures are one number of five bits. Four come from its own text in the scan; the fifth,
being a copy of a text with a smaller id, from an existential self-join: a left-semi join on the hash, the
exact text and a smaller doc_id. Its other side is each repeated text once with its least id, folded in
the tasks, so a group of copies of any size meets one row. Only texts whose digest repeats move; a filter
of these digests is tested in the scan (`sieve`). Failures are united as counts: every document with its
own four bits, and for each copy one less without and one more with the fifth. All orders and steps are
sums over at most 32 combinations for each part.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.llm.shared import ASCII_UPPER, cut, text_or_empty, unused
from kinmer.llm.sieve import build_sieve

FILTERS = "ABCDE"
#: The bit of filter E, which takes other documents to know.
COPY = 1 << FILTERS.index("E")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, as a number."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, ASCII_UPPER, ""))
    failing = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0)).cast("int")


def copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose text is identical to that of any smaller id in the table.

    Null text counts as empty. A null id is smaller than none, so it makes no copies and is none.
    """
    digest = F.unhex(F.md5(text_or_empty(text).cast("binary")))
    known = docs.filter(F.col(id_col).isNotNull())
    counted = known.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    moved = build_sieve(cut(counted.filter("n > 1").select("digest"))).passing(known, digest)
    key, body, first = unused(docs, "first_digest"), unused(docs, "first_text"), unused(docs, "first_id")
    firsts = moved.select(digest.alias(key), text_or_empty(text).alias(body), F.col(id_col).alias(first))
    firsts = firsts.groupBy(key, body).agg(F.min(first).alias(first), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = cut(firsts)  # written, so that Spark can deal out a group of many copies at the join
    same = (digest == F.col(key)) & (text_or_empty(text) == F.col(body)) & (F.col(first) < F.col(id_col))
    return moved.join(firsts, same, "left_semi")


def failure_counts(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each combination of failed filters, and those labelled good or toxic."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    own = own_failures(text_or_empty("text"))
    every = slim.select("id", "part", own.alias("mask"), F.lit(1).alias("n"))
    again = copies(slim, "text", "id").select("id", "part", own.alias("mask"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("n"))
    again = again.withColumn("mask", F.when(F.col("n") > 0, F.col("mask") + COPY).otherwise(F.col("mask")))
    named = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = every.union(again).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).filter("n != 0").join(named, "id", "left")

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))

    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: what is kept, removed, redundant and lost there.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    Null text counts as empty, a null part is the empty string. Each row is a document, rows that repeat
    too: they are copies only of rows with a smaller id. A document with several labels is good or toxic
    if any says so; a null id has none. Other columns are ignored; an empty table gives no rows.
    """
    counts = failure_counts(docs, labels, text, id_col, part)
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(order), k + 1, bit[f], before))
            before += bit[f]
    orders = len(steps) // len(FILTERS)
    told = ";".join(f"{o},{s},{b},{p}" for o, s, b, p in steps)  # one literal, folded to an array by Spark
    rows = counts.select("*", F.explode(F.split(F.lit(told), ";")).alias("s")).withColumn("s", F.split("s", ",")).select(
        "*", F.get("s", 0).alias("filter_order"), F.get("s", 1).cast("int").alias("step"), F.get("s", 2).cast("int").alias("own"), F.get("s", 3).cast("int").alias("before")
    )
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, reached = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) == 0
    # A document that fails k filters is removed by each of them in one of k of all orders.
    share = F.lit(orders) / F.bit_count(mask)

    def total(of: Column, n: str | Column = "n") -> Column:
        return F.coalesce(F.sum(F.when(of, n if isinstance(n, Column) else F.col(n))), F.lit(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
        total(fails, F.col("n") * share.cast("long")).alias("shapley"),
    )


SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), failing AS (
  SELECT doc_id, part,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask
  FROM worded
), named AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failing LEFT JOIN named USING (doc_id) GROUP BY part, mask
), f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own != 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before != 0 AND mask & own != 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & own != 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own != 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""
