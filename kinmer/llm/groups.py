"""Links within groups of any size, by an exact test of two members.

Small groups are worked on in one task each: a spanning forest of their links, breadth first over what
is not yet reached. A group beyond BLOCK members is never brought together. It is dealt into blocks and
worked on in two passes, in each of which one task holds two blocks at most. Long members count by their
bytes, so that what a task holds is bounded whatever the lengths of texts:

1. A few members are heads; every block is compared with them. In a group of near copies this links
   nearly all members to a head, their home, and the homes to one another.
2. What may still be linked is compared block by block. Members of one cluster are connected already.
   Members of two homes can't be linked if the homes are more than three times as far apart as two
   linked members are: both distances (Hamming, and one minus Jaccard) obey the triangle inequality.
   So groups of several kinds of near copies take little work, and only members without a home, which
   are few where there are many links, are compared with all others.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.llm.graph import connected_components
from kinmer.llm.shared import cut

#: Most members of a group, or of a part of a larger one, that a task holds.
BLOCK = 1024
#: Most bytes of members that a part holds, but for one member alone; a task holds two parts.
BLOCK_BYTES = 64 << 20
#: Heads of a large group in the first pass, on average.
HEADS = 8


class Fingerprints:
    """Members that are words of bits; linked at no more than `radius` differing bits."""

    def __init__(self, bodies: list[bytes], radius: int):
        self.marks = np.frombuffer(b"".join(bodies), "<u8").reshape(len(bodies), -1)
        self.radius = radius

    def far(self, at: int) -> np.ndarray:
        """The members that are too far from `at` for a member linked to them to be linked to one linked to `at`."""
        apart = np.bitwise_count(self.marks ^ self.marks[at]).sum(axis=1, dtype=np.int64)
        return np.flatnonzero(apart > 3 * self.radius)

    def near(self, at: int, left: np.ndarray) -> np.ndarray:
        """The members marked in `left` that are linked to `at`."""
        rows = np.flatnonzero(left)
        apart = np.bitwise_count(self.marks[rows] ^ self.marks[at]).sum(axis=1, dtype=np.int64)
        return rows[apart <= self.radius]


class Sets:
    """Members that are sets of 64-bit numbers; linked at a Jaccard similarity of `similarity` or more."""

    def __init__(self, bodies: list[bytes], similarity: float):
        sets = [np.frombuffer(b, "<u8") for b in bodies]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.own = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        self.end = np.cumsum(self.size)
        self.code, self.owner = self.own, np.repeat(np.arange(len(sets)), self.size)  # of what may still be asked for
        self.held = np.zeros(len(self.own), bool)
        self.similarity = similarity

    def near(self, at: int, left: np.ndarray) -> np.ndarray:
        """The members marked in `left`, which only ever loses marks, that are linked to `at`."""
        stays = left[self.owner]
        if 2 * stays.sum() < len(stays):
            self.code, self.owner = self.code[stays], self.owner[stays]
        return np.flatnonzero(left & (self._alike(at) >= self.similarity))

    def far(self, at: int) -> np.ndarray:
        """As in `Fingerprints`; before anything was asked of `near`."""
        return np.flatnonzero(self._alike(at) < 1 - 3 * (1 - self.similarity) - 1e-9)

    def _alike(self, at: int) -> np.ndarray:
        """The Jaccard similarity with `at` of the members that may still be asked for."""
        mine = self.own[self.end[at] - self.size[at] : self.end[at]]
        self.held[mine] = True
        common = np.bincount(self.owner[self.held[self.code]], minlength=len(self.size))
        self.held[mine] = False
        joined = np.maximum(self.size + self.size[at] - common, 1)
        # Two empty sets are equal.
        return np.where(self.size + self.size[at] == 0, 1.0, common / joined)


Members = Callable[[list[bytes]], Fingerprints | Sets]


def forest(members: Fingerprints | Sets, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of members 0 to n - 1, as pairs.

    A dense group is used up by its first members, so the work is far from all pairs where there are
    many links.
    """
    left, pairs = np.ones(n, bool), []
    for root in range(n):
        queue = [root] if left[root] else []
        left[root] = False
        while queue and left.any():
            at = queue.pop()
            found = members.near(at, left).tolist()
            pairs += [(at, x) for x in found]
            queue += found
            left[found] = False
    return pairs


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, one list for each run of equal keys (the first columns)."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for _, run in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield list(run)


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small_group_links(rows: DataFrame, members: Members) -> DataFrame:
    """(a, b) that connect what is linked in each group of (group, node, body); a task holds a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1):
            group = list({r[1]: r for r in run}.values())
            pairs = forest(members([r[2] for r in group]), len(group))
            if pairs:
                yield _links([group[x][1] for x, _ in pairs], [group[y][1] for _, y in pairs])

    dealt = rows.select("group", "node", "body").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long")


def _against(heads: DataFrame, others: DataFrame, members: Members) -> DataFrame:
    """(task, a, b): links of heads with others of the same (task, hb, mb), for each head one with each cluster it is linked to.

    Both are (task, hb, mb, head, node, cluster, body); one Spark task holds the rows of one (task, hb, mb).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, 3):
            body = members([r[6] for r in part])
            others = np.array([not r[3] for r in part])
            if others.all() or not others.any():
                continue
            found = []
            for at in np.flatnonzero(~others).tolist():
                task, _, _, _, node, own, _ = part[at]
                near = {part[x][5]: part[x][4] for x in body.near(at, others).tolist()}
                found += [(task, node, other) for cluster, other in near.items() if cluster != own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["task", "a", "b"])

    dealt = heads.unionByName(others).repartition("task", "hb", "mb").sortWithinPartitions("task", "hb", "mb")
    return dealt.select("task", "hb", "mb", "head", "node", "cluster", "body").mapInArrow(run, "task long, a long, b long")


def _far_homes(heads: DataFrame, members: Members) -> DataFrame:
    """(group, p, q), both ways round: heads of a group that are too far apart for their members to be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            body = members([r[2] for r in rows])
            found = [(r[0], r[1], rows[x][1]) for at, r in enumerate(rows) for x in body.far(at).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["group", "p", "q"])

    dealt = heads.select("group", "node", "body").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "group long, p long, q long")


def _side(df: DataFrame, head: bool, task: str, hb: Column, mb: Column, cluster: str) -> DataFrame:
    return df.select(
        F.col(task).alias("task"), hb.alias("hb"), mb.alias("mb"), F.lit(head).alias("head"), "node", F.col(cluster).alias("cluster"), "body"
    )


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _parts(block: int) -> Column:
    """An aggregate: into how many parts members are dealt, by their number and by their bytes."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.octet_length("body")) / BLOCK_BYTES)).cast("int")


def large_group_links(rows: DataFrame, members: Members, block: int = BLOCK) -> DataFrame:
    """(a, b) that connect what is linked in each group of (group, node, body), where groups are large."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), _parts(block).alias("parts"))
    dealt = cut(rows.join(sizes, "group").select("group", "node", "body", "n", F.xxhash64("group", "node").alias("mix"), "parts"))
    heads = dealt.filter(F.pmod(F.shiftright("mix", 20), F.col("n")) < HEADS)
    zero, own = F.lit(0), F.pmod("mix", "parts").cast("int")
    first = cut(_against(_side(heads, True, "group", zero, _upto("parts"), "node"), _side(dealt, False, "group", zero, own, "node"), members))

    known = connected_components(first.select("a", "b")).select("node", F.col("component").alias("cluster"))
    linked = first.select(F.col("task").alias("group"), F.col("b").alias("node"), F.col("a").alias("home"))
    homes = linked.union(heads.select("group", "node", F.col("node").alias("home"))).groupBy("group", "node").agg(F.min("home").alias("home"))
    placed = dealt.join(homes, ["group", "node"], "left").join(known, "node", "left").select(
        "group", "node", "mix", "body", F.coalesce("cluster", "node").alias("cluster"),
        F.col("home").isNull().alias("alone"), F.coalesce("home", F.lit(0)).alias("home"),
    )
    placed = cut(placed)

    # Kinds of members: those of one home, and those without. All of a home are in one cluster.
    kinds = cut(placed.groupBy("group", "home", "alone").agg(F.min("cluster").alias("cluster"), _parts(block).alias("blocks")))
    x, y, far = kinds.alias("x"), kinds.alias("y"), _far_homes(heads, members)
    between = F.col("x.alone") | (~F.col("y.alone") & (F.col("x.home") < F.col("y.home")) & (F.col("x.cluster") != F.col("y.cluster")))
    pairs = x.join(y, "group").filter(between).select(
        "group", F.col("x.home").alias("p"), F.col("x.alone").alias("alone"), F.col("x.blocks").alias("hbs"),
        F.col("y.home").alias("q"), F.col("y.alone").alias("other_alone"), F.col("y.blocks").alias("mbs"),
    )
    apart = far.withColumns({"alone": F.lit(False), "other_alone": F.lit(False)})
    pairs = cut(pairs.join(apart, ["group", "p", "q", "alone", "other_alone"], "left_anti").withColumn("task", F.monotonically_increasing_id()))

    of_heads = placed.join(pairs.drop("q", "other_alone").withColumnRenamed("p", "home"), ["group", "home", "alone"])
    of_others = placed.join(pairs.drop("p", "alone").withColumnsRenamed({"q": "home", "other_alone": "alone"}), ["group", "home", "alone"])
    second = _against(
        _side(of_heads, True, "task", F.pmod(F.shiftright("mix", 10), F.col("hbs")).cast("int"), _upto("mbs"), "cluster"),
        _side(of_others, False, "task", _upto("hbs"), F.pmod(F.shiftright("mix", 30), F.col("mbs")).cast("int"), "cluster"),
        members,
    )
    return first.union(second).select("a", "b")


def group_links(rows: DataFrame, members: Members, block: int = BLOCK) -> DataFrame:
    """(a, b) that connect what is linked within each group of rows (group, node, n, body), n the group's size."""
    small = small_group_links(rows.filter(F.col("n") <= block), members)
    large = cut(rows.filter(F.col("n") > block).select("group", "node", "body"))
    return small.union(large_group_links(large, members, block)) if large.take(1) else small
