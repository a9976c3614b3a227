"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, components over the links.

1. A fingerprint a document (Arrow batches; the text never leaves its task), written once.
2. Copies fold: one representative, the smallest id, for each distinct fingerprint.
3. Fingerprints are cut into b blocks. Two that differ in at most d bits agree on at least b - d
   blocks, so they meet under one of the C(b, d) keys made of b - d blocks. b follows from the
   count of fingerprints: the least expected number of keys and chance meetings.
4. Within a key, Hamming distances are verified and only a spanning forest of the links leaves the
   task: at most one link a fingerprint, never all pairs. Keys of very many fingerprints are dealt out
   in blocks instead (see groups.py).
5. Components of those links, carried back to fingerprints and then to documents.

The general form (`similar_components`) cuts longer fingerprints into blocks whose width and number
follow from the count of fingerprints, and takes the components as candidates only: within each, links
are made anew from exact shingle sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.llm.graph import connected_components
from kinmer.llm.groups import BLOCK, BLOCK_BYTES, Fingerprints, Sets, forest, group_links, large_group_links
from kinmer.llm.shared import cut, unused
from kinmer.llm.sieve import matching, others


BITS = 64
#: Shingles unpacked to bits at once: bounds memory for very long texts.
CHUNK = 1 << 14
#: Shingles whose bits are counted in one byte.
RUN = 255
#: Words of 64 bits of the fingerprints that stand for a shingle similarity.
LONG_WORDS = 8
#: Long fingerprints whose bits are unpacked at once.
ROWS_AT_ONCE = 2000


def fingerprint_words(text: str | None, shingle: int = 4, seed: int = 42, words: int = 1) -> np.ndarray:
    """A fingerprint of 64-bit words; a bit is 1 if it is set in over half of the shingles' hashes.

    The first word is made of the shingles' XXH64, further ones of mixes of it. No words give zero.
    """
    return _majority(shingle_hashes(text, shingle, seed), words)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle in order, repeats included; no words give none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    body = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(body[a:b], seed) for a, b in spans), "<u8", len(parts) - k + 1)


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of these hashes."""
    total = np.zeros(words * BITS, np.int64)
    for start in range(0, len(hashes), CHUNK):
        mixed = _mixed(hashes[start : start + CHUNK], words)
        for at in range(0, len(mixed), RUN):  # counts of a run fit in a byte, so adding stays vectorised
            bits = np.unpackbits(mixed[at : at + RUN].view(np.uint8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hash itself, then multiply-and-shift mixes of it with the word's number."""
    out = np.empty((len(hashes), words), "<u8")
    out[:, 0] = hashes
    for w in range(1, words):
        z = hashes + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, w] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint."""
    return int(fingerprint_words(text, shingle, seed)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp array<long> of `words` words): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint_words(t.as_py(), shingle, words=words) for t in batch.column(1)]
            flat = np.concatenate([np.zeros(0, np.uint64), *marks]).view(np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * words), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp array<long>")


def block_count(n: int, radius: int) -> int:
    """The number of blocks with the least keys and chance meetings a fingerprint, for n of them."""

    def cost(b: int) -> float:
        keys = math.comb(b, radius)
        return keys * (1 + n / 2 ** (1 + BITS * (b - radius) / b))

    return min(range(radius + 1, radius + 9), key=cost)


def choice_keys(fp: Column, blocks: int, radius: int) -> Column:
    """array<struct<which, bits>>: a 64-bit fingerprint under each choice of blocks - radius blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    keys = []
    for which, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(which).alias("which"), F.get(fp, 0).bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


#: Groups of up to so many members are compared together, all groups of a batch at once.
SMALL = 8


def links_of_groups(bounds: np.ndarray, ids: np.ndarray, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) that connect what is linked within each group of rows bounds[k] to bounds[k + 1]."""
    size = np.diff(bounds)
    small = np.repeat(size <= SMALL, size)
    end = np.repeat(bounds[1:], size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.flatnonzero(small)
    for step in range(1, SMALL):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        near = rows[_distance(marks[rows], marks[rows + step]) <= radius]
        a.append(ids[near])
        b.append(ids[near + step])
    for k in np.flatnonzero(size > SMALL).tolist():
        lo, hi = bounds[k], bounds[k + 1]
        if pairs := forest(Fingerprints([m.tobytes() for m in marks[lo:hi]], radius), hi - lo):
            x, y = np.array(pairs).T
            a.append(ids[lo + x])
            b.append(ids[lo + y])
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints of one key that differ in at most `radius` bits.

    `keyed` is (group, rep_id, w0, w1, ...), a row for each key with the words of the fingerprint as columns,
    which take half the room of an array. The ends of every such link are connected by the rows
    returned; in groups of more than a few members links that follow from others are left out. One
    task holds one key's distinct fingerprints with their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition is sorted by key: runs of equal keys are its groups."""
        held: list[list[np.ndarray]] = []

        def close(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key, ids, marks = (np.concatenate(x) for x in zip(*parts))
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            a, b = links_of_groups(np.concatenate([[0], edge, [len(key)]]), ids, marks, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            cols.append(np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[2:]], axis=1))
            same = cols[0] == cols[0][-1]
            tail = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if tail or (held and held[-1][0][-1] != cols[0][0]):
                yield from close([*held, [c[:tail] for c in cols]])
                held = []
            held.append([c[tail:] for c in cols])
        if held:
            yield from close(held)

    dealt = keyed.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long")


def hot_keys(keyed: DataFrame, hot: int = BLOCK, share: int = 16) -> DataFrame:
    """(group, centre) of keys that more than `hot` fingerprints have, or nearly so; keyed is (rep_id, group).

    Counted on every `share`-th fingerprint by hash. A key on the border may go either way: only how its
    rows are dealt out depends on it, not what is found.
    """
    some = keyed.filter(F.pmod(F.xxhash64(F.lit(share), "rep_id"), F.lit(share)) == 0)
    return some.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("rep_id").alias("centre")).filter(F.col("n") > hot // share).select("group", "centre")


def simhash_components(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4, radius: int = 4, hot: int = BLOCK
) -> DataFrame:
    """One row per input row: (doc_id, fingerprint, component_id).

    Words are runs of anything but ASCII white space, A-Z lower-cased; texts with fewer words than a
    shingle are one shingle, null and blank texts have fingerprint zero, linked like any other.
    component_id is the smallest doc_id reachable over links, the row's own included. Rows that
    repeat count once for links and each get a row. Rows with a null id keep their fingerprint and
    get their component's id, null if no row there has one. Extra columns are ignored. Keys of more
    than about `hot` distinct fingerprints are dealt out in blocks.
    """
    marks = cut(fingerprints(docs, text, id_col, shingle))
    reps = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("rep_id")))
    known = reps.filter("rep_id IS NOT NULL")
    keys = choice_keys(F.col("fp"), block_count(known.count(), radius), radius)
    keyed = known.select("rep_id", F.get("fp", 0).alias("w0"), F.explode(keys).alias("key")).select(F.xxhash64("key.which", "key.bits").alias("group"), "rep_id", "w0")
    busy = cut(hot_keys(keyed.select("rep_id", "group"), hot))
    n_busy = len(busy.take(1))
    links = fingerprint_links(others(keyed, busy, ["group"]) if n_busy else keyed, radius)
    if n_busy:
        rows = matching(keyed, busy, ["group"]).select("group", F.col("rep_id").alias("node"), as_bytes(F.col("w0")).alias("body"))
        links = links.union(large_group_links(rows, lambda bodies: Fingerprints(bodies, radius), hot))
    found = connected_components(links)
    classes = reps.join(found, reps.rep_id == found.node, "left").select("fp", F.coalesce("component", "rep_id").alias("component_id"))
    mark = F.lower(F.lpad(F.hex(F.get("fp", 0)), 16, "0"))
    return marks.join(classes, "fp", "left").select("doc_id", mark.alias("fingerprint"), "component_id")


def as_bytes(word: Column) -> Column:
    """A word of a fingerprint as 8 bytes."""
    return F.unhex(F.lpad(F.hex(word), 16, "0"))


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float, bits: int = BITS * LONG_WORDS, spread: float = 1.5) -> int:
    """Differing bits that this Jaccard similarity makes expect, and some standard deviations more."""
    share = differing_share(similarity)
    return math.floor(bits * share + spread * math.sqrt(bits * share * (1 - share)))


@dataclass(frozen=True)
class Blocks:
    """Blocks of long fingerprints: `cuts` orders of all bits, each cut into blocks of `width` bits."""

    width: int
    cuts: int

    @staticmethod
    def suited(n: int, similarity: float, missed: float = 0.005) -> Blocks:
        """Blocks for n fingerprints.

        A block has five bits less than log2(n), so that about 32 fingerprints share one by chance however
        many there are: fewer would take more blocks, of which each moves a row. There are so many blocks
        that a pair of just this similarity shares none of them with a chance of at most `missed` if its
        bits differ as expected; closer pairs miss each other far less.
        """
        width = max(16, math.ceil(math.log2(max(n, 1))) - 5)
        wanted = math.log(missed) / math.log1p(-((1 - differing_share(similarity)) ** width))
        return Blocks(width, math.ceil(wanted / (BITS * LONG_WORDS // width)))

    def keys(self, marks: np.ndarray) -> np.ndarray:
        """(n, blocks) numbers, equal only for equal blocks, of (n, words) fingerprints."""
        bits = np.unpackbits(np.ascontiguousarray(marks).view(np.uint8), axis=1, bitorder="little").astype(np.float64)
        per, powers = bits.shape[1] // self.width, 2.0 ** np.arange(self.width)
        out = []
        for k in range(self.cuts):
            order = np.arange(bits.shape[1]) if k == 0 else np.random.default_rng(k).permutation(bits.shape[1])
            block = bits[:, order[: per * self.width]].reshape(len(bits), per, self.width) @ powers
            out.append(block.astype(np.int64) + (np.arange(k * per, (k + 1) * per) << self.width))
        return np.concatenate(out, axis=1)


def block_rows(reps: DataFrame, blocks: Blocks, words: int = LONG_WORDS // 2) -> DataFrame:
    """(group, rep_id, w0, w1, ...) for each block of each (rep_id, fp); only the first words of a fingerprint go along."""
    names = ["group", "rep_id", *[f"w{k}" for k in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                marks = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
                keys = blocks.keys(marks)
                rows = np.repeat(np.arange(len(keys)), keys.shape[1])
                cols = [keys.ravel(), batch.column(0).to_numpy()[rows], *[marks[rows, k].view(np.int64) for k in range(words)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return reps.select("rep_id", "fp").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def candidate_links(reps: DataFrame, similarity: float, hot: int = BLOCK) -> DataFrame:
    """Links whose components hold together all (rep_id, fp) that may have this similarity.

    Fingerprints that share a block are compared in the first half of their bits, at three and a half
    standard deviations. Those that share a block with more than about `hot` others, which chance does
    not do, are taken as candidates together without a comparison, so no such group meets in a task.
    """
    rows = block_rows(reps, Blocks.suited(reps.count(), similarity))
    busy = cut(hot_keys(rows.select("rep_id", "group"), hot))
    words = LONG_WORDS // 2
    radius = radius_of(similarity, words * BITS, 3.5)
    if not busy.take(1):
        return fingerprint_links(rows, radius)
    together = matching(rows.select("rep_id", "group"), busy, ["group"]).select(F.col("rep_id").alias("a"), F.col("centre").alias("b"))
    return fingerprint_links(others(rows, busy, ["group"]), radius).union(together.filter("a != b").distinct())


def set_marks(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5) -> DataFrame:
    """(doc_id, fp, sig, body, size): long fingerprint, MD5 and size of the shingle set and MD5 of the text, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sigs, bodies, sizes = [np.zeros(0, np.uint64)], [], [], []
            for cell in batch.column(1):
                body = cell.as_py()
                hashes = np.unique(shingle_hashes(body, shingle))  # the similarity is of sets: repeats count once
                marks.append(_majority(hashes, LONG_WORDS))
                sigs.append(hashlib.md5(hashes).digest())
                sizes.append(len(hashes))
                bodies.append(hashlib.md5((body or "").encode("utf-8", "surrogatepass")).digest())
            at = np.arange(len(sigs) + 1, dtype=np.int32) * LONG_WORDS
            fp = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(marks).view(np.int64)))
            columns = [batch.column(0), fp, pa.array(sigs, pa.binary()), pa.array(bodies, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sig", "body", "size"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp array<long>, sig binary, body binary, size long")


def body_digest(text: str) -> Column:
    """The `body` of `set_marks` in Spark's functions."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def set_links(groups: DataFrame, shingle: int, similarity: float, hot: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what is linked in exact shingle similarity within each group of (group, node, n, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = [x not in seen and not seen.add(x) for x in batch.column(1).to_pylist()]  # rows that repeat count once
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            each = pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], each], ["group", "node", "n", "body"])

    hashed = groups.select("group", "node", "n", "text").mapInArrow(sets, "group long, node long, n long, body binary")
    return group_links(hashed, lambda bodies: Sets(bodies, similarity), hot)


def _similar(docs: DataFrame, text: str, id_col: str, shingle: int, similarity: float, hot: int = BLOCK) -> DataFrame:
    """(doc_id, body, keep) for each row: keep is (doc_id, body) of its component's first row, null without an id."""
    marks = cut(set_marks(docs, text, id_col, shingle))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "body"))
    reps = cut(marks.groupBy("fp", "sig").agg(F.min(named).alias("first"), F.max("size").alias("size")).select("*", F.monotonically_increasing_id().alias("node")))
    known = reps.filter("first IS NOT NULL").select(F.col("node").alias("rep_id"), "fp")
    near = connected_components(candidate_links(known, similarity, hot))
    sizes = near.join(reps.select("node", "size"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    # Groups that no task should hold: of many members, or of few whose sets fill more than a block.
    large = cut(sizes.filter((F.col("n") > hot) | (F.col("shingles") * 8 > BLOCK_BYTES)).select("component", F.greatest("n", F.lit(hot + 1)).alias("n")))
    size = F.coalesce("n", F.lit(0)).cast("long")  # of a group that one task holds, its size is of no account
    wanted = cut(
        near.join(large, "component", "left")
        .join(reps, "node")
        .select(F.col("component").alias("group"), "node", size.alias("n"), F.col("first.doc_id").alias("_id"), F.col("first.body").alias("_body"))
    )
    whole = docs.select(F.col(id_col).cast("long").alias("_id"), body_digest(text).alias("_body"), F.col(text).alias("text"))
    groups = matching(whole, wanted, ["_id", "_body"]).select("group", "node", "n", "text")
    found = connected_components(set_links(groups, shingle, similarity, hot))
    firsts = cut(reps.join(found, "node").groupBy("component").agg(F.min("first").alias("least")))
    classes = reps.join(found, "node", "left").join(firsts, "component", "left")
    return marks.join(classes.select("sig", F.coalesce("least", "first").alias("keep")), "sig", "left").select("doc_id", "body", "keep")


def similar_components(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, hot: int = BLOCK
) -> DataFrame:
    """(doc_id, component_id) for links at a Jaccard similarity of shingle sets instead of a number of bits.

    Candidates share a block of 512-bit fingerprints (`Blocks.suited`) and are close in Hamming distance.
    Within each group of candidates the sets themselves (of 64-bit hashes) are compared, so every link
    has the similarity asked for, and none within a group is missed. Rows are treated as by
    `simhash_components`.
    """
    found = _similar(docs, text, id_col, shingle, similarity, hot)
    return found.select("doc_id", F.col("keep.doc_id").alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, hot: int = BLOCK
) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component; rows with a null id stay.

    Of texts that share that id and the component, the one with the least MD5 stays; rows equal in id
    and text are one document and stay together. Ids and digests of rows to drop are joined away (anti
    join), so a component of any size is dealt out and a repeated id costs no other text.
    """
    gone_id, gone_body = unused(docs, "gone_id"), unused(docs, "gone_body")
    marked = _similar(docs, text, id_col, shingle, similarity, hot).filter("struct(doc_id, body) != keep")
    gone = cut(marked.select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body)).distinct())
    named = docs.withColumns({gone_id: F.col(f"`{id_col}`").cast("long"), gone_body: body_digest(text)})
    return others(named, gone, [gone_id, gone_body]).select(*[F.col(f"`{c}`") for c in docs.columns])
