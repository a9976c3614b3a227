"""Document quality: gradient-boosted trees on histograms of document statistics.

The trees are fitted on the driver from a bounded sample of labelled rows (`max_train_rows`, those
with the least hash of their id), flattened into arrays and sent to the tasks, a few kilobytes,
where a batch of documents walks all of them at once in numpy.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 20_000
KEEP_FROM = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= ord("a")) & ((_BYTE | 32) <= ord("z"))
_CLASSES = np.stack(
    [
        (_BYTE >= ord("A")) & (_BYTE <= ord("Z")),
        (_BYTE >= ord("0")) & (_BYTE <= ord("9")),
        np.isin(_BYTE, [9, 10, 11, 12, 13, 32]),
        _BYTE == 10,
        _BYTE >= 128,
        (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~((_BYTE >= ord("0")) & (_BYTE <= ord("9"))),
        np.isin(_BYTE, list(b".,;:?'\"-()")),
        np.isin(_BYTE, list(b"#$%&*@^~_=+")),
        np.isin(_BYTE, list(b"|<>{}[]\\/`")),
        _BYTE == ord("!"),
    ]
).astype(np.float64)

FEATURES = (
    "log_bytes", "log_words", "upper", "digits", "space", "line_feeds", "beyond_ascii", "marks", "prose_marks",
    "symbols", "brackets", "exclaims", "entropy", "word_length", "distinct_words", "short_words", "marked_words",
    "lone_marks", "upper_words", "repeats_next", "top_word", "repeated_lines", "line_words", "longest_word",
)


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all of an empty text are zero."""
    body = (text or "").encode("utf-8", "surrogatepass")
    if not body:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256).astype(np.float64)
    share = counts / len(body)
    used = share[share > 0]
    words = body.split()
    n = max(1, len(words))
    lengths = list(map(len, words))
    tally = Counter(words)
    lines = [line for line in body.split(b"\n") if line.strip()]
    return [
        math.log1p(len(body)),
        math.log1p(len(words)),
        *(_CLASSES @ share).tolist(),
        float(-(used * np.log2(used)).sum()),
        sum(lengths) / n,
        len(tally) / n,
        sum(k <= 3 for k in lengths) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(k == 1 and not w.isalnum() for k, w in zip(lengths, words)) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(tally.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        math.log1p(max(lengths, default=0)),
    ]


@dataclass
class Forest:
    """Trees as flat arrays, (trees, nodes) each: children of node k are 2k + 1 and 2k + 2."""

    depth: int
    feature: np.ndarray
    at_most: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features; all rows walk all trees together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + math.exp(-self.bias)))
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.at_most[trees, node])
        return 1 / (1 + np.exp(-(self.bias + self.value[trees, node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 64, least: int = 20) -> Forest:
    """Boosted trees with logistic loss over per-feature histograms of quantile bins.

    A node that can't be split with `least` rows on each side sends all rows left (its threshold is
    infinite). Without rows of both classes the score is the smoothed share of ones, and 1 without
    any row: nothing is known against a document.
    """
    bias = (float(y.sum()) + 1) / (len(y) + 1) if len(y) == 0 or y.min() == y.max() else float(y.mean())
    bias = min(max(bias, 1e-6), 1 - 1e-6)
    start = math.log(bias / (1 - bias))
    if len(y) == 0 or y.min() == y.max():
        return Forest(depth, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])  # value <= edge[k]: bin <= k
    inner, total = 2**depth - 1, 2 ** (depth + 1) - 1
    feature, at_most = np.zeros((trees, total), np.int64), np.full((trees, total), np.inf)
    value, margin = np.zeros((trees, total)), np.full(len(y), start)
    width, soft = bins, 1.0
    offsets = (np.arange(len(binned)) * width)[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            goes = np.zeros(len(rows), np.int64)
            if len(rows) >= 2 * least:
                flat = (binned[:, rows] + offsets).ravel()
                g, h, n = (
                    np.bincount(flat, np.tile(w, len(binned)), len(binned) * width).reshape(-1, width).cumsum(axis=1)
                    for w in (grad[rows], hess[rows], np.ones(len(rows)))
                )
                gain = g**2 / (h + soft) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + soft) - g[:, -1:] ** 2 / (h[:, -1:] + soft)
                gain[(n < least) | (n[:, -1:] - n < least)] = -1
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] > 1e-9:
                    feature[t, k], at_most[t, k] = f, edges[f][b]
                    goes = (binned[f, rows] > b).astype(np.int64)
            node[rows] = 2 * k + 1 + goes
        g, h = np.bincount(node, grad, total), np.bincount(node, hess, total)
        value[t] = rate * g / (h + soft)
        margin += value[t, node]
    return Forest(depth, feature, at_most, value, start)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `max_rows` labelled documents that aren't held out.

    The bound holds twice: for the labels that are sent to the tasks, and for what comes back.
    Contradicting labels of one id count as the lower; rows without a label or id are left out.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], ["_id", "_y", "x"])

    rows = (
        slim.join(F.broadcast(picked), "_id")
        .select("_id", F.col("_y").cast("double").alias("_y"), "_text")
        .mapInArrow(run, "_id long, _y double, x array<double>")
        .orderBy(F.xxhash64("_id"), "_id", "x")
        .limit(max_rows)
        .collect()
    )
    return np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r._y for r in rows], np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Forest:
    return fit(*training_rows(docs, labels, max_rows=max_rows))


def score_quality(docs: DataFrame, forest: Forest, text: str = "text", id_col: str = "doc_id", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Only the text decides the score. Null and empty texts are scored on statistics of zero; rows
    with a null id are scored too and never held out; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(2)]).reshape(-1, len(FEATURES))
            score = forest.score(x)
            told = [pa.array(score), pa.array((score >= keep_from).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], [c.split()[0] for c in SCHEMA.split(", ")])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, forest: Forest, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` with a score of at least `keep_from`, all columns as they were.

    Rows pass through the task that scores them, so nothing is joined or shuffled.
    """
    names, kinds = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text))
            x = np.array([statistics(t.as_py()) for t in column]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(forest.score(x) >= keep_from))

    return docs.mapInArrow(run, kinds)
