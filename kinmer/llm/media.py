"""Media columns: texts' bytes stored as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmer.llm import webp

UNIT = 192
#: Payload bytes decoded in step; a longer image is a batch of its own.
STEP_BYTES = 6 << 20

STORED = "doc_id long, n_bytes long, payload_bytes long, media binary"
FACTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes of the text, these padded with spaces to a positive multiple of 192)."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return len(body), body.ljust(max(1, -(-len(body) // UNIT)) * UNIT, b" ")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def store_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): one lossless WebP file per input row.

    Null and empty texts are 192 spaces. A text is one image, as wide as the format's side limit asks
    for; one beyond `webp.MAX_PAYLOAD` (267 MB) is several, one after the other in `media`. Equal texts give equal files. Ids may repeat or be null; extra columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, batch.column(1)):
                sized = [payload_of(t.as_py()) for t in some.column(1)]
                media = pa.array([webp.encode(p) for _, p in sized], pa.binary())
                sizes = (pa.array([n for n, _ in sized], pa.int64()), pa.array([len(p) for _, p in sized], pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), *sizes, media], _names(STORED))

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, STORED)


def _slices(batch: pa.RecordBatch, sized_by: pa.Array) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about STEP_BYTES in `sized_by`."""
    lengths = np.array([0 if v is None else v for v in pc.binary_length(sized_by).to_pylist()], np.int64)
    run = np.cumsum(lengths) // STEP_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(lengths)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def feature(pixels: np.ndarray) -> str:
    """Mean of the samples and the share of them in each eighth of the range, in thousandths."""
    flat = pixels.ravel()
    mean = int(flat.sum(dtype=np.int64)) * 1000 // len(flat)
    eighths = np.bincount(flat >> 5, minlength=8) * 1000 // flat.size
    return f"mean={mean};hist=" + ",".join(map(str, eighths))


def read_media(stored: DataFrame) -> DataFrame:
    """The FACTS of stored files: digests of the payload read back, of the file, and the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, batch.column(3)):
                files, sizes, rows = some.column(3).to_pylist(), some.column(2).to_pylist(), []
                images = [webp.split_files(f) for f in files]
                decoded = iter(webp.decode_many([i for one in images for i in one]))
                for own, size, file in zip(images, sizes, files):
                    pixels = np.concatenate([next(decoded).ravel() for _ in own])[:size]
                    payload = pixels.tobytes()
                    rows.append(
                        (
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-16:]),
                            len(file),
                            hashlib.sha256(file).hexdigest(),
                            feature(pixels),
                        )
                    )
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                told = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *told], _names(FACTS))

    return stored.mapInArrow(run, FACTS)
