"""Data sources for files whose form Spark doesn't know: planned as byte ranges, written with commit and abort.

`register_formats` gives a session the formats
  bgz_tsv      reads block-gzip tables, a partition for each range of bytes
  predictions  reads prediction files, likewise
  named_files  writes text files with names of the caller's, rows (file, value) in order
  fasta_chunks writes rows (row, value) as numbered chunk files, rows in order

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS), in one that driver and executors share.
"""

from __future__ import annotations

import fnmatch
import gzip
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs  # noqa: F401 - makes pa.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LINES_AT_ONCE = 50_000
#: Bytes of a partition unless the option `split` says otherwise.
SPLIT = 64 << 20
#: Most bytes of a block of a block-gzip file, and the text that is put into one.
MOST_BLOCK = 1 << 16
BLOCK_BYTES = 0xFF00


def register_formats(spark: SparkSession) -> None:
    """Make the formats of this module known to the session."""
    if getattr(spark, "_kinmer_formats", False):
        return
    for source in (BgzTable, Predictions, NamedFiles, FastaChunks):
        spark.dataSource.register(source)
    spark._kinmer_formats = True


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or address and the path in it, for tasks that open files themselves."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def list_files(path: str) -> list[tuple[str, int]]:
    """(address, size) of the files of a folder, of one file, or of a pattern with * and ?."""
    system, root = file_system(path)
    scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
    if re.search(r"[*?]", root):
        base = root[: re.search(r"[*?]", root).start()].rsplit("/", 1)[0]
        depth = root.count("/")
        found = [f for f in system.get_file_info(pa.fs.FileSelector(base, recursive=True)) if f.path.count("/") == depth and fnmatch.fnmatchcase(f.path, root)]
    else:
        info = system.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(root))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def delete_files(path: str) -> None:
    """Remove a folder of very many files, by the file system that wrote them; `shared.delete_folder` looks at each file first."""
    system, root = file_system(path)
    system.delete_dir(root)


def base_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    size: int
    value: None = field(default=None, repr=False)


@dataclass
class FileRanges(InputPartition):
    ranges: list[FileRange]
    value: None = field(default=None, repr=False)


#: Partitions of a scan, unless a range each makes fewer.
MOST_PARTITIONS = 2000


class RangeReader(DataSourceReader):
    """Plans ranges of files of at most `split` bytes; the option pathGlobFilter chooses files by their names.

    Neighbouring small ranges share a partition of up to `split` bytes, or of more where these would be over MOST_PARTITIONS.

    Filters on the file's name are not pushed down: Spark 4.1 keeps what a Python source was pushed in the relation,
    where other queries on the same DataFrame meet it, so that they would miss rows.
    """

    file_column = "source_file"

    def __init__(self, options: dict[str, str], schema: StructType):
        self.schema = schema
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split, self.pattern = int(options.get("split", SPLIT)), options.get("pathGlobFilter", "*")

    def partitions(self) -> Sequence[FileRanges]:
        files = [f for p in self.paths for f in list_files(p) if fnmatch.fnmatchcase(base_of(f[0]), self.pattern)]
        most, held, parts = max(self.split, -(-sum(n for _, n in files) // MOST_PARTITIONS)), 0, []
        for path, n in files:
            for at in range(0, max(n, 1), self.split):
                end = min(at + self.split, n)
                if not parts or held + end - at > most:
                    parts.append(FileRanges([]))
                    held = 0
                parts[-1].ranges.append(FileRange(path, at, end, n))
                held += end - at
        return parts

    def rows(self, part: FileRange, f: pa.NativeFile) -> Iterator[list]:
        """Values of the schema's columns, row by row."""
        raise NotImplementedError

    def read(self, part: FileRanges) -> Iterator[pa.RecordBatch]:
        kinds = [{"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()] for f in self.schema]
        rows = itertools.chain.from_iterable(self.rows_of(r) for r in part.ranges)
        while some := list(itertools.islice(rows, LINES_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], self.schema.names)

    def rows_of(self, part: FileRange) -> Iterator[list]:
        system, place = file_system(part.path)
        with system.open_input_file(place) as f:
            yield from self.rows(part, f)


def typed(value: str | None, kind: str) -> str | float | int | None:
    """A field's value, null if it isn't of the type."""
    if value is None or kind == "string":
        return value
    try:
        return float(value) if kind == "double" else int(value)
    except ValueError:
        return None


def lines_between(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), to their ends."""
    at = max(start - 1, 0)
    f.seek(at)
    rest, skips = b"", start > 0
    while True:
        data = f.read(1 << 20)
        *lines, rest = (rest + data).split(b"\n")
        for line in lines:
            if not skips:
                if at >= end:
                    return
                yield line
            skips = False
            at += len(line) + 1
        if not data:
            if rest and not skips and at < end:
                yield rest
            return
        if not skips and at >= end:
            return


# Block-gzip tables


def _block_at(buffer: bytes, at: int) -> int | None:
    """The whole size of the block-gzip block that begins at this place, None if none does."""
    if buffer[at : at + 4] != b"\x1f\x8b\x08\x04" or buffer[at + 10 : at + 16] != b"\x06\x00BC\x02\x00" or len(buffer) < at + 18:
        return None
    return int.from_bytes(buffer[at + 16 : at + 18], "little") + 1


def _blocks(f: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the blocks of a block-gzip file from the first that begins at `start` or later."""
    f.seek(start)
    buffer = f.read(2 * MOST_BLOCK)
    for skip in range(len(buffer)):
        n = _block_at(buffer, skip)
        # What looks like a block is one if it ends the file or another follows it.
        if n and (start + skip + n == size or _block_at(buffer, skip + n)):
            break
    else:
        return
    at = start + skip
    while at < size:
        f.seek(at)
        block = f.read(MOST_BLOCK)
        n = _block_at(block, 0)
        if n is None:
            raise ValueError(f"no block at {at}")
        yield at, zlib.decompress(block[18 : n - 8], -15)
        at += n


def _lines_of_split(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """Lines of the blocks that begin in [start, end): the first, which the split before reads to its end, but for the file's own; and one line more."""
    rest, skips, alone = b"", start > 0, True
    for at, text in _blocks(f, start, size):
        if at >= end and (skips or alone):  # not a line begins in the split
            return
        rest += text
        lines = rest.split(b"\n")
        rest = lines.pop()
        if skips and lines:
            lines, skips = lines[1:], False
        if at < end:
            alone = False
            yield from lines
        elif lines:
            yield lines[0]
            return
    if rest and not skips:
        yield rest


class BgzReader(RangeReader):
    def rows(self, part: FileRange, f: pa.NativeFile) -> Iterator[list]:
        if _block_at(f.read(18), 0):
            head = next(_lines_of_split(f, 0, 1, part.size), b"")
            lines = _lines_of_split(f, part.start, part.end, part.size)
        elif part.start:
            return  # plain gzip can't be entered midway: the first range's task reads it as a stream
        else:
            f.seek(0)
            lines = (line.rstrip(b"\n") for line in gzip.open(f))
            head = None
        if part.start == 0:
            head = next(lines, b"")
        names = head.decode().rstrip("\r").split("\t")
        name, kinds = base_of(part.path), [(c.name, c.dataType.simpleString()) for c in self.schema]
        places = [names.index(c) if c in names else None for c, _ in kinds]
        for line in lines:
            if line:
                values = line.decode().rstrip("\r").split("\t")
                yield [name if c == self.file_column and p is None else typed(values[p], k) if p is not None and p < len(values) else None for (c, k), p in zip(kinds, places)]


class BgzTable(DataSource):
    """Columns by name, null where a file lacks them or a value isn't of the type; `source_file` is the file's name."""

    @classmethod
    def name(cls) -> str:
        return "bgz_tsv"

    def reader(self, schema: StructType) -> BgzReader:
        return BgzReader(self.options, schema)


# Prediction files


class PredictionReader(RangeReader):
    def rows(self, part: FileRange, f: pa.NativeFile) -> Iterator[list]:
        heads = list(itertools.islice(lines_between(f, 0, part.size), 2))
        first, second = (*(h.decode().rstrip("\r") for h in heads), "", "")[:2]
        own = {"source_file": base_of(part.path), "Allele": next(iter(first.split()), "Unknown"), "block": part.start}
        names = [n.strip() for n in second.split("\t")]
        kinds = [(c.name, c.dataType.simpleString()) for c in self.schema]
        begin = sum(len(h) + 1 for h in heads)  # of the first row
        row = 0
        for line in lines_between(f, max(part.start, begin), part.end):
            text = line.decode().replace("\r", "")
            if text.strip():
                values = dict(zip(names, text.split("\t")))
                yield [own[c] if c in own else row if c == "row" else typed(values[c].strip() if c in values else None, k) for c, k in kinds]
                row += 1


#: Endings of files that are read as one stream, which can't be entered midway.
PACKED = r"\.(gz|bz2|zst|lz4)$"


def prediction_text(path: str, start: int, end: int | None) -> tuple[str, str, str]:
    """Both first lines of a prediction file and the text of its other lines that begin in [start, end), to the file's end if that is None."""
    system, place = file_system(path)
    with system.open_input_stream(place) if re.search(PACKED, path) else system.open_input_file(place) as f:
        if end is None:
            first, second, text = (*f.read().split(b"\n", 2), b"", b"")[:3]
        else:
            heads = list(itertools.islice(lines_between(f, 0, 1 << 62), 2))
            first, second = heads
            text = b"\n".join(lines_between(f, max(start, sum(len(h) + 1 for h in heads)), end))
    return tuple(t.decode(errors="replace") for t in (first, second, text))


class Predictions(DataSource):
    """Rows of prediction files: line 1 begins with the allele, line 2 names the columns; `row` counts from 0 in each `block`."""

    @classmethod
    def name(cls) -> str:
        return "predictions"

    def schema(self) -> str:
        return "source_file string, block bigint, row bigint, Allele string, Peptide string, BA_score double, BA_Rank double"

    def reader(self, schema: StructType) -> PredictionReader:
        return PredictionReader(self.options, schema)


# Files with names of the caller's


def bgzf(data: bytes) -> bytes:
    """One block of the block-gzip format."""
    packer = zlib.compressobj(wbits=-15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (name in the job's folder, name that it shall have)."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    """Tasks write into a hidden folder of the job; the driver moves the files of the attempts that count when all are done.

    A job that fails, and an attempt that doesn't count, leave nothing: the folder goes with the job either way.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.header = f"{options['header']}\n".encode() if "header" in options else b""
        self.folder = f".job-{uuid.uuid4().hex}"

    def named(self, batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
        """(file, line) of each row."""
        return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        own = uuid.uuid4().hex  # tasks don't wait for each other at one folder
        system.create_dir(f"{root}/{self.folder}/{own}", recursive=True)
        done = []
        rows = itertools.chain.from_iterable(self.named(b) for b in iterator)
        for file, part in itertools.groupby(rows, key=lambda r: r[0]):
            fresh = f"{own}/{len(done)}"
            packer = zlib.compressobj(wbits=31) if file.endswith(".gz") else None
            pack = packer.compress if packer else bgzf if file.endswith(".bgz") else bytes
            with system.open_output_stream(f"{root}/{self.folder}/{fresh}", compression=None) as out:
                held = self.header
                for _, line in part:
                    held += line.encode() + b"\n"
                    while len(held) >= BLOCK_BYTES:
                        out.write(pack(held[:BLOCK_BYTES]))
                        held = held[BLOCK_BYTES:]
                out.write(pack(held) + (packer.flush() if packer else bgzf(b"") if file.endswith(".bgz") else b""))
            done.append((fresh, file))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        twice = len(names) - len(set(names))
        folders = {f"{root}/{n.rpartition('/')[0]}".rstrip("/") for n in names}
        old = {i.path for folder in folders for i in system.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))}  # one listing, not a look at each name
        there = [n for n in names if not self.overwrite and f"{root}/{n}" in old]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"{twice} names of files come from several tasks" if twice else f"{there[0]} exists")
        for folder in folders:
            system.create_dir(folder, recursive=True)

        for fresh, name in files:
            if f"{root}/{name}" in old:
                system.delete_file(f"{root}/{name}")
            system.move(f"{root}/{self.folder}/{fresh}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.folder}").type != pa.fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.folder}")


class NamedFiles(DataSource):
    """Rows (file, value): lines of text files, those of a file one after the other in one task.

    Names that end in .bgz or .gz make files of that form; the option `header` is a first line of each.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options, overwrite)


class FastaChunkWriter(NamedFilesWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options, overwrite)
        self.records, self.per_dir = int(options.get("records", 100)), int(options.get("per_dir", 50))
        if self.records % 2:
            raise ValueError("an odd number of records would part a pair")

    def named(self, batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
        for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunk = row * 2 // self.records + 1
            yield f"chunk_{(chunk - 1) // self.per_dir + 1}/matched_pairs_chunk_{chunk}.fasta", value


class FastaChunks(DataSource):
    """Rows (row, value), value both records of pair number `row`: files of `records` records, `per_dir` files a folder."""

    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def writer(self, schema: StructType, overwrite: bool) -> FastaChunkWriter:
        return FastaChunkWriter(self.options, overwrite)
