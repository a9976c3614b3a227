"""Scans: FASTA, hit tables, predictions, id lists, cluster listings, JSON pages, inventories, LD triples."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinmer.functions.names import chunk_no
from kinmer.functions.sequences import accession, pair_header
from kinmer.operators.segments import join_splits, number_lines, scan_splits
from kinmer.schemas import HITS, LD_INDEX, LD_TRIPLES
from kinmer.sources.formats import PACKED, SPLIT, prediction_text, register_formats


def read_lines(spark: SparkSession, path: str | Sequence[str], sep: str | None = None) -> DataFrame:
    """(file, at, value): records of text files; `at` orders a file's records and is no number.

    Large files are split; a record's place is the start of its split and its row within the task.
    """
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return reader.text(path).select(F.col("_metadata.file_name").alias("file"), at.alias("at"), "value")


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, rec_no, id, acc, seq), plain or .gz, lines of a record joined. rec_no orders records.

    The id is the header up to white space. Duplicates are kept; `lookup_sequences` takes the last.
    """
    records = read_lines(spark, path, "\n>").select("file", F.col("at").alias("rec_no"), F.regexp_replace("value", "^>", "").alias("_r"))
    head = F.substring_index("_r", "\n", 1)
    seq = F.regexp_replace(F.substr("_r", F.length(head) + 1, F.length("_r")), r"\s", "")
    name = F.get(F.split(F.trim(F.regexp_replace(head, r"\s", " ")), " "), 0)
    return records.filter(F.trim(F.regexp_replace("_r", r"\s", " ")) != "").select("file", "rec_no", name.alias("id"), accession(name).alias("acc"), seq.alias("seq"))


def read_pair_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, chunk, row_no, type, pair_id, uniprot) of headers with four parts, numbered from 0 in each file."""
    parsed = read_fasta(spark, path).select("file", F.col("rec_no").alias("at"), pair_header(F.col("id")).alias("_h")).filter("_h IS NOT NULL")
    numbered = number_lines(parsed, "row_no")
    return numbered.select("file", chunk_no(F.col("file")).alias("chunk"), F.col("row_no").cast("int").alias("row_no"), "_h.*")


def read_hits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S3: headerless tab-separated alignment hits."""
    return spark.read.csv(path, sep="\t", schema=HITS)


def parse_predictions(lines: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Prediction rows of the lines of files (file, at, value): source_file, chunk, Allele, row_no and `columns`.

    The allele is the first token of line 1, Unknown if that is empty; line 2 names the columns, whose
    places may differ from file to file. `columns` maps names to types; values that aren't of the type,
    and columns a file lacks, are null. Blank lines don't count in `row_no`. A file is read by as many tasks
    as it has splits: each numbers its own lines, and one row a split says how many come before (`number_lines`).
    """
    return join_predictions(scan_predictions(lines), columns)


def scan_predictions(lines: DataFrame) -> DataFrame:
    """The first half of `parse_predictions`: lines, numbered within their splits by the tasks that read them. They may be kept."""
    clean = F.regexp_replace("value", "\r", "")
    told = lines.withColumns({"value": clean, "told": F.trim(clean) != ""})
    return scan_splits(told, "line_no", {"told_before": "told"})


def join_predictions(scanned: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The second half of `parse_predictions`: the rows of scanned lines of whole files."""
    wanted = columns or {"Peptide": "string", "BA_score": "double", "BA_Rank": "double"}
    numbered = join_splits(scanned.select("file", "at", "value", "told", "line_no", "told_before"), "line_no", {"told_before": "told"})
    head = numbered.filter("line_no < 2").groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 0, F.col("value"))).alias("first"), F.max(F.when(F.col("line_no") == 1, F.col("value"))).alias("second"), F.count_if("told").alias("heads")
    )
    allele = F.coalesce(F.nullif(F.get(F.split(F.trim("first"), r"\s+"), 0), F.lit("")), F.lit("Unknown"))
    head = head.select("file", allele.alias("Allele"), F.transform(F.split("second", "\t"), F.trim).alias("names"), "heads")
    rows = numbered.filter("line_no >= 2 AND told").join(head, "file")

    def field(name: str, kind: str) -> Column:
        at = F.array_position("names", name)
        return F.when(at > 0, F.trim(F.get(F.split("value", "\t"), (at - 1).cast("int")))).try_cast(kind).alias(name)

    return rows.select(
        F.col("file").alias("source_file"), chunk_no(F.col("file")).alias("chunk"), "Allele", (F.col("told_before") - F.col("heads")).cast("int").alias("row_no"),
        *[field(n, k) for n, k in wanted.items()],
    )


#: Small files of a task of `read_prediction_files`, and bytes of a range of a large one.
FILES_A_TASK, RANGE = 1000, 4 << 20


def read_prediction_files(files: DataFrame, columns: dict[str, str] | None = None, split: int = RANGE) -> DataFrame:
    """S4 of the files that a table (path, file, size) lists, however many: the rows of `parse_predictions`.

    The list is data that is dealt to tasks: these open many small files each, and large ones in ranges of `split` bytes. Python
    brings a range's text and its file's first lines, Spark takes it apart. Of a file of several ranges each counts its rows,
    and a row a range says how many come before.
    """
    wanted = columns or {"Peptide": "string", "BA_score": "double", "BA_Rank": "double"}
    n, total, most = files.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    tasks = max(min(n, files.sparkSession.sparkContext.defaultParallelism), -(-n // FILES_A_TASK), -(-(total or 0) // SPLIT), 1)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n_bytes = [], 0
            for path, file, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((path, file, start, *prediction_text(path, start, end)))
                n_bytes += len(held[-1][-1])
                if n_bytes >= split:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)
                    held, n_bytes = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)

    names = ["path", "file", "start", "first", "second", "text"]
    one = (F.col("size") <= split) | F.col("path").rlike(PACKED)

    def ranges(listed: DataFrame, start: Column, end: Column) -> DataFrame:
        dealt = listed.select("path", "file", start.alias("start"), "size").select("path", "file", "start", end.alias("end")).repartition(tasks)
        told = dealt.mapInArrow(texts, "path string, file string, start long, first string, second string, text string")
        clean = told.select("path", "file", "start", *[F.regexp_replace(c, "\r", "").alias(c) for c in ("first", "second", "text")])
        allele = F.coalesce(F.nullif(F.get(F.split(F.trim("first"), r"\s+"), 0), F.lit("")), F.lit("Unknown"))
        places = F.transform(F.split("second", "\t"), F.trim)
        at = F.array(*[F.array_position(places, c).cast("int") for c in wanted])
        return clean.select("path", "file", "start", chunk_no(F.col("file")).alias("chunk"), allele.alias("Allele"), at.alias("places"), "text")

    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    told = ranges(files.filter(one), F.lit(0).cast("long"), F.lit(None).cast("long")).withColumn("before", F.lit(0).cast("long"))
    if (most or 0) > split:
        large = ranges(files.filter(~one), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))), F.least(F.col("start") + split, F.col("size")))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = large.select("path", "start", F.size(lines).cast("long").alias("n")).select("path", "start", before.alias("before"))
        told = told.unionByName(large.join(counts.hint("shuffle_hash"), ["path", "start"]))
    rows = told.select("file", "chunk", "Allele", "places", "before", F.posexplode(lines).alias("k", "line")).withColumn("line", F.split("line", "\t"))

    def field(k: int, name: str, kind: str) -> Column:
        place = F.col("places")[k]
        return F.when(place > 0, F.trim(F.get("line", place - 1))).try_cast(kind).alias(name)

    return rows.select(F.col("file").alias("source_file"), "chunk", "Allele", (F.col("before") + F.col("k")).cast("int").alias("row_no"), *[field(k, *w) for k, w in enumerate(wanted.items())])


def read_predictions(spark: SparkSession, path: str | Sequence[str], columns: dict[str, str] | None = None) -> DataFrame:
    """S4 from files."""
    return parse_predictions(read_lines(spark, path, "\n"), columns)


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, glob: str | None = None) -> DataFrame:
    """Tab-separated files with a header, gz or plain, chosen by a name pattern."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    return reader.csv(path, sep="\t", header=True, schema=schema)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """Comma-separated files with a header."""
    return spark.read.csv(path, header=True, schema=schema)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """The annotated dataset; filters on allele_safe prune its folders."""
    return spark.read.parquet(path)


def read_bgz_tsv(spark: SparkSession, path: str | Sequence[str], schema: StructType, split: int = 64 << 20) -> DataFrame:
    """Block-gzip tab-separated files with a header; columns by name, unparsable values null.

    Spark knows no codec for the ending; the format `bgz_tsv` plans a partition for each range of `split` bytes.
    A file in plain gzip, which can't be entered midway, is read as a stream by the task of its first range.
    """
    register_formats(spark)
    paths = json.dumps([path] if isinstance(path, str) else list(path))
    texts = spark.read.format("bgz_tsv").schema(", ".join(f"`{f.name}` string" for f in schema)).option("paths", paths).option("split", split).load()
    return texts.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def load_predictions(spark: SparkSession, path: str | Sequence[str], columns: dict[str, str] | None = None, glob: str = "*", split: int = 64 << 20) -> DataFrame:
    """S4 by the format `predictions`, with the columns of `read_predictions`: files whose names fit `glob` are chosen before any is opened.

    Each range of a file is parsed by its own task; rows are numbered over ranges as in `number_lines`.
    """
    register_formats(spark)
    wanted = columns or {"Peptide": "string", "BA_score": "double", "BA_Rank": "double"}
    told = ", ".join(["source_file string", "block bigint", "row bigint", "Allele string", *[f"`{n}` {k}" for n, k in wanted.items()]])
    paths = json.dumps([path] if isinstance(path, str) else list(path))
    rows = spark.read.format("predictions").schema(told).option("paths", paths).option("pathGlobFilter", glob).option("split", split).load()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy(F.col("source_file").alias("file"), F.col("block").alias("no")).agg(F.count(F.lit(1)).alias("n")).select("file", "no", before.alias("before"))
    numbered = rows.join(ranges, (F.col("source_file") == F.col("file")) & (F.col("block") == F.col("no")))
    return numbered.select("source_file", chunk_no(F.col("source_file")).alias("chunk"), "Allele", (F.col("before") + F.col("row")).cast("int").alias("row_no"), *[F.col(f"`{n}`") for n in wanted])


def read_ids(spark: SparkSession, path: str | Sequence[str], name: str = "id") -> DataFrame:
    """(name, input_pos): one id a line, blanks skipped, in an orderable place."""
    lines = read_lines(spark, path).withColumn(name, F.trim(F.regexp_replace("value", "\r", "")))
    return lines.filter(F.col(name) != "").select(name, F.struct("file", "at").alias("input_pos"))


def read_allele_list(spark: SparkSession, path: str | Sequence[str], missing: str = "self") -> DataFrame:
    """(id, name) of white-space separated lines; a line with an id only names itself, or is skipped."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ", 2)
    rows = read_lines(spark, path).filter(F.trim("value") != "").select(F.get(parts, 0).alias("id"), F.get(parts, 1).alias("name"))
    return rows.withColumn("name", F.coalesce("name", "id")) if missing == "self" else rows.filter("name IS NOT NULL")


def read_pseudoseq(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(id, seq) of white-space separated lines."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return read_lines(spark, path).select(F.get(parts, 0).alias("id"), F.get(parts, 1).alias("seq")).filter("seq IS NOT NULL")


def read_clusters(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(cluster, representative, member, pos) of a cluster listing.

    Members stand between `>` and `...`; the one marked `*` represents; clusters without one drop.
    """
    lines = read_lines(spark, path).withColumn("_own", F.when(F.col("value").startswith(">"), F.trim(F.substr("value", F.lit(2)))))
    placed = number_lines(lines.withColumn("_heads", F.col("_own").isNotNull()), "line_no", {"cluster_no": "_heads"}, {"cluster": "_own"}).filter("_own IS NULL")
    member = F.nullif(F.regexp_extract("value", r">(.*?)\.\.\.", 1), F.lit(""))
    rows = placed.select("file", "cluster_no", "cluster", F.col("at").alias("pos"), member.alias("member"), F.trim("value").endswith("*").alias("_star")).filter("member IS NOT NULL")
    # Of a cluster one row at most has the mark, so this is an equal join of rows with few others.
    marked = rows.filter("_star").groupBy("file", "cluster_no").agg(F.max("member").alias("representative"))
    return rows.join(marked, ["file", "cluster_no"]).select("cluster", "representative", "member", "pos")


def read_json_pages(spark: SparkSession, path: str | Sequence[str], schema: StructType, max_records: int | None = None) -> DataFrame:
    """Landed pages of records, each file a JSON array; max_records caps them."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows if max_records is None else rows.limit(max_records)


def file_inventory(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, file, size, chunk) of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader if glob is None else reader.option("pathGlobFilter", glob)).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), F.col("length").alias("size"), chunk_no(name).alias("chunk"))


def read_ld(spark: SparkSession, triples: str, index: str, pop: str = "EUR") -> tuple[DataFrame, DataFrame]:
    """(triples of a population, variant index), Parquet; the population's folder alone is read."""
    rows = spark.read.schema(LD_TRIPLES).parquet(triples).filter(F.col("pop") == pop)
    return rows.select("i", "j", "r"), spark.read.schema(LD_INDEX).parquet(index)


def read_ld_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, r, ti, tj, fi, fj) of a store in tiles; joins on fi and fj choose its folders, filters on ti and tj row groups."""
    return spark.read.schema("i long, j long, r double, ti int, tj int, fi int, fj int").parquet(path)


def read_matrix(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """K9: (variant, other, r), a row for each cell of matrix files, plain or .gz, whose first lines name their columns.

    A file is a block, bounded by its writer (`write_matrix_blocks`, `write_matrix`), and is read as one value, so a
    header meets its rows without a join and no cell moves. A row that is short has nulls. Lines are chosen by a lambda, which
    Spark doesn't compile with what follows: of a file's cells, a line's are made at a time.
    """
    files = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    lines = F.filter(F.expr("slice(lines, 2, size(lines))"), lambda line: line != "")
    told = files.select(F.split(F.get("lines", F.lit(0)), "\t").alias("names"), "lines").select(F.expr("slice(names, 2, size(names))").alias("names"), "lines")
    rows = told.select("names", F.explode(lines).alias("line")).select("names", F.split("line", "\t").alias("cells"))
    cells = rows.select(F.get("cells", F.lit(0)).alias("variant"), "cells", F.posexplode("names").alias("k", "other"))
    cell = F.get("cells", F.col("k") + 1)
    return cells.select("variant", "other", F.when(cell == "0.0", F.lit(0.0)).otherwise(cell.cast("double")).alias("r"))
