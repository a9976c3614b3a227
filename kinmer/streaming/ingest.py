"""New prediction files are paired, new wide files annotated; each file is read once.

The state "which files were processed" is the stream's checkpoint. Micro-batches are written to a
folder of their own number, which a retried batch overwrites: results are exact after a failure. Prediction files
land that way by name, and are read and paired in one job at the end of a run (`_pair_landed`): a batch costs next to nothing.

State and results lie in folders of a generation. A run with `force` begins the next generation, in
which everything is read anew, and removes the older ones when it is through; where it breaks off, the
next run, forced or not, has the same newest generation to go on with or to leave behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kinmer.functions.names import base_name
from kinmer.operators.binding import annotate
from kinmer.operators.predictions import drop_identical_peptides, guard_counts, pair_predictions, zip_with_headers
from kinmer.schemas import WIDE
from kinmer.shared import delete_folder, list_folder
from kinmer.sources.readers import parse_predictions, read_lines, read_prediction_files


def _generations(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in list_folder(spark, folder) if n.startswith("generation="))


def read_results(spark: SparkSession, dst: str) -> DataFrame:
    """All results of the newest generation in `dst`."""
    newest = _generations(spark, dst)
    if not newest:
        raise ValueError(f"no results in {dst}")
    return spark.read.parquet(f"{dst}/generation={newest[-1]}").drop("batch")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all files there are in micro-batches, then stop.

    The source looks up each file of a batch in a task of its own; meanwhile the session has it look in a few tasks a core.
    """
    spark, key = stream.sparkSession, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return query


def _next_generation(spark: SparkSession, checkpoint: str, force: bool) -> int:
    known = _generations(spark, checkpoint)
    return (known[-1] if known else 0) + (1 if force and known else 0)


def _drop_older(spark: SparkSession, generation: int, *folders: str) -> None:
    for folder in folders:
        for old in _generations(spark, folder):
            if old < generation:
                delete_folder(spark, f"{folder}/generation={old}")


def run_generation(
    spark: SparkSession, stream: DataFrame, transform: Callable[[DataFrame], DataFrame], dst: str, checkpoint: str, force: bool = False,
    after: Callable[[DataFrame, int, str, str], None] | None = None,
) -> StreamingQuery:
    """`transform` each micro-batch into dst/generation=<g>/batch=<n>; `after` is called with each batch, its number and both folders."""
    generation = _next_generation(spark, checkpoint, force)
    state, out = f"{checkpoint}/generation={generation}", f"{dst}/generation={generation}"

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after is not None:
            after(batch, number, out, state)

    query = run_available(stream, write, f"{state}/stream")
    _drop_older(spark, generation, dst, checkpoint)
    return query


def pair_predictions_with(predictions: DataFrame, headers: DataFrame) -> DataFrame:
    """The wide table of the predictions of whole files."""
    zipped = zip_with_headers(guard_counts(predictions, headers), headers.drop("file"))
    return drop_identical_peptides(pair_predictions(zipped))


def pair_files(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """The same of the lines (file, at, value) of whole prediction files."""
    return pair_predictions_with(parse_predictions(lines), headers)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches in a folder whose writes were completed."""
    return sorted(int(n.split("=")[1]) for n in list_folder(spark, folder) if n.startswith("batch=") and "_SUCCESS" in list_folder(spark, f"{folder}/{n}"))


def _pair_landed(spark: SparkSession, headers: DataFrame, out: str, state: str) -> None:
    """Pair the files of all batches that landed since the last pairing, in one job, and note the files that gave no rows.

    Results go to the number of the first of these batches; the note, which ends the pairing, has the number of the last.
    A run that broke off before the note is done again and writes over the same results, with what landed since.
    """
    paired = max(_numbers(spark, f"{state}/empty"), default=-1)
    new = [n for n in _numbers(spark, f"{state}/landed") if n > paired]
    if new:
        landed = spark.read.schema("path string, file string, size long").parquet(*[f"{state}/landed/batch={n}" for n in new])
        read_prediction_files(landed).write.mode("overwrite").parquet(f"{state}/parsed")
        pair_predictions_with(spark.read.parquet(f"{state}/parsed"), headers).write.mode("overwrite").parquet(f"{out}/batch={new[0]}")
        done = spark.read.parquet(f"{out}/batch={new[0]}").select(F.col("source_file").alias("file")).distinct()
        landed.select("path", "file").distinct().join(done, "file", "left_anti").write.mode("overwrite").parquet(f"{state}/empty/batch={new[-1]}")
    for folder in ("parsed", "landed"):
        delete_folder(spark, f"{state}/{folder}")


def retry_empty(spark: SparkSession, headers: DataFrame, dst: str, checkpoint: str) -> int:
    """Read the files again that gave no rows so far, because their counts didn't match; how many there are.

    Their results are batches of negative numbers. Only names come to the driver, which lists files anyway.
    """
    known = _generations(spark, checkpoint)
    if not known:
        return 0
    state, out = f"{checkpoint}/generation={known[-1]}", f"{dst}/generation={known[-1]}"
    if not list_folder(spark, f"{state}/empty"):
        return 0
    done = spark.read.parquet(out).select(F.col("source_file").alias("file")).distinct()
    left = spark.read.parquet(f"{state}/empty").select("path", "file").distinct().join(done, "file", "left_anti")
    paths = [r.path for r in left.select("path").collect()]
    if paths:
        number = -1 - sum(n.startswith("batch=-") for n in list_folder(spark, out))
        pair_files(read_lines(spark, paths, "\n"), headers).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return len(paths)


def aggregate_stream(
    spark: SparkSession, src: str, headers: DataFrame, dst: str, checkpoint: str, files_per_batch: int = 100, force: bool = False
) -> StreamingQuery:
    """Prediction files that arrived in `src` since the last run, paired into `dst`; see `read_results`.

    Micro-batches land names and sizes, no contents; when the stream is through, all files that landed are read and paired with
    the headers at once (`read_prediction_files`), by pyarrow's file systems, so they must stay until then. A file whose count doesn't
    match its headers yields nothing; each later run reads it again until it does.
    """
    if not force:
        retry_empty(spark, headers, dst, checkpoint)
    listed = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(listed).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(src)
    files = files.select("path", base_name(F.col("path")).alias("file"), F.col("length").alias("size"))  # contents aren't opened
    generation = _next_generation(spark, checkpoint, force)
    out, state = f"{dst}/generation={generation}", f"{checkpoint}/generation={generation}"

    def land(batch: DataFrame, number: int) -> None:
        batch.coalesce(2).write.mode("overwrite").parquet(f"{state}/landed/batch={number}")

    query = run_available(files, land, f"{state}/stream")
    _pair_landed(spark, headers, out, state)
    _drop_older(spark, generation, dst, checkpoint)
    return query


def annotate_stream(
    spark: SparkSession, src: str, dst: str, checkpoint: str, schema: StructType = WIDE, files_per_batch: int = 50, force: bool = False
) -> StreamingQuery:
    """Wide TSV files that arrived in `src` since the last run, annotated into `dst`; see `read_results`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).csv(src, sep="\t", header=True)
    return run_generation(spark, stream, annotate, dst, checkpoint, force)
