"""Queries over files: the standard tables written by each sink, read back by the scan of that form, and streams over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.functions import names, sequences
from kinmer.operators import alleles, binding, casecontrol, common, hits, inventory, ld
from kinmer.operators import sequences as seq_operators
from kinmer.plans import inputs
from kinmer.plans.inputs import ALLELE_SQL, ANNOTATED_SQL, LD_SQL, table, text
from kinmer.schemas import HITS, LD_INDEX, LD_TRIPLES, WIDE, GWAS_P, ID_MAPPING
from kinmer.shared import cut, delete_folder, shared_folder
from kinmer.sources import formats, readers, writers
from kinmer.streaming import ingest

QUERIES, ORACLES = {}, {}


def query(sql: str | None, lasting: bool = False):
    """Registers a query that gets a folder of its own in the shared one; its rows are written before the folder goes.

    The rows of a `lasting` query, which may be far more than its files, are read from its folder when they are wanted. Like that
    of `pipeline` the folder stays.
    """

    def add(f: Callable[[SparkSession, str, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder = f"{shared_folder(spark)}/{f.__name__}-{uuid.uuid4().hex}"
            rows = f(spark, sf_dir, folder)
            if not lasting:
                rows = cut(rows)
                delete_folder(spark, folder)
            return rows

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return add


def _lines(file: Column, at: Column, value: Column, df: DataFrame) -> DataFrame:
    return df.select(file.alias("file"), at.cast("long").alias("at"), value.alias("value"))


@query("""
SELECT 'sp|' || CAST(item_id AS VARCHAR) || '|B' AS id, CAST(item_id AS VARCHAR) AS acc, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq
FROM benchmark""")
def fasta_records(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Benchmark texts as protein records."""
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("sp|"), text("item_id"), F.lit("|B")).alias("id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    writers.write_fasta(rows, folder)
    return readers.read_fasta(spark, folder).select("id", "acc", "seq")


_PAIRS_SQL = "SELECT p_partkey AS pep, row_number() OVER (ORDER BY p_partkey) - 1 AS n, 'V' || p_size AS v, 'H' || p_type AS h FROM part"


@query(f"""
SELECT CAST(n * 2 // 500 + 1 AS INT) AS chunk, (n * 2 + side) % 500 AS row_no, CASE WHEN side = 0 THEN 'VIRAL' ELSE 'HUMAN' END AS type,
       CAST(pep AS VARCHAR) || '_1' AS pair_id, CASE WHEN side = 0 THEN v ELSE h END AS uniprot
FROM ({_PAIRS_SQL}), (VALUES (0), (1)) s(side)""")
def chunked_pairs(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Parts as peptide pairs in numbered chunk files, and their headers."""
    pairs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pep"), F.lit(1).alias("i"), F.concat(F.lit("V"), text("p_size")).alias("uniprot_viral"),
        F.concat(F.lit("H"), "p_type").alias("uniprot_human"), F.lit("ACDEFGHIK").alias("peptide_viral"), F.lit("ACDEFGHIL").alias("peptide_human"),
    )
    pairs = pairs.withColumn("uniprot_human", F.regexp_replace("uniprot_human", " ", "-"))
    writers.write_fasta_chunks(pairs, folder, ["pep"], n=500)
    told = readers.read_pair_headers(spark, f"{folder}/*/*.fasta")
    return told.select("chunk", F.col("row_no").cast("long").alias("row_no"), "type", "pair_id", F.regexp_replace("uniprot", "-", " ").alias("uniprot"))


@query(f"SELECT CAST(qseqid AS VARCHAR) AS qseqid, hu_prot_id, round(similarity, 6) AS similarity FROM ({inputs.HITS_SQL})")
def hit_table(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Orders as a headerless table of hits."""
    rows = inputs.hits(spark, sf_dir)
    rows.select(*[F.col(c.name).cast(c.dataType) if c.name in rows.columns else F.lit(0).cast(c.dataType) for c in HITS]).write.csv(folder, sep="\t")
    return hits.with_similarity(readers.read_hits(spark, folder)).select("qseqid", "hu_prot_id", F.round("similarity", 6).alias("similarity"))


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_NUMBERED_SQL = f"""
SELECT l_suppkey AS chunk, l_returnflag AS flag, 'P' || CAST(l_partkey AS VARCHAR) AS peptide, CAST(l_quantity AS DOUBLE) AS score,
       CAST(l_tax AS DOUBLE) AS rank, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS row_no
FROM lineitem"""


def _prediction_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Writes a prediction file for each supplier and flag; the headers of a supplier are as many as its A rows.

    The window that numbers a file's rows leaves them in order in one task, which writes them; its first row brings the head along.
    """
    lines = table(spark, sf_dir, "lineitem").withColumns({"chunk": F.col("l_suppkey"), "flag": F.col("l_returnflag")})
    numbered = common.number_chunks(lines, 1, ["chunk", "flag"], _LINE_ORDER, "row_no")
    file = F.concat(F.lit("x_chunk_"), text("chunk"), F.lit("_"), "flag", F.lit(".xls"))
    head = F.when(F.col("row_no") == 0, F.concat(F.lit("HLA-"), "flag", F.lit("\nPeptide\tBA_score\tBA_Rank\n"))).otherwise("")
    line = F.concat_ws("\t", F.concat(F.lit("P"), text("l_partkey")), text("l_quantity"), text("l_tax"))
    writers.write_named_files(_lines(file, F.col("row_no"), F.concat(head, line), numbered), folder, dealt=True)
    counted = lines.filter("flag = 'A'").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row_no")).select(
        F.lit("f").alias("file"), "chunk", "row_no",
        F.when(F.col("row_no") % 2 == 0, "VIRAL").otherwise("HUMAN").alias("type"),
        F.concat(F.lit("p_"), text(F.floor(F.col("row_no") / 2))).alias("pair_id"),
    )


@query(f"""
WITH pred AS ({_NUMBERED_SQL}), want AS (SELECT chunk, count(*) AS n FROM pred WHERE flag = 'A' GROUP BY 1),
ok AS (SELECT chunk, flag FROM pred GROUP BY chunk, flag HAVING count(*) = (SELECT n FROM want WHERE want.chunk = pred.chunk)),
rows AS (SELECT *, row_no // 2 AS pair, row_no % 2 AS side FROM pred JOIN ok USING (chunk, flag))
SELECT 'x_chunk_' || CAST(v.chunk AS VARCHAR) || '_' || v.flag || '.xls' AS source_file, 'HLA-' || v.flag AS allele,
       'p_' || CAST(v.pair AS VARCHAR) AS pair_id, v.peptide AS peptide_viral, h.peptide AS peptide_human,
       v.score AS ba_score_viral, h.score AS ba_score_human, v.rank AS ba_rank_viral, h.rank AS ba_rank_human
FROM rows v JOIN rows h ON v.chunk = h.chunk AND v.flag = h.flag AND v.pair = h.pair AND v.side = 0 AND h.side = 1
WHERE v.peptide != h.peptide""")
def streamed_predictions(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Prediction files that arrive, zipped with their headers and paired."""
    headers = _prediction_files(spark, sf_dir, f"{folder}/in")
    ingest.aggregate_stream(spark, f"{folder}/in", headers, f"{folder}/out", f"{folder}/state", files_per_batch=2000)
    formats.delete_files(f"{folder}/in")
    rows = ingest.read_results(spark, f"{folder}/out")
    told = ["source_file", "Allele", "pair_id", *[f"{c}_{side}" for c in ("Peptide", "BA_score", "BA_Rank") for side in ("viral", "human")]]
    return rows.select(*[F.col(c).alias(c.lower()) for c in told])


@query(f"""
SELECT 'x_chunk_' || CAST(chunk AS VARCHAR) || '_A.xls' AS source_file, 'HLA-A' AS allele, row_no, peptide, score, rank FROM ({_NUMBERED_SQL}) WHERE flag = 'A'""")
def ranged_predictions(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """S4 by byte ranges: the prediction files of flag A, chosen by their names, each read by several tasks."""
    _prediction_files(spark, sf_dir, folder)
    rows = readers.load_predictions(spark, folder, glob="*_A.xls", split=64 << 10)
    return rows.select("source_file", F.col("Allele").alias("allele"), F.col("row_no").cast("long").alias("row_no"), F.col("Peptide").alias("peptide"), F.col("BA_score").alias("score"), F.col("BA_Rank").alias("rank"))


@query("""
SELECT l_suppkey AS chunk, count(DISTINCT l_returnflag) AS n_files, bool_or(l_returnflag = 'A') AS processed FROM lineitem GROUP BY 1""")
def listed_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The inventory of those files; chunks that have one of flag A count as processed."""
    _prediction_files(spark, sf_dir, folder)
    files = readers.file_inventory(spark, folder, "*.xls").withColumn("chunk", F.col("chunk").cast("long"))
    every = files.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_files"))
    processed, left = inventory.split_done(every, files.filter(F.col("file").endswith("_A.xls")))
    return processed.withColumn("processed", F.lit(True)).union(left.withColumn("processed", F.lit(False)))


_ANNOTATED_COLUMNS = "pair_id, allele, cls AS binding_class, round(diff, 6) AS ba_score_diff"


@query(f"SELECT {_ANNOTATED_COLUMNS} FROM ({ANNOTATED_SQL})")
def streamed_annotations(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Wide tables as gz TSV parts that arrive, annotated."""
    wide = inputs.wide(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in WIDE])
    writers.write_tsv_parts(wide, f"{folder}/in", 50_000)
    ingest.annotate_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state")
    rows = ingest.read_results(spark, f"{folder}/out")
    return rows.select("pair_id", "allele", F.col("Binding_Class").alias("binding_class"), F.round("BA_score_diff", 6).alias("ba_score_diff"))


@query(f"SELECT {_ANNOTATED_COLUMNS} FROM ({ANNOTATED_SQL}) WHERE allele_safe LIKE 'HLA-A%'")
def annotated_folders(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The annotated table in a folder for each allele; those of one letter are read."""
    writers.write_annotated(binding.annotate(inputs.wide(spark, sf_dir)), folder)
    rows = readers.read_annotated(spark, folder).filter(F.col("allele_safe").startswith("HLA-A"))
    return rows.select("pair_id", "allele", F.col("Binding_Class").alias("binding_class"), F.round("BA_score_diff", 6).alias("ba_score_diff"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def tsv_parts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Orders as gz TSV parts, chosen by their ending."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    writers.write_tsv_parts(rows, folder, 10_000)
    return readers.read_tsv(spark, folder, rows.schema, "*.gz")


@query("""
WITH runs AS (SELECT *, o_orderstatus = 'F' AS first FROM orders),
placed AS (SELECT *, (row_number() OVER (PARTITION BY first ORDER BY o_orderkey) - 1) // 400 AS part FROM runs),
parts AS (SELECT *, part + 1 + CASE WHEN first THEN 0 ELSE (SELECT coalesce(max(part) + 1, 0) FROM placed WHERE first) END AS no FROM placed)
SELECT printf('part_%05d.tsv.gz', no) AS file, count(*) AS n_rows, min(o_orderkey) AS least, max(o_orderkey) AS most FROM parts GROUP BY no""")
def numbered_parts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Two runs of orders as numbered parts of 400 rows, the second going on where the first ended; the rows of each part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    done = F.col("o_orderstatus") == "F"
    told = [writers.write_numbered_parts(orders.filter(c), folder, ["o_orderkey"], 400) for c in (done, ~done)]
    read = readers.read_tsv(spark, folder, orders.schema, "part_*.tsv.gz").groupBy(F.col("_metadata.file_name").alias("file"))
    counted = read.agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
    return counted.join(common.union_all(*told), ["file", "n_rows"])


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_table(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Customers with their key in front."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    writers.write_csv(rows, folder)
    return readers.read_csv(spark, folder, rows.schema)


@query("SELECT c_name AS id, c_nationkey FROM customer")
def id_lists(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A list of customers' names for each nation."""
    writers.write_ids(table(spark, sf_dir, "customer"), folder, "c_name", ["c_nationkey"])
    one = F.regexp_extract(F.col("_metadata.file_path"), r"c_nationkey=(\d+)", 1).cast("long")
    listed = readers.read_ids(spark, f"{folder}/*")
    nations = spark.read.text(f"{folder}/*").select(F.trim("value").alias("id"), one.alias("c_nationkey"))
    return listed.select("id").join(nations, "id")


_KMERS_SQL = """
SELECT * FROM (
  SELECT substr(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), CAST(p + 1 AS INT), 4) AS kmer, CAST(item_id AS VARCHAR) AS acc, CAST(p AS INT) AS pos0
  FROM benchmark, LATERAL (SELECT unnest(range(0, len(text) - 4 + 1)) AS p)
) WHERE regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]+')"""


@query(_KMERS_SQL)
def kmer_file(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """K7, A1: the index's rows in long form, sorted by k-mer."""
    items = table(spark, sf_dir, "benchmark").select(text("item_id").alias("acc"), F.col("text").alias("seq"))
    writers.write_kmer_index(seq_operators.kmer_rows(items, 4), folder)
    return spark.read.parquet(folder).select("kmer", "acc", F.col("pos0").cast("int").alias("pos0"))


@query("""
SELECT min(s_suppkey) AS Representative_ID, any_value(n_name) AS Representative_Name, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS Equivalent_IDs
FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey""")
def mapping_file(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Lists of suppliers and of nations' sequences, clusters of equal ones, their mapping."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    pseudo = F.concat_ws(" ", text("s_suppkey"), F.regexp_replace("n_name", " ", "-"))
    both = suppliers.join(nations, F.col("n_nationkey") == F.col("s_nationkey"))
    both.select(pseudo.alias("value")).write.text(f"{folder}/pseudo")
    both.select(F.concat_ws("  ", text("s_suppkey"), "n_name").alias("value")).write.text(f"{folder}/names")
    listed = readers.read_allele_list(spark, f"{folder}/names")
    with_sequence = alleles.attach_pseudoseq(listed.drop("name"), readers.read_pseudoseq(spark, f"{folder}/pseudo"))
    members = seq_operators.cluster_rows(with_sequence.withColumn("id", F.col("id").cast("long")), "id", "seq", "id")
    named = alleles.with_names(members, listed.withColumn("id", F.col("id").cast("long"))).withColumn("pos", F.col("member"))
    writers.write_mapping(alleles.mapping_table(named, listed.withColumn("id", F.col("id").cast("long"))), f"{folder}/mapping")
    schema = "Representative_ID long, Representative_Name string, Equivalent_IDs string, Equivalent_Names string"
    return readers.read_tsv(spark, f"{folder}/mapping", schema).drop("Equivalent_Names")


@query("""
SELECT 'Cluster ' || CAST(s_nationkey AS VARCHAR) AS cluster, CAST(min(s_suppkey) OVER (PARTITION BY s_nationkey) AS VARCHAR) AS representative,
       CAST(s_suppkey AS VARCHAR) AS member FROM supplier""")
def cluster_listing(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Suppliers listed by nation, the first of each marked as its representative."""
    rows = common.number_chunks(table(spark, sf_dir, "supplier"), 1, ["s_nationkey"], ["s_suppkey"], "n")
    first = F.col("s_nationkey").cast("long") * 1_000_000_000
    at = first + F.col("n") + 1
    file = F.concat(F.lit("part-"), text(F.col("s_nationkey") % 4), F.lit(".clstr"))
    member = F.concat(text("n"), F.lit("\t9aa, >"), text("s_suppkey"), F.when(F.col("n") == 0, "... *").otherwise("... at 100%"))
    heads = rows.select("s_nationkey").distinct()
    head = _lines(file, first, F.concat(F.lit(">Cluster "), text("s_nationkey")), heads)
    writers.write_named_files(_lines(file, at, member, rows).union(head), folder)
    return readers.read_clusters(spark, folder).select("cluster", "representative", "member")


@query("SELECT page_id, url, len(html) AS n FROM pages")
def json_pages(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Web pages landed as JSON arrays of a hundred."""
    pages = table(spark, sf_dir, "pages").withColumn("f", F.concat(F.lit("page-"), text(F.floor(F.col("page_id") / 100)), F.lit(".json")))
    ends = pages.select("f").distinct()
    rows = _lines(F.col("f"), F.col("page_id"), F.concat(F.to_json(F.struct("page_id", "url", "html")), F.lit(",")), pages)
    first, last = _lines(F.col("f"), F.lit(-1), F.lit("["), ends), _lines(F.col("f"), F.lit(1 << 62), F.lit("{}]"), ends)
    writers.write_named_files(rows.union(first).union(last), folder)
    read = readers.read_json_pages(spark, folder, pages.select("page_id", "url", "html").schema)
    return read.filter("page_id IS NOT NULL").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query(LD_SQL + "SELECT i, j, round(r, 6) AS r FROM stored")
def ld_store(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Stored pairs of one population, those of matched variants."""
    triples, index, asked = inputs.ld_tables(spark, sf_dir)
    stored = triples.withColumn("pop", F.explode(F.array(F.lit("EUR"), F.lit("AFR"))))
    stored.select(*[F.col(f.name).cast(f.dataType) for f in LD_TRIPLES]).write.partitionBy("pop").parquet(f"{folder}/triples")
    index.select(*[F.col(f.name).cast(f.dataType) for f in LD_INDEX]).write.parquet(f"{folder}/index")
    rows, listed = readers.read_ld(spark, f"{folder}/triples", f"{folder}/index")
    matched, _ = ld.match_variants(asked, listed)
    return ld.subset_ld(rows, matched).filter("i < j").select("i", "j", F.round("r", 6).alias("r"))


_BRAND = "Brand#11"
_BRAND_SQL = LD_SQL.rstrip() + f""", own AS (
  SELECT p_partkey AS idx, split_part(p_brand, '#', 2) || ':' || CAST(p_partkey AS VARCHAR) || ':A:C' AS variant
  FROM part JOIN matched ON idx = p_partkey WHERE p_brand = '{_BRAND}')
"""


def _brand_matrix(spark: SparkSession, sf_dir: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The cells of one brand's sub-matrix, read from a store in tiles of 100 variants, and its matched variants."""
    triples, index, asked = inputs.ld_tables(spark, sf_dir)
    writers.write_ld_tiles(triples, f"{folder}/tiles", 100)
    brand = asked.filter(F.col("variant").startswith(_BRAND.split("#")[1] + ":"))
    matched, _ = ld.match_variants(brand, index)
    matched = cut(matched)
    cells = ld.subset_tiles(readers.read_ld_tiles(spark, f"{folder}/tiles"), matched, 100)
    return cells, matched


@query(_BRAND_SQL + "SELECT i, j, round(r, 6) AS r FROM stored JOIN own x ON x.idx = i JOIN own y ON y.idx = j")
def ld_tiles(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The sub-matrix of one brand from a store in tiles, of which those that it needs are read."""
    cells, _ = _brand_matrix(spark, sf_dir, folder)
    return cells.filter("i < j").select("i", "j", F.round("r", 6).alias("r"))


@query(_BRAND_SQL + """
SELECT x.variant, y.variant AS other, round(CASE WHEN x.idx = y.idx THEN 1 ELSE coalesce(r, 0) END, 6) AS r
FROM own x CROSS JOIN own y LEFT JOIN stored ON i = least(x.idx, y.idx) AND j = greatest(x.idx, y.idx)""", lasting=True)
def matrix_file(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The square matrix of one brand's variants, of any number, in gz files of blocks, all of its cells read back.

    Stored cells move and are written; the rest of the square is made where it is read.
    """
    cells, matched = _brand_matrix(spark, sf_dir, folder)
    writers.write_matrix_blocks(ld.matrix_rows(ld.complete_symmetric(cells, matched), matched, ending=".tsv.gz"), f"{folder}/matrix")
    delete_folder(spark, f"{folder}/tiles")
    return readers.read_matrix(spark, f"{folder}/matrix").withColumn("r", F.when(F.col("r") == 0, F.lit(0.0)).otherwise(F.round("r", 6)))


@query("SELECT CAST(o_custkey % 22 + 1 AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS variant, o_totalprice / 5000000 AS pval FROM orders")
def bgz_variants(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Orders as variants in block-gzip files, a file for each priority."""
    orders = table(spark, sf_dir, "orders").withColumn("f", F.concat(F.regexp_replace("o_orderpriority", "[^A-Z0-9]", ""), F.lit(".tsv.bgz")))
    value = F.concat_ws("\t", F.concat_ws(":", text(F.col("o_custkey") % 22 + 1), text("o_orderkey")), text(F.col("o_totalprice") / 5_000_000))
    head = _lines(F.col("f"), F.lit(-1), F.lit("variant\tpval"), orders.select("f").distinct())
    writers.write_named_files(_lines(F.col("f"), F.col("o_orderkey"), value, orders).union(head), folder)
    return readers.read_bgz_tsv(spark, folder, GWAS_P, 1 << 20)


@query("""
SELECT o_orderpriority AS trait, CAST(o_orderstatus = 'F' AS INT) * 0.04 + 0.01 AS threshold, count(*) AS n FROM orders GROUP BY 1, 2""")
def named_lists(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Lists named by trait and threshold; the names are parsed."""
    orders = table(spark, sf_dir, "orders").withColumn("t", F.when(F.col("o_orderstatus") == "F", "0.05").otherwise("0.01"))
    file = F.concat("o_orderpriority", F.lit("_p"), "t", F.lit(".txt"))
    writers.write_named_files(_lines(file, F.col("o_orderkey"), text("o_orderkey"), orders), folder)
    lists = readers.read_ids(spark, folder).select(names.parse_list_name(F.url_decode(F.col("input_pos.file"))).alias("l"))
    return lists.groupBy("l.trait", "l.threshold").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_name AS Original_ID, n_name AS Mapped_ID FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def id_mapping(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A table of renamed ids."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    writers.write_csv(both.select(F.col("s_name").alias("Original_ID"), F.col("n_name").alias("Mapped_ID")), folder)
    return readers.read_csv(spark, folder, ID_MAPPING)


@query("""
SELECT count(*) AS total, count_if(similarity BETWEEN 75 AND 95) AS kept, count_if(sstart > send) AS reversed FROM (%s)""" % inputs.HITS_SQL)
def observed_hits(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Counts seen while the hits are written."""
    rows = hits.with_similarity(inputs.hits(spark, sf_dir))
    metrics = {"total": F.count(F.lit(1)), "kept": F.count_if(F.col("similarity").between(75, 95)), "reversed": F.count_if(F.col("sstart") > F.col("send"))}
    watched, seen = common.observed(rows, **metrics)
    writers.write_csv(watched, folder)
    return spark.createDataFrame([tuple(seen.get[m] for m in metrics)], ", ".join(f"{m} long" for m in metrics))


@query(f"""
SELECT 'VIRAL_' || CAST(p_partkey AS VARCHAR) || '_1_' || p_brand AS record, CAST(p_partkey AS VARCHAR) || '|' || p_brand || '|1-9' AS peptide,
       CAST(p_partkey AS VARCHAR) || '|HUMAN_' || p_brand || '|1-9|sim=' || printf('%.2f', p_size * 1.0) AS segment FROM part""")
def record_ids(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The three forms of record ids."""
    part = table(spark, sf_dir, "part")
    key, one, nine = text("p_partkey"), F.lit("1"), F.lit("9")
    return part.select(
        sequences.pair_record_id("VIRAL", key, one, F.col("p_brand")).alias("record"),
        sequences.peptide_id(key, F.col("p_brand"), one, nine).alias("peptide"),
        sequences.segment_id(key, F.col("p_brand"), one, nine, F.col("p_size").cast("double")).alias("segment"),
    )


@query(f"SELECT {ALLELE_SQL} AS allele, count(*) AS n, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1")
def grouped_means(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A function of one's own on each allele's rows, of which Spark's partial sums stay bounded by the task."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"allele": rows["allele"].iloc[:1], "part": rows["part"].iloc[:1], "n": [len(rows)], "total": [float(rows["l_tax"].sum())]})

    lines = table(spark, sf_dir, "lineitem").select(inputs.allele_of().alias("allele"), "l_orderkey", F.col("l_tax").cast("double").alias("l_tax"))
    lines = casecontrol.with_parts(lines, ["allele"], "l_orderkey", "part").drop("l_orderkey")
    parts = casecontrol.map_groups(lines, ["allele", "part"], mean, "allele string, part int, n long, total double")
    return parts.groupBy("allele").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


@query(inputs.alignment_sql("SELECT DISTINCT upper(p_name) AS a, upper(p_type) AS b FROM part") + """
SELECT p_partkey, round(score, 6) AS score FROM part JOIN aligned ON a = upper(p_name) AND b = upper(p_type)""")
def pair_scores(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The alignment score of each part's name with its type."""
    score = sequences.alignment_score()
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score(F.upper("p_name"), F.upper("p_type")), 6).alias("score"))
