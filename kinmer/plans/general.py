"""Queries on sequences, epitopes, variants, work lists, windows and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.functions import names
from kinmer.operators import alleles, common, epitopes, inventory, ld, segments, selection, sequences
from kinmer.plans import inputs
from kinmer.plans.inputs import EPITOPES_SQL, LD_SQL, VARIANT_SQL, table, text
from kinmer.shared import cut, delete_folder, shared_folder
from kinmer.streaming.ingest import read_results, run_generation

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a sequence of its own."""
    split = common.spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "seq"))
    return split.select(F.concat_ws(":", text("doc_id"), text("line")).alias("acc"), "seq")


@query("""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, translate(string_split(text, chr(10))[i], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), windows AS (
  SELECT doc_id, line, substr(seq, CAST(p AS INT), 8) AS kmer
  FROM lines, LATERAL (SELECT unnest(range(1, len(seq) - 8 + 2)) AS p)
)
SELECT kmer, CAST(sum(n) AS BIGINT) AS n_hits, count(*) AS n_proteins
FROM (SELECT kmer, doc_id, line, count(*) AS n FROM windows WHERE regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY ALL)
GROUP BY kmer""")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, P13, A1's counters: 8-mers of the twenty letters in every line of every document."""
    return sequences.kmer_counts(_lines(spark, sf_dir), 8)


@query("""
SELECT kmer, block_no, count(*) AS n, string_agg(acc || '@' || CAST(pos0 AS VARCHAR), ',' ORDER BY acc, pos0) AS hits FROM (
SELECT *, (row_number() OVER (PARTITION BY kmer ORDER BY acc, pos0) - 1) // 25 AS block_no
FROM (
  SELECT CAST(item_id AS VARCHAR) AS acc, p AS pos0, substr(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), CAST(p + 1 AS INT), 4) AS kmer
  FROM benchmark, LATERAL (SELECT unnest(range(0, len(text) - 4 + 1)) AS p)
) WHERE regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]+')) GROUP BY kmer, block_no""")
def kmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the blocked index of 4-mers over the benchmark's texts, 25 hits a block, and its hits."""
    items = table(spark, sf_dir, "benchmark").select(text("item_id").alias("acc"), F.col("text").alias("seq"))
    index = cut(sequences.kmer_index(items, 4, size=25))
    rows = sequences.posting_rows(index.select(F.concat_ws(":", "kmer", text("block_no")).alias("kmer"), "postings"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("acc", "pos0"))), lambda h: F.concat_ws("@", h["acc"], text(h["pos0"])))
    told = rows.groupBy("kmer").agg(F.array_join(listed, ",").alias("hits")).withColumnRenamed("kmer", "key")
    return index.join(told, F.concat_ws(":", "kmer", text("block_no")) == F.col("key")).select("kmer", "block_no", F.col("n").cast("long").alias("n"), "hits")


_SETS_SQL = """
WITH p AS (SELECT DISTINCT p_name AS p FROM part),
k AS (SELECT DISTINCT p, substr(p, CAST(i AS INT), 3) AS kmer FROM p, LATERAL (SELECT unnest(range(1, len(p) - 3 + 2)) AS i)),
n AS (SELECT p, count(*) AS n FROM k GROUP BY 1),
shared AS (SELECT a.p AS a, b.p AS b, count(*) AS m FROM k a JOIN k b ON a.kmer = b.kmer AND a.p < b.p GROUP BY 1, 2),
scored AS (SELECT a, b, m / (x.n + y.n - m) AS jaccard FROM shared JOIN n x ON x.p = a JOIN n y ON y.p = b)
"""


@query(_SETS_SQL + "SELECT a, b, round(jaccard, 6) AS jaccard FROM scored")
def peptide_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, H12."""
    df = sequences.shared_kmer_pairs(table(spark, sf_dir, "part"), 3, "p_name")
    return df.withColumn("jaccard", F.round("jaccard", 6))


@query(_SETS_SQL + """
SELECT count(*) AS n_sharing, round(sum(jaccard) / (SELECT count(*) * (count(*) - 1) / 2 FROM p), 6) AS mean_similarity FROM scored""")
def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    df = sequences.mean_similarity(table(spark, sf_dir, "part"), 3, "p_name")
    return df.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(_SETS_SQL + "SELECT a, b, round(jaccard, 6) AS jaccard FROM scored WHERE jaccard >= 0.3")
def similar_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names of a similarity of 0.3 or more, by prefix and length filters."""
    df = sequences.similar_pairs(table(spark, sf_dir, "part"), 0.3, 3, "p_name")
    return df.withColumn("jaccard", F.round("jaccard", 6))


@query(inputs.alignment_sql("SELECT DISTINCT a.n AS a, b.n AS b FROM names a, names b WHERE a.n < b.n", "names AS (SELECT DISTINCT upper(p_name) AS n FROM part), ") + """
SELECT count(*) AS n_pairs, round(avg(score), 6) AS mean_score FROM aligned""")
def mean_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean alignment score of all pairs of part names, in capitals."""
    names = table(spark, sf_dir, "part").select(F.upper("p_name").alias("peptide"))
    return sequences.mean_alignment(names).withColumn("mean_score", F.round("mean_score", 6))


_PFM_SQL = ", ".join(f"coalesce(round(count_if(c = '{c}') / nullif(count_if(contains('ACDEFGHIKLMNPQRSTVWY', c)), 0), 6), 0) AS {c}" for c in sequences.ALPHABET)


@query(f"""
SELECT pos, {_PFM_SQL} FROM (
  SELECT CAST(i AS INT) AS pos, substr(p, CAST(i AS INT), 1) AS c
  FROM (SELECT DISTINCT translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS p FROM part), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i))
GROUP BY pos""")
def position_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    df = sequences.pfm(table(spark, sf_dir, "part"), "p_name")
    return df.withColumns({c: F.round(c, 6) for c in sequences.ALPHABET})


@query("""
SELECT first AS representative, (place - 1) // 3 AS block_no, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members, any_value(n) AS n
FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM documents)
GROUP BY first, block_no""")
def identical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23 with listed members."""
    df = sequences.cluster_identical(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id", size=3)
    return df.withColumns({"members": F.array_join(F.col("members").cast("array<string>"), ","), "n": F.col("n").cast("long")})


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS representative, doc_id AS member FROM documents")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23 in long form."""
    return sequences.cluster_rows(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id")


def _allele_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", inputs.allele_of("s_suppkey").alias("name"))


_GROUP_SQL = "CASE WHEN substr(name, 5, 1) < 'D' THEN substr(name, 1, 5) ELSE 'HLA-others' END"


@query(f"""
SELECT name, {_GROUP_SQL} AS allele_group,
       lpad(CAST((row_number() OVER (PARTITION BY {_GROUP_SQL} ORDER BY name) - 1) // 30 AS VARCHAR), 3, '0') AS chunk_name
FROM (SELECT {inputs.ALLELE_SQL.replace('l_suppkey', 's_suppkey')} AS name FROM supplier)""")
def allele_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H18, W5 within groups."""
    return alleles.allele_chunks(_allele_list(spark, sf_dir).select("name"))


@query("""
SELECT min(s_suppkey) AS Representative_ID, coalesce(any_value(n_name) FILTER (s_nationkey % 4 != 0), 'NA') AS Representative_Name,
       string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS Equivalent_IDs,
       string_agg(CASE WHEN s_nationkey % 4 != 0 THEN n_name ELSE 'NA' END, ',' ORDER BY s_suppkey) AS Equivalent_Names
FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey""")
def allele_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, J20, J21, K10's rows, F5: suppliers of one nation are one cluster; some nations have no name."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    sequences_of = alleles.attach_pseudoseq(
        supplier.withColumn("id", F.col("s_nationkey")), nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("seq"))
    )
    members = sequences.cluster_rows(sequences_of.withColumn("id", F.col("s_suppkey")), "id", "seq", "id")
    named = nation.filter("n_nationkey % 4 != 0").join(supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    listed = named.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("name"))
    return alleles.mapping_table(alleles.with_names(members, listed).withColumn("pos", F.col("member")), listed)


@query(f"""
SELECT structure_id, linear_sequence, mhc_class, peptide_length, alleles, antigens, organisms, has_receptor FROM ({EPITOPES_SQL})""")
def epitope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3-P6, H14."""
    rows = epitopes.epitopes(_foreign_is_7(inputs.assays(spark, sf_dir)), "I")
    return rows.select("structure_id", "linear_sequence", "mhc_class", F.col("peptide_length").cast("long").alias("peptide_length"), "alleles", "antigens", "organisms", "has_receptor")


def _foreign_is_7(assays: DataFrame) -> DataFrame:
    """Nation 7 stands for the human organism."""
    iris = F.transform("parent_source_antigen_source_org_iris", lambda x: F.when(x == "7", epitopes.HUMAN).otherwise(x))
    return assays.withColumn("parent_source_antigen_source_org_iris", iris)


_LINKED_SQL = f"""
SELECT e.structure_id, e.linear_sequence, e.alleles, receptor_id, e.mhc_class AS mhc_class_epitope, p_type AS mhc_class_receptor,
       p_size % 7 != 0 AND p_size % 5 != 0 AS paired
FROM (SELECT *, unnest(receptor_ids) AS receptor_id FROM ({EPITOPES_SQL})) e JOIN part ON p_partkey = receptor_id
"""


@query(f"""
SELECT * FROM ({_LINKED_SQL}) QUALIFY row_number() OVER (PARTITION BY linear_sequence, alleles, receptor_id ORDER BY structure_id) = 1""")
def epitope_receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, P25, A27."""
    rows = epitopes.epitopes(_foreign_is_7(inputs.assays(spark, sf_dir)), "I")
    linked = epitopes.epitope_receptor(rows, epitopes.with_chain_flags(inputs.receptors(spark, sf_dir)))
    return epitopes.unique_pairs(linked).select(
        "structure_id", "linear_sequence", "alleles", "receptor_id", "mhc_class_epitope", "mhc_class_receptor", "paired"
    )


@query(f"SELECT DISTINCT receptor_id FROM ({_LINKED_SQL})")
def named_receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    rows = epitopes.epitopes(_foreign_is_7(inputs.assays(spark, sf_dir)), "I")
    return epitopes.receptors_for(rows, inputs.receptors(spark, sf_dir)).select("receptor_id")


@query(f"""
SELECT item, count(*) AS n FROM (SELECT unnest(iris) AS item FROM ({inputs.ASSAYS_SQL})) GROUP BY 1 ORDER BY n DESC, item LIMIT 10""")
def top_organisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29, F2."""
    return epitopes.top_items(inputs.assays(spark, sf_dir), "parent_source_antigen_source_org_iris")


@query(f"SELECT mhc_class, len(linear_sequence) AS peptide_length, count(*) AS n FROM ({inputs.ASSAYS_SQL}) GROUP BY 1, 2")
def epitope_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    rows = inputs.assays(spark, sf_dir).withColumn("peptide_length", F.length("linear_sequence").cast("long"))
    return epitopes.length_profile(rows)


def _thresholds(mode: str) -> str:
    test = "5.0 - o_totalprice / 100000 >= c" if mode == "neglog10" else "o_totalprice / 5000000 <= t"
    return f"""
SELECT {VARIANT_SQL} AS variant, o_orderpriority AS trait, t AS threshold FROM orders
JOIN (VALUES (CAST(0.001 AS DOUBLE), 3.0), (0.005, 2.3010299956639813), (0.01, 2.0), (0.05, 1.3010299956639813)) v(t, c) ON {test}"""


@query(_thresholds("neglog10"))
def variants_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 on -log10 p-values, H8, H9."""
    rows = ld.with_variant_id(ld.threshold_variants(inputs.variants(spark, sf_dir), mode="neglog10"))
    return rows.select("variant", "trait", "threshold")


@query(_thresholds("p"))
def variants_by_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 on p-values."""
    rows = ld.with_variant_id(ld.threshold_variants(inputs.variants(spark, sf_dir), mode="p"))
    return rows.select("variant", "trait", "threshold")


@query(f"""
SELECT variant, trait, chr, pos, (row_number() OVER (PARTITION BY trait, chr ORDER BY pos, variant) - 1) // 20 AS chunk
FROM (SELECT {VARIANT_SQL} AS variant, o_orderpriority AS trait, CAST(o_custkey % 22 + 1 AS VARCHAR) AS chr, o_orderkey AS pos FROM orders)""")
def variant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8's parse, W5: chunks of 20 within trait and chromosome."""
    rows = ld.with_variant_id(inputs.variants(spark, sf_dir)).select("variant", "trait")
    return ld.split_variants(rows, ["trait"], 20).select("variant", "trait", "chr", "pos", "chunk")


@query(LD_SQL + """
SELECT i, j, round(r, 6) AS r, round(r * r, 6) AS r2 FROM (
  SELECT i, j, r FROM stored UNION ALL SELECT j, i, r FROM stored UNION ALL SELECT idx, idx, 1.0 FROM matched)""")
def ld_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completed sub-matrix of parts bought together."""
    triples, index, asked = inputs.ld_tables(spark, sf_dir)
    matched, _ = ld.match_variants(asked, index)
    tasks = max(1, -(-asked.count() // inputs.LINES_A_TASK))
    ends = matched.repartition(tasks, "idx")  # indices alone are few bytes, which adaptive execution would put in one task
    cells = ld.complete_symmetric(ld.subset_ld(triples, matched), ends)
    return cells.select("i", "j", F.round("r", 6).alias("r"), F.round("r2", 6).alias("r2"))


_GRID = "SELECT b AS chunk, s AS allele FROM (SELECT DISTINCT p_brand AS b FROM part), (SELECT DISTINCT p_size AS s FROM part)"


def _work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    done = part.select(F.col("p_brand").alias("chunk"), F.col("p_size").alias("allele")).filter("allele < 30 OR length(chunk) = 7")
    return part.select(F.col("p_brand").alias("chunk")).distinct(), part.select(F.col("p_size").alias("allele")).distinct(), done


_DONE = "SELECT DISTINCT p_brand AS chunk, p_size AS allele FROM part WHERE p_size < 30 OR len(p_brand) = 7"


@query(f"SELECT chunk, allele // 10 AS allele_chunk, count(*) AS n_missing FROM (({_GRID}) EXCEPT ({_DONE})) GROUP BY 1, 2")
def unprocessed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, J16, J17."""
    missing = inventory.missing_work(*_work(spark, sf_dir)).withColumn("allele_chunk", F.floor(F.col("allele") / 10).cast("int"))
    return inventory.unprocessed_batches(missing)


@query(f"SELECT chunk, allele, chunk || ':' || CAST(allele AS VARCHAR) AS task FROM ({_GRID})")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid itself, as a list of tasks."""
    chunks, alleles, _ = _work(spark, sf_dir)
    return inventory.work_grid(chunks, alleles).withColumn("task", F.concat_ws(":", "chunk", text("allele")))


@query(f"""
SELECT chunk, count(d.allele) AS n_done, count(*) AS n_expected, round(100 * count(d.allele) / count(*), 6) AS percent,
       CASE WHEN count(d.allele) >= 30 THEN 'complete' WHEN count(d.allele) > 0 THEN 'partial' ELSE 'none' END AS status
FROM ({_GRID}) g LEFT JOIN ({_DONE}) d USING (chunk, allele) GROUP BY chunk""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    df = inventory.completeness(*_work(spark, sf_dir), complete=30)
    return df.withColumn("percent", F.round("percent", 6))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 10")
def exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    return inventory.having_count(table(spark, sf_dir, "orders"), 10, "o_custkey")


@query("""
SELECT k AS doc_id, CASE WHEN bool_or(l) AND bool_or(r) THEN 'both' WHEN bool_or(l) THEN 'left' ELSE 'right' END AS side
FROM (SELECT doc_id AS k, true AS l, false AS r FROM documents UNION ALL SELECT doc_id, false, true FROM labels) GROUP BY k""")
def key_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, U2."""
    return common.compare_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events""")
def last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of the user at or before each event."""
    events = table(spark, sf_dir, "events").withColumn("_e", F.when(F.col("event_type") == "error", F.col("event_id")))
    return segments.carry_forward(events, "_e", ["user_id"], "event_id", "last_error").select("event_id", "user_id", "last_error")


@query("""
SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1""")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return common.first_per_group(events, ["user_id"], "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS order_quantity FROM lineitem")
def order_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return common.group_sum(lines, ["l_orderkey"], "l_quantity", "order_quantity")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 100 AS chunk FROM orders")
def global_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 in one global order, without a global window."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return common.number_global_chunks(orders, 100, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "chunk")


@query("""
SELECT CAST(bin AS INT) AS bin, round(lo + (hi - lo) / 40 * bin, 4) AS lower, round(lo + (hi - lo) / 40 * (bin + 1), 4) AS upper, coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, 40)) AS bin), (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
LEFT JOIN (SELECT least(CAST(floor((o_totalprice - lo) * 40 / (hi - lo)) AS INT), 39) AS b, count(*) AS n
           FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1) ON b = bin""")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    df = common.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 40)
    return df.withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4)})


@query("""
SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS q95, round(median(o_totalprice), 4) AS q50 FROM orders""")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    df = selection.quantile(table(spark, sf_dir, "orders"), "o_totalprice", [0.95, 0.5])
    return df.select(F.round(F.col("quantile")[0], 4).alias("q95"), F.round(F.col("quantile")[1], 4).alias("q50"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a sorted table."""
    return common.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), 25)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, F1."""
    return common.value_counts(table(spark, sf_dir, "part"), "p_type")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order a customer, in an explicit order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return common.dedup(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])


@query("""
SELECT name, kind FROM (SELECT c_nationkey AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind DESC) = 1""")
def nations_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U3, A28."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("name"), F.lit("customer").alias("kind"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.lit("supplier").alias("kind"))
    return common.union_distinct(customers.distinct(), suppliers.distinct(), ["name"], [F.desc("kind")])


@query("""
SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, CASE WHEN contains(url, '_p') THEN 1 ELSE 0 END AS marked FROM pages""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H17 on page addresses."""
    pages = table(spark, sf_dir, "pages")
    marked = F.col("url").contains("_p").cast("int")
    return pages.select("page_id", names.base_name(F.col("url")).alias("base"), marked.alias("marked"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a file stream, micro-batches written and read back, then counted."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    # The pattern names the table alone, be it a file or a folder.
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parque[t]")
    run_generation(spark, stream, lambda b: b.select("event_id", "event_type", "value"), f"{folder}/out", f"{folder}/state")
    counts = read_results(spark, f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    counts = cut(counts)
    delete_folder(spark, folder)
    return counts
