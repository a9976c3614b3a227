"""The standard tables in the shape of the operators' inputs, as DataFrames and as SQL.

Parts stand for peptide pairs, suppliers for alleles, brands and types for human and viral proteins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.functions.sequences import BLOSUM62

# Two species in the OBO rendering of the NCBI taxonomy.
HUMAN = "http://purl.obolibrary.org/obo/NCBITaxon_9606"
MOUSE = "http://purl.obolibrary.org/obo/NCBITaxon_10090"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def allele_of(supplier: str = "l_suppkey") -> Column:
    letter = F.substr(F.lit("ABCD"), (F.col(supplier) % 4 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("HLA-"), letter, F.lit("*"), F.lpad(text(supplier), 6, "0"), F.lit(":01"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the wide prediction table."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_name", "p_size")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        text("l_partkey").alias("pair_id"),
        allele_of().alias("Allele"),
        F.col("p_type").alias("uniprot_viral"),
        F.col("p_brand").alias("uniprot_human"),
        F.concat_ws("-", "p_name", text("p_size")).alias("Peptide_viral"),
        F.concat(F.lit("H"), text("l_partkey")).alias("Peptide_human"),
        F.concat(F.lit("chunk_"), text("l_linenumber"), F.lit(".xls")).alias("source_file_human_human"),
        (F.col("l_discount") * 10).alias("BA_score_viral"),
        (F.col("l_tax") * 10).alias("BA_score_human"),
        (F.col("l_quantity") / 10).alias("BA_Rank_viral"),
        (F.col("l_linenumber") / 2.0).alias("BA_Rank_human"),
    )


def class_sql(require: str = "viral", edge: str = "dominant", d: str = "l_discount * 10 - l_tax * 10") -> str:
    binds = "l_quantity / 10 <= 2" + (" AND l_linenumber / 2.0 <= 2" if require == "both" else "")
    human, viral = (f"{d} >= 0.5", f"{d} <= -0.5") if edge == "dominant" else (f"{d} > 0.5", f"{d} < -0.5")
    return (
        f"CASE WHEN NOT ({binds}) THEN 'Non_binder' WHEN {human} THEN 'Human_dominant' "
        f"WHEN {viral} THEN 'Viral_dominant' ELSE 'Equivalent_binding' END"
    )


ALLELE_SQL = "'HLA-' || substr('ABCD', CAST(l_suppkey % 4 + 1 AS INT), 1) || '*' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || ':01'"

ANNOTATED_SQL = f"""
SELECT CAST(l_partkey AS VARCHAR) AS pair_id, p_type AS uniprot_viral, p_brand AS uniprot_human,
       p_name || '-' || CAST(p_size AS VARCHAR) AS peptide_viral, 'H' || CAST(l_partkey AS VARCHAR) AS peptide_human,
       {ALLELE_SQL} AS allele, replace({ALLELE_SQL}, '*', '_') AS allele_safe,
       l_discount * 10 AS score_viral, l_tax * 10 AS score_human, l_discount * 10 - l_tax * 10 AS diff,
       l_quantity / 10 AS rank_viral, l_linenumber / 2.0 AS rank_human, l_linenumber AS chunk_source,
       {class_sql()} AS cls
FROM lineitem JOIN part ON p_partkey = l_partkey
"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as alignment hits; the customer's name is the accession."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("o_orderkey").alias("qseqid"),
        F.when(F.col("c_custkey") % 11 == 0, F.col("c_name")).otherwise(F.concat(F.lit("sp|"), "c_name", F.lit("|X"))).alias("sseqid"),
        (100 - F.col("o_totalprice") % 40).alias("pident"),
        (60 + F.col("c_custkey") % 41).cast("int").alias("length"),
        F.lit(100).alias("qlen"),
        (1 + F.col("o_orderkey") % 9).cast("int").alias("sstart"),
        (F.col("c_custkey") % 30).cast("int").alias("send"),
        "c_nationkey",
    )


HITS_SQL = """
SELECT o_orderkey AS qseqid, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS hu_prot_id,
       (100 - o_totalprice % 40) * ((60 + c_custkey % 41) / 100) AS similarity, c_nationkey,
       1 + o_orderkey % 9 AS sstart, c_custkey % 30 AS send
FROM orders JOIN customer ON c_custkey = o_custkey
"""


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assay rows: the best value of a user, event type and replicate is the z-score."""
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(text("user_id").alias("id1"), F.col("event_type").alias("pep_id"), (F.col("event_id") % 2 + 1).cast("int").alias("repnum"))
        .agg((F.max("value") / 40).alias("zscore"), F.first((F.col("user_id") % 2).cast("int")).alias("casestat"))
        .withColumn("timeser", F.lit("last"))
    )


ASSAY_SQL = """
SELECT CAST(user_id AS VARCHAR) AS id1, event_type AS pep_id, event_id % 2 + 1 AS repnum,
       max(value) / 40 AS zscore, any_value(user_id % 2) AS casestat
FROM events GROUP BY 1, 2, 3
"""


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as T-cell assays: their lines' suppliers' nations, suppliers and parts are the arrays."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), text("s_nationkey").alias("iri"))
    lines = table(spark, sf_dir, "lineitem").join(nations, "l_suppkey")

    def listed(c: Column) -> Column:
        return F.array_sort(F.collect_list(c))

    return lines.groupBy(F.col("l_orderkey").alias("structure_id")).agg(
        F.concat(F.lit("SEQ"), F.repeat(F.lit("A"), (F.col("l_orderkey") % 17).cast("int"))).alias("linear_sequence"),
        F.lit("Linear peptide").alias("structure_type"),
        listed(F.col("iri")).alias("parent_source_antigen_source_org_iris"),
        listed(F.concat(F.lit("org"), "iri")).alias("parent_source_antigen_source_org_names"),
        listed(F.col("l_returnflag")).alias("parent_source_antigen_names"),
        F.array(F.when(F.col("l_orderkey") % 5 == 0, MOUSE).otherwise(HUMAN)).alias("host_organism_iris"),
        listed(F.when(F.col("l_linestatus") == "O", allele_of())).alias("mhc_allele_names"),
        F.when(F.col("l_orderkey") % 3 == 0, "II").otherwise("I").alias("mhc_class"),
        F.when(F.col("l_orderkey") % 4 == 0, "Negative").otherwise("Positive").alias("qualitative_measure"),
        listed(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("receptor_ids"),
    )


ASSAYS_SQL = f"""
SELECT l_orderkey AS structure_id, 'SEQ' || repeat('A', CAST(l_orderkey % 17 AS INT)) AS linear_sequence,
       list_sort(list(CAST(s_nationkey AS VARCHAR))) AS iris, list_sort(list(l_returnflag)) AS antigens,
       l_orderkey % 5 != 0 AS human_host, CASE WHEN l_orderkey % 3 = 0 THEN 'II' ELSE 'I' END AS mhc_class,
       l_orderkey % 4 != 0 AS positive,
       coalesce(list_sort(list({ALLELE_SQL}) FILTER (l_linestatus = 'O')), []) AS alleles,
       coalesce(list_sort(list(l_partkey) FILTER (l_quantity > 20)), []) AS receptor_ids
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey
"""

EPITOPES_SQL = f"""
SELECT structure_id, linear_sequence, mhc_class, len(linear_sequence) AS peptide_length,
       array_to_string(alleles, '|') AS alleles, array_to_string(list_sort(list_distinct(antigens)), '|') AS antigens,
       array_to_string(list_sort(list_transform(list_distinct(iris), lambda x: 'org' || x)), '|') AS organisms,
       len(receptor_ids) > 0 AS has_receptor, receptor_ids
FROM ({ASSAYS_SQL})
WHERE human_host AND positive AND mhc_class = 'I' AND len(linear_sequence) BETWEEN 8 AND 14
  AND len(list_filter(iris, lambda x: x != '7')) > 0 AND len(alleles) > 0
"""


def receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as receptors; a chain's CDR3 is missing for some."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("receptor_id"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("chain_1_cdr3_sequence"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("chain_2_cdr3_sequence"),
        F.col("p_type").alias("mhc_class"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as variants with a p-value."""
    return table(spark, sf_dir, "orders").select(
        text(F.col("o_custkey") % 22 + 1).alias("chr"),
        F.col("o_orderkey").alias("pos"),
        F.lit("A").alias("ref"),
        F.substr("o_orderstatus", F.lit(1), F.lit(1)).alias("alt"),
        (F.col("o_totalprice") / 5_000_000).alias("pval"),
        (F.lit(5.0) - F.col("o_totalprice") / 100_000).alias("neglog10_pval_EUR"),
        F.col("o_orderpriority").alias("trait"),
    )


VARIANT_SQL = "CAST(o_custkey % 22 + 1 AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) || ':A:' || substr(o_orderstatus, 1, 1)"


#: Rows of a task that groups lines or pairs of parts.
LINES_A_TASK = 500_000


def ld_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, index, variants): parts bought together are linked, r the cosine of their orders.

    An order has a few lines, so its pairs are few. The index lists parts that some order of several
    parts has; the variants asked for are all parts, matched or not. Lines are dealt by part, where the number of its
    orders is joined, then by order; only pairs with both numbers move after that, in as many tasks as lines need.
    So are lines for the index, before they are grouped: the rows of a split, or of one of the session's partitions, grow
    with the table.
    """
    read = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = max(1, -(-read.count() // LINES_A_TASK))  # the count comes from the files' footers
    lines = read.repartition(tasks, "l_partkey").distinct()
    counted = lines.join(lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).hint("shuffle_hash"), "l_partkey")
    linked = F.when(F.col("l_orderkey").isNotNull(), F.struct(F.col("l_partkey").alias("k"), "n"))  # lines without an order count in n alone
    orders = counted.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(linked)).alias("parts"))
    first = orders.select("parts", F.posexplode("parts").alias("at", "a"))
    both = first.select("a", F.explode(F.expr("slice(parts, at + 1, size(parts))")).alias("b"))
    keys = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in "kn"]
    counts = both.select(*keys).repartition(2 * tasks, "k_a").groupBy("k_a", "k_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("m"))
    triples = counts.select(F.col("k_a").alias("i"), F.col("k_b").alias("j"), (F.col("m") / F.sqrt(F.col("n_a") * F.col("n_b"))).alias("r"))
    part = table(spark, sf_dir, "part")
    named = part.withColumns({"chr": F.substring_index("p_brand", "#", -1), "pos": F.col("p_partkey"), "ref": F.lit("A"), "alt": F.lit("C")})
    several = read.dropna().repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).filter(F.size("parts") > 1)
    together = several.select(F.explode("parts").alias("p_partkey")).repartition(tasks, "p_partkey").distinct().hint("shuffle_hash")
    index = named.join(together, "p_partkey", "left_semi").select("chr", "pos", "ref", "alt", F.col("p_partkey").alias("idx"))
    asked = named.select(
        F.concat_ws(":", "chr", text("pos"), "ref", "alt").alias("variant"), F.col("p_partkey").alias("input_pos")
    )
    return triples, index, asked


LD_SQL = """
WITH lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
n AS (SELECT l_partkey, count(*) AS n FROM lines GROUP BY 1),
pairs AS (
  SELECT a.l_partkey AS i, b.l_partkey AS j, count(*) AS m
  FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2
), matched AS (
  SELECT p_partkey AS idx FROM part WHERE p_partkey IN (SELECT i FROM pairs UNION SELECT j FROM pairs)
), stored AS (
  SELECT i, j, m / sqrt(x.n * y.n) AS r FROM pairs JOIN n x ON x.l_partkey = i JOIN n y ON y.l_partkey = j
)
"""


def alignment_sql(pairs: str, before: str = "") -> str:
    """`WITH ... aligned(a, b, score)`: the alignment score of pairs (a, b) of strings, as `alignment_score` has it.

    The dynamic programme is a recursive query: a row holds the best scores of a prefix of `a` with all prefixes of `b`.
    """
    scores = ", ".join(f"('{x}{y}', {v:g})" for (x, y), v in BLOSUM62.items())
    return f"""
WITH RECURSIVE {before}s AS (SELECT map_from_entries(list((k, CAST(v AS DOUBLE)))) AS m FROM (VALUES {scores}) t(k, v)),
pairs AS ({pairs}),
dp AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS DOUBLE)) AS best FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: greatest(CAST(0 AS DOUBLE), list_max(row[1:j])))
  FROM (
    SELECT a, b, i, list_transform(range(1, len(b) + 1), lambda j: greatest(best[j + 1], best[j] + coalesce(m[a[i + 1] || b[j]], 0))) AS row
    FROM dp, s WHERE i < len(a)
  )
),
aligned AS (SELECT a, b, best[len(b) + 1] / greatest(len(a), len(b)) AS score FROM dp WHERE i = len(a))
"""
