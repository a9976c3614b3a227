"""Queries on binding classes and their summaries, hits, predictions and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmer.operators import binding, casecontrol, common, hits, predictions, summaries
from kinmer.plans import inputs
from kinmer.plans.inputs import ANNOTATED_SQL, ASSAY_SQL, HITS_SQL, class_sql, table, text
from kinmer.schemas import BOUND, CLASSES

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.annotate(inputs.wide(spark, sf_dir))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_COUNTS = ", ".join(f"count(DISTINCT CASE WHEN cls = '{c}' THEN allele END) AS {c}" for c in BOUND)
_TESTED = " + ".join(BOUND)
_FRACTIONS = ", ".join(f"CASE WHEN {_TESTED} = 0 THEN 0 ELSE round({c} / ({_TESTED}), 6) END AS {c}_fraction" for c in BOUND)
_SUMMARY_SQL = f"""
SELECT *, {_TESTED} AS n_alleles_tested, {_FRACTIONS} FROM (
  SELECT pair_id, {_COUNTS}, string_agg(DISTINCT uniprot_viral, ';' ORDER BY uniprot_viral) AS uniprot_viral,
         string_agg(DISTINCT uniprot_human, ';' ORDER BY uniprot_human) AS uniprot_human,
         min(peptide_viral) AS peptide_viral, min(peptide_human) AS peptide_human
  FROM ({ANNOTATED_SQL}) GROUP BY pair_id)
"""
_FRACTION_COLUMNS = [f"{c}_fraction" for c in BOUND]


@query(_SUMMARY_SQL)
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In what fraction of alleles does the human peptide dominate?"""
    return _rounded(summaries.pair_summary(_annotated(spark, sf_dir)), *_FRACTION_COLUMNS)


@query(f"SELECT pair_id, cls AS binding_class, count(DISTINCT allele) AS n_alleles FROM ({ANNOTATED_SQL}) GROUP BY 1, 2")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alleles of each pair and class."""
    return summaries.class_counts(_annotated(spark, sf_dir)).withColumnRenamed("Binding_Class", "binding_class")


@query(f"SELECT pair_id, {_COUNTS} FROM ({ANNOTATED_SQL}) GROUP BY 1")
def pivoted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the same with a column for each class."""
    return summaries.pivot_classes(summaries.class_counts(_annotated(spark, sf_dir)))


@query(f"""
SELECT pair_id, uniprot_viral, uniprot_human, peptide_viral, peptide_human, 'human' AS prot2_origin, allele,
       round(score_viral, 6) AS ba_score_viral, round(score_human, 6) AS ba_score_human, round(diff, 6) AS ba_score_diff,
       round(rank_viral, 6) AS ba_rank_viral, round(rank_human, 6) AS ba_rank_human, cls AS binding_class, allele_safe,
       chunk_source, '9-mer' AS k_mer, 'I' AS mhc_type,
       CASE WHEN substr(allele, 5, 1) < 'D' THEN substr(allele, 5, 1) ELSE 'Unknown' END AS hla_class
FROM ({ANNOTATED_SQL})""")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long annotated table."""
    df = _annotated(spark, sf_dir)
    df = _rounded(df, "BA_score_viral", "BA_score_human", "BA_score_diff", "BA_Rank_viral", "BA_Rank_human")
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def _variants(spark: SparkSession, sf_dir: str, require: str, edge: str) -> DataFrame:
    wide = inputs.wide(spark, sf_dir).withColumn("cls", binding.binding_class(require, edge))
    return wide.groupBy("Allele", "cls").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("Allele", "allele")


def _variant_sql(require: str, edge: str) -> str:
    return f"SELECT {inputs.ALLELE_SQL} AS allele, {class_sql(require, edge)} AS cls, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query(_variant_sql("viral", "equivalent"))
def class_counts_viral_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18b."""
    return _variants(spark, sf_dir, "viral", "equivalent")


@query(_variant_sql("both", "equivalent"))
def class_counts_both_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18c."""
    return _variants(spark, sf_dir, "both", "equivalent")


@query(f"""
SELECT CASE WHEN Human_dominant_fraction >= 0.05 THEN 'Human_dominant' WHEN Viral_dominant_fraction >= 0.05 THEN 'Viral_dominant'
       ELSE 'Mixed' END AS category, count(*) AS n FROM ({_SUMMARY_SQL}) GROUP BY 1""")
def pair_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, A10."""
    return summaries.category_counts(summaries.pair_summary(_annotated(spark, sf_dir)))


@query(f"""
SELECT uniprot_viral, uniprot_human, count(*) AS n_peptides, count_if(human_flag) AS n_flagged,
       round(count_if(human_flag) / count(*), 6) AS flagged_fraction, round(sum(bias), 4) AS bias
FROM (SELECT *, Human_dominant_fraction >= 0.01 AS human_flag, round(Human_dominant_fraction - Viral_dominant_fraction, 6) AS bias
      FROM ({_SUMMARY_SQL})) GROUP BY 1, 2""")
def protein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, P21, A9."""
    summary = _rounded(summaries.pair_summary(_annotated(spark, sf_dir)), *_FRACTION_COLUMNS)
    flagged = _rounded(summaries.with_flag(summaries.with_bias(summary)), "bias_score")
    return _rounded(summaries.protein_pair_summary(flagged), "flagged_fraction").withColumn("bias", F.round("bias", 4))


_CLASS_TABLE_SQL = ", ".join(f"count_if(cls = '{c}') AS {c}, round(100 * count_if(cls = '{c}') / count(*), 6) AS {c}_pct" for c in CLASSES)


@query(f"SELECT allele_safe, {_CLASS_TABLE_SQL}, count(*) AS total FROM ({ANNOTATED_SQL}) GROUP BY 1")
def allele_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, F1."""
    df = summaries.allele_class_table(_annotated(spark, sf_dir))
    df = _rounded(df, *[f"{c}_pct" for c in CLASSES]).withColumnRenamed("Total", "total")
    return common.sort_desc(df, "Equivalent_binding_pct", "allele_safe")


_PCT_SQL = f"""
SELECT allele_safe, min(allele) AS allele, count(*) AS total, 100 * count_if(cls = 'Human_dominant') / count(*) AS human_pct,
       100 * count_if(cls = 'Viral_dominant') / count(*) AS viral_pct, count_if(cls = 'Equivalent_binding') AS equivalent,
       count_if(cls = 'Non_binder') AS non_binder
FROM ({ANNOTATED_SQL}) GROUP BY 1
"""
_CATEGORY_SQL = f"""
SELECT p.*, CASE WHEN human_pct >= h AND viral_pct >= v THEN 'Dual_high' WHEN human_pct >= h THEN 'Human_dominant'
       WHEN viral_pct >= v THEN 'Viral_dominant' ELSE 'Neutral' END AS category
FROM ({_PCT_SQL}) p, (SELECT quantile_cont(human_pct, 0.95) AS h, quantile_cont(viral_pct, 0.95) AS v FROM ({_PCT_SQL}))
"""
COLOURS = {"Dual_high": "purple", "Human_dominant": "red", "Viral_dominant": "blue", "Neutral": "grey"}


@query(f"""
SELECT allele_safe, allele, total, round(human_pct, 6) AS human_pct, round(viral_pct, 6) AS viral_pct, equivalent, non_binder, category,
       round(log10(total + 1), 6) AS log_total,
       CASE category WHEN 'Dual_high' THEN 'purple' WHEN 'Human_dominant' THEN 'red' WHEN 'Viral_dominant' THEN 'blue' ELSE 'grey' END AS colour,
       round(40 + 60 * log10(total + 1) / max(log10(total + 1)) OVER (), 6) AS size
FROM ({_CATEGORY_SQL})""")
def allele_volcano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A8, P22, P23, H9."""
    df = summaries.volcano_points(summaries.dominance(summaries.allele_summary_pct(_annotated(spark, sf_dir))), COLOURS)
    df = _rounded(df, "Human_pct", "Viral_pct", "log_total", "size")
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


@query(f"""
SELECT allele_safe, equivalent FROM ({_PCT_SQL}) ORDER BY equivalent DESC, allele_safe LIMIT 40""")
def top_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the forty alleles with most equivalent pairs."""
    df = summaries.allele_summary_pct(_annotated(spark, sf_dir)).select("allele_safe", F.col("Equivalent").alias("equivalent"))
    return common.top_k(df, "equivalent", 40, "allele_safe")


_PROTEIN_SQL = f"""
SELECT uniprot_human, nullif(count(DISTINCT CASE WHEN cls = 'Human_dominant' THEN peptide_human END), 0) AS dominant_peptides,
       count(DISTINCT peptide_human) AS total_peptides,
       nullif(count(DISTINCT CASE WHEN cls = 'Human_dominant' THEN allele END), 0) AS dominant_alleles,
       round(100 * count(DISTINCT CASE WHEN cls = 'Human_dominant' THEN peptide_human END) / count(DISTINCT peptide_human), 6) AS dominant_pct
FROM ({ANNOTATED_SQL}) GROUP BY 1
"""


@query(_PROTEIN_SQL)
def protein_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, J19."""
    return _rounded(summaries.protein_dominance(_annotated(spark, sf_dir)), "dominant_pct")


@query(f"""
SELECT round(avg(dominant_pct), 4) AS mean, round(median(dominant_pct), 4) AS median, count_if(dominant_pct > 50) AS n_above
FROM ({_PROTEIN_SQL})""")
def dominance_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return _rounded(summaries.describe_pct(_rounded(summaries.protein_dominance(_annotated(spark, sf_dir)), "dominant_pct")), "mean", "median", digits=4)


_BREAKDOWN = ", ".join(f"count(DISTINCT CASE WHEN substr(allele, 5, 1) = '{t}' THEN allele END) AS HLA_{t}" for t in "ABC")


@query(f"""
SELECT uniprot_human, {_BREAKDOWN}, count(DISTINCT allele) AS total FROM ({ANNOTATED_SQL})
WHERE cls = 'Human_dominant' AND substr(allele, 5, 1) IN ('A', 'B', 'C') GROUP BY 1""")
def hla_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, H6 strict."""
    return summaries.hla_breakdown(_annotated(spark, sf_dir))


_PER_PEPTIDE_SQL = f"SELECT peptide_human, count(DISTINCT allele) AS n_alleles FROM ({ANNOTATED_SQL}) WHERE cls = 'Human_dominant' GROUP BY 1"


@query(f"SELECT n_alleles, count(*) AS n_peptides FROM ({_PER_PEPTIDE_SQL}) GROUP BY 1")
def alleles_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return summaries.alleles_histogram(summaries.alleles_per_peptide(_annotated(spark, sf_dir)))


@query(f"SELECT count(*) AS n_peptides, round(avg(n_alleles), 6) AS mean, max(n_alleles) AS most FROM ({_PER_PEPTIDE_SQL})")
def alleles_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many peptides, and the mean and the most alleles of one."""
    return _rounded(summaries.alleles_described(summaries.alleles_per_peptide(_annotated(spark, sf_dir))), "mean")


@query(f"{_PER_PEPTIDE_SQL} ORDER BY n_alleles DESC, peptide_human LIMIT 10")
def top_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten peptides with most alleles."""
    return summaries.top_peptides(summaries.alleles_per_peptide(_annotated(spark, sf_dir)))


@query(f"""
WITH best AS (SELECT uniprot_human FROM ({_PROTEIN_SQL}) ORDER BY dominant_peptides DESC NULLS LAST, uniprot_human LIMIT 1)
SELECT peptide_human, allele, count(*) AS n FROM ({ANNOTATED_SQL})
WHERE cls = 'Human_dominant' AND uniprot_human IN (FROM best) GROUP BY 1, 2""")
def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    df = _annotated(spark, sf_dir)
    return summaries.incidence(df, summaries.richest_protein(summaries.protein_dominance(df)))


_FIRST_SQL = f"""
SELECT uniprot_human, peptide_human, count(DISTINCT allele) AS n_alleles FROM ({ANNOTATED_SQL}) WHERE cls = 'Human_dominant'
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY uniprot_human ORDER BY peptide_human) <= 3
"""


@query(_FIRST_SQL)
def first_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return summaries.peptides_of_protein(_annotated(spark, sf_dir))


@query(f"""
SELECT d.uniprot_human, d.uniprot_human || '; ' || CAST(coalesce(dominant_peptides, 0) AS VARCHAR) || ' of ' || CAST(total_peptides AS VARCHAR)
       || ' peptides dominant (' || printf('%.1f', dominant_pct) || '%)' || coalesce('; ' || firsts, '') AS report
FROM ({_PROTEIN_SQL}) d LEFT JOIN (
  SELECT uniprot_human, string_agg(peptide_human || ' (' || CAST(n_alleles AS VARCHAR) || ' alleles)', ', ' ORDER BY peptide_human) AS firsts
  FROM ({_FIRST_SQL}) GROUP BY 1) USING (uniprot_human)""")
def protein_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12."""
    return summaries.protein_report(_annotated(spark, sf_dir))


_RETIRED = "SELECT c_name FROM customer WHERE c_nationkey = 3"


@query(f"""
SELECT qseqid, hu_prot_id, round(similarity, 6) AS similarity FROM ({HITS_SQL})
WHERE similarity BETWEEN 75 AND 95 AND sstart <= send AND (hu_prot_id IS NULL OR hu_prot_id NOT IN ({_RETIRED}))""")
def similar_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P14, J3, H3."""
    retired = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_name")
    kept = hits.drop_retired(hits.filter_similarity(hits.with_similarity(hits.drop_reversed(inputs.hits(spark, sf_dir)))), retired)
    return _rounded(kept.select("qseqid", "hu_prot_id", "similarity"), "similarity")


@query(f"""
SELECT hu_prot_id, count(*) AS n_hits, any_value(s_name) AS seq, 'found' AS status FROM ({HITS_SQL})
JOIN supplier ON s_suppkey = CAST(right(hu_prot_id, 9) AS BIGINT) GROUP BY 1
UNION ALL
SELECT hu_prot_id, count(*), NULL, 'missing' FROM ({HITS_SQL})
WHERE hu_prot_id IS NULL OR CAST(right(hu_prot_id, 9) AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def attached_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by accession with a sequence, and those without one."""
    supplier = table(spark, sf_dir, "supplier")
    proteins = supplier.select(F.concat(F.lit("Customer#"), F.lpad(text("s_suppkey"), 9, "0")).alias("acc"), F.col("s_name").alias("seq"))
    rows = hits.with_similarity(inputs.hits(spark, sf_dir))
    found, missing = hits.attach_sequence(rows, proteins)
    n = F.count(F.lit(1)).alias("n_hits")
    have = found.groupBy("hu_prot_id").agg(n, F.min("seq").alias("seq")).withColumn("status", F.lit("found"))
    counts = rows.groupBy("hu_prot_id").agg(n)
    gone = missing.join(counts, missing.hu_prot_id.eqNullSafe(counts.hu_prot_id)).select(missing.hu_prot_id, "n_hits")
    return have.unionByName(gone.withColumns({"seq": F.lit(None).cast("string"), "status": F.lit("missing")}))


@query("""
SELECT resolved, count(*) AS n FROM (
  SELECT CASE WHEN l_suppkey % 3 = 0 THEN n_name ELSE s_name END AS resolved
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1""")
def resolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier maps to its nation."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    mapping = supplier.filter("s_suppkey % 3 = 0").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    mapping = mapping.select(F.col("s_name").alias("Original_ID"), F.col("n_name").alias("Mapped_ID"))
    named = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("UniProt_acc"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey").join(named, "l_suppkey")
    return hits.resolve_ids(lines, mapping).groupBy("resolved").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT pep_id, CASE WHEN e <= len(text) THEN substr(text, CAST(s AS INT), CAST(e - s + 1 AS INT)) END AS peptide,
       CASE WHEN text IS NULL THEN 'Sequence not found' WHEN e > len(text) THEN 'Out of bounds' END AS reason
FROM (SELECT o_orderkey AS pep_id, o_custkey % 45 AS acc, 1 + o_orderkey % 300 AS s, 1 + o_orderkey % 300 + o_custkey % 60 AS e FROM orders)
LEFT JOIN benchmark ON item_id = acc""")
def cut_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the benchmark's texts, and why some can't be cut."""
    meta = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pep_id"),
        text(F.col("o_custkey") % 45).alias("UniProt_acc"),
        (1 + F.col("o_orderkey") % 300).cast("int").alias("start"),
        (1 + F.col("o_orderkey") % 300 + F.col("o_custkey") % 60).cast("int").alias("end"),
    )
    proteins = table(spark, sf_dir, "benchmark").select(text("item_id").alias("acc"), F.col("text").alias("seq"))
    found, failed = hits.cut_peptides(meta, proteins)
    return common.union_all(found, failed).select("pep_id", "peptide", "reason")


@query("""
WITH hits AS (
  SELECT c_custkey AS hit, c_custkey % 40 AS v, c_nationkey AS h, CAST(1 + c_custkey % 9 AS INT) AS s, CAST(25 + c_custkey % 30 AS INT) AS e FROM customer
), sides AS (
  SELECT hit, v, translate(a.text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sv, translate(substr(b.text, s, e - s + 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sh
  FROM hits JOIN benchmark a ON a.item_id = v JOIN benchmark b ON b.item_id = h
), pairs AS (
  SELECT hit, v, i, substr(sv, i, 9) AS pv, substr(sh, i, 9) AS ph
  FROM sides, LATERAL (SELECT CAST(unnest(range(1, least(len(sv), len(sh)) - 9 + 2)) AS INT) AS i)
)
SELECT CAST(v AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS pair_id, hit, 'V' || CAST(v AS VARCHAR) AS uniprot_viral, pv AS peptide_viral, ph AS peptide_human FROM pairs WHERE pv != ph""")
def kmer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional 9-mer pairs of benchmark texts, one hit a customer."""
    found = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("hit"),
        F.format_string("%d|V%d|1-60", F.col("c_custkey") % 40, F.col("c_custkey") % 40).alias("qseqid"),
        text("c_nationkey").alias("hu_prot_id"),
        (1 + F.col("c_custkey") % 9).cast("int").alias("sstart"),
        (25 + F.col("c_custkey") % 30).cast("int").alias("send"),
    )
    named = F.format_string("%d|V%d|1-60", F.col("item_id"), F.col("item_id"))
    texts = table(spark, sf_dir, "benchmark").select(named.alias("id"), text("item_id").alias("acc"), F.col("text").alias("seq"))
    pairs = hits.positional_pairs(hits.attach_both(found, texts.drop("acc"), texts.drop("id")))
    return hits.drop_identical(pairs).select("pair_id", "hit", "uniprot_viral", "peptide_viral", "peptide_human")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_ORDER_SQL = ", ".join(_LINE_ORDER)


@query(f"""
WITH pred AS (
  SELECT l_suppkey AS chunk, l_returnflag AS flag, l_partkey AS score,
         row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {_ORDER_SQL}) - 1 AS row_no FROM lineitem
), want AS (SELECT chunk, count(*) AS n FROM pred WHERE flag = 'A' GROUP BY 1),
ok AS (SELECT chunk, flag FROM pred GROUP BY chunk, flag HAVING count(*) = (SELECT n FROM want WHERE want.chunk = pred.chunk)),
rows AS (SELECT chunk, flag, row_no // 2 AS pair, row_no % 2 AS side, score FROM pred JOIN ok USING (chunk, flag))
SELECT 'f_chunk_' || CAST(v.chunk AS VARCHAR) || '_' || v.flag AS source_file, 'p_' || CAST(v.pair AS VARCHAR) AS pair_id,
       v.score AS score_viral, h.score AS score_human
FROM rows v JOIN rows h ON v.chunk = h.chunk AND v.flag = h.flag AND v.pair = h.pair AND v.side = 0 AND h.side = 1
WHERE v.score != h.score""")
def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier and flag; headers are as many as the supplier's A rows."""
    numbered = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f_chunk_"), text("l_suppkey"), F.lit("_"), "l_returnflag").alias("source_file"),
        F.col("l_suppkey").alias("chunk"),
        F.lit("HLA-A").alias("Allele"),
        (F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy(*_LINE_ORDER)) - 1).alias("row_no"),
        F.col("l_partkey").alias("score"),
        F.col("l_returnflag").alias("flag"),
    )
    headers = numbered.filter("flag = 'A'").select(
        "chunk", "row_no",
        F.when(F.col("row_no") % 2 == 0, "VIRAL").otherwise("HUMAN").alias("type"),
        F.concat(F.lit("p_"), text(F.floor(F.col("row_no") / 2))).alias("pair_id"),
    )
    rows = predictions.zip_with_headers(predictions.guard_counts(numbered.drop("flag"), headers), headers).drop("row_no", "chunk")
    pairs = predictions.pair_predictions(rows)
    return hits.drop_identical(pairs, "score_viral", "score_human", keep_nulls=True).select("source_file", "pair_id", "score_viral", "score_human")


@query(f"""
SELECT uniprot_human, count(*) AS n FROM ({ANNOTATED_SQL}) WHERE uniprot_human IN (SELECT p_brand FROM part WHERE p_size = 50) GROUP BY 1""")
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of proteins on a candidate list."""
    candidates = table(spark, sf_dir, "part").filter("p_size = 50").select("p_brand")
    kept = predictions.keep_candidates(_annotated(spark, sf_dir), candidates, "uniprot_human")
    return kept.groupBy("uniprot_human").agg(F.count(F.lit(1)).alias("n"))


_CONFIRMED_SQL = f"""
SELECT *, CASE WHEN bool_or(zscore IS NULL) OVER w THEN NULL ELSE CAST(sum(CAST(zscore > 3.5 AS INT)) OVER w = 2 AS INT) END AS hit_both
FROM ({ASSAY_SQL}) WINDOW w AS (PARTITION BY id1, pep_id)
"""
_TABLE_SQL = f"""
SELECT pep_id, round(avg(hit_both) FILTER (casestat = 0), 6) AS prop_controls, round(avg(hit_both) FILTER (casestat = 1), 6) AS prop_cases,
       CAST(round_even(avg(hit_both) FILTER (casestat = 1) * 30, 0) AS INT) AS cases_with,
       CAST(30 - round_even(avg(hit_both) FILTER (casestat = 1) * 30, 0) AS INT) AS cases_without,
       CAST(round_even(avg(hit_both) FILTER (casestat = 0) * 30, 0) AS INT) AS controls_with,
       CAST(30 - round_even(avg(hit_both) FILTER (casestat = 0) * 30, 0) AS INT) AS controls_without
FROM (SELECT *, sum(hit_both) OVER (PARTITION BY pep_id) AS hits FROM ({_CONFIRMED_SQL}) WHERE repnum = 1) WHERE hits >= 1 GROUP BY 1
"""


@query(f"SELECT id1, pep_id, repnum, hit_both FROM ({_CONFIRMED_SQL})")
def confirmed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, W1."""
    return casecontrol.confirm_hits(inputs.assay(spark, sf_dir)).select("id1", "pep_id", "repnum", "hit_both")


def _case_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casecontrol.case_control_table(casecontrol.confirmed_once(casecontrol.confirm_hits(inputs.assay(spark, sf_dir))))


@query(_TABLE_SQL)
def case_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, A13."""
    df = _rounded(_case_control(spark, sf_dir), "Prop_controls", "Prop_cases")
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def _choose(n: str, k: str) -> str:
    """ln of n over k in SQL."""
    return f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"


# The table's margins are the cohort's 30 and 30 and the number with a hit, w: x of these are cases.
@query(f"""
WITH counted AS (SELECT *, cases_with + controls_with AS w FROM ({_TABLE_SQL})),
every AS (
  SELECT pep_id, x, cases_with, exp({_choose('30', 'x')} + {_choose('30', 'w - x')} - ({_choose('60', 'w')})) AS p
  FROM counted, LATERAL (SELECT unnest(range(greatest(0, w - 30), least(30, w) + 1)) AS x)
), tested AS (
  SELECT pep_id, round(least(1.0, sum(p)), 6) AS p_value FROM every JOIN (SELECT pep_id, p AS seen FROM every WHERE x = cases_with) USING (pep_id)
  WHERE p <= seen * (1 + 1e-7) GROUP BY 1
)
SELECT pep_id, cases_with, cases_without, controls_with, controls_without, p_value, first_seen
FROM counted LEFT JOIN tested USING (pep_id)
LEFT JOIN (SELECT event_type AS pep_id, min(ts) AS first_seen FROM events GROUP BY 1) USING (pep_id)""")
def fisher_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values with the event type's first time as metadata."""
    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pep_id")).agg(F.min("ts").alias("first_seen"))
    tested = casecontrol.with_metadata(casecontrol.fisher_exact(_case_control(spark, sf_dir)), events)
    return _rounded(tested.drop("Prop_cases", "Prop_controls"), "p_value")
