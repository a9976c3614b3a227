"""Blocked lists and products, bitmaps, tiles and counted salts against brute force, and the plans they promise."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmer.operators import inventory, ld, segments, sequences, summaries
from kinmer.sources import readers, writers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("heavy", [0.0, 0.9])
def test_numbers_in_groups_of_any_size(spark, heavy):
    rng = random.Random(7)
    data = [("hot" if rng.random() < heavy else rng.choice(["a", "b", None]), k) for k in range(3000)]
    df = spark.createDataFrame(data, "g string, v long").repartition(6)
    got = {r.v: r.n for r in segments.number_in_groups(df, ["g"], ["v"], "n").collect()}
    seen, want = {}, {}
    for g, v in data:
        want[v] = seen[g] = seen.get(g, -1) + 1
    assert got == want


def test_postings_give_the_rows_back(spark):
    rng = random.Random(8)
    proteins = [(f"P{k}", "".join(rng.choice("ACDX") for _ in range(rng.randrange(60)))) for k in range(40)] + [("hot", "A" * 3000), ("none", None)]
    df = spark.createDataFrame(proteins, "acc string, seq string")
    index = sequences.kmer_index(df, 3, size=50)
    assert rows(sequences.posting_rows(index), "kmer", "acc", "pos0") == rows(sequences.kmer_rows(df, 3), "kmer", "acc", "pos0")
    per = {r.kmer: (r.n_hits, r.blocks) for r in index.groupBy("kmer").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("blocks")).collect()}
    for r in sequences.kmer_counts(df, 3).collect():
        assert per[r.kmer] == (r.n_hits, -(-r.n_hits // 50))
    assert index.agg(F.max("n")).first()[0] == 50


def similarity(a, b, k=3):
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def peptides():
    rng = random.Random(9)
    base = ["".join(rng.choice("ACDE") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    return sorted({*base, *(b[:-1] + "W" for b in base if len(b) > 4), "AAAAAAAA", "", "AAA"})


@pytest.mark.parametrize("block", [7, 1000])
def test_mean_similarity_by_blocks(spark, peptides, monkeypatch, block):
    monkeypatch.setattr(sequences, "GRAM_COLUMNS", 16)
    df = spark.createDataFrame([(p,) for p in [*peptides, *peptides[:5], None]], "peptide string")
    found = [similarity(a, b) for a, b in itertools.combinations(peptides, 2)]
    got = sequences.mean_similarity(df, block=block).first()
    assert got.n_sharing == sum(x > 0 for x in found) and got.mean_similarity == pytest.approx(np.mean(found))
    assert tuple(sequences.mean_similarity(df.limit(0)).first()) == (0, 0.0)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs(spark, peptides, threshold):
    df = spark.createDataFrame([(p,) for p in [*peptides, None]], "peptide string")
    want = sorted((a, b, similarity(a, b)) for a, b in itertools.combinations(peptides, 2) if similarity(a, b) >= threshold)
    assert rows(sequences.similar_pairs(df, threshold), "a", "b", "jaccard") == want


def test_distinct_counts_by_bits(spark):
    rng = random.Random(10)
    data = [(rng.choice(["p", "q", None]), rng.choice([None, *map(str, range(40_000))]), rng.random() < 0.5) for _ in range(20_000)]
    df = spark.createDataFrame(data, "g string, v string, flag boolean").withColumn("number", F.lit(1))
    got = summaries.distinct_by_bits(df, ["g"], "v", {"every": F.lit(True), "flagged": F.col("flag")})
    want = [(g, len({v for h, v, _ in data if h == g and v}), len({v for h, v, f in data if h == g and v and f})) for g in ("p", "q", None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "Expand" not in plan(got)


def test_protein_counts_without_expand(spark):
    data = [("P", "a", "A1", "Human_dominant"), ("P", "a", "A2", "Human_dominant"), ("P", "b", "A1", None), ("P", None, "A3", "Human_dominant"), ("Q", "c", "A1", "x"), (None, "d", "A9", "Human_dominant")]
    df = spark.createDataFrame(data, "uniprot_human string, peptide_human string, allele string, Binding_Class string")
    got = summaries.protein_dominance(df)
    assert "Expand" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("P", 1, 2, 3, 50.0), ("Q", None, 1, None, 0.0), (None, 1, 1, 1, 100.0)], key=repr)


def test_missing_work_without_the_grid(spark):
    rng = random.Random(11)
    chunks, alleles = [f"c{k}" for k in range(9)], [f"A{k:03d}" for k in range(150)]
    done = [(rng.choice(chunks[:8]), rng.choice([*alleles, "other"])) for _ in range(700)] + [("elsewhere", "A001")] + [("c0", a) for a in alleles]
    tables = (spark.createDataFrame([(c,) for c in chunks], "chunk string"), spark.createDataFrame([(a,) for a in alleles], "allele string"), spark.createDataFrame(done, "chunk string, allele string"))
    missing = inventory.missing_work(*tables)
    assert rows(missing, "chunk", "allele") == sorted({*itertools.product(chunks, alleles)} - {*done})
    told = inventory.completeness(*tables)
    assert {r.chunk: (r.n_done, r.n_expected) for r in told.collect()} == {c: (len({a for d, a in done if d == c and a in alleles}), 150) for c in chunks}
    assert {r.chunk: r.status for r in told.collect()}["c0"] == "complete"
    for df in (missing, told, inventory.work_grid(*tables[:2])):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    assert inventory.missing_work(tables[0], tables[1].limit(0), tables[2]).count() == 0


def test_tiles_are_pruned(spark, tmp_path):
    rng = random.Random(12)
    cells = {(i, j): rng.random() for i, j in ((rng.randrange(1000), rng.randrange(1000)) for _ in range(3000)) if i <= j}
    triples = spark.createDataFrame([(i, j, r) for (i, j), r in cells.items()], "i long, j long, r double")
    writers.write_ld_tiles(triples, str(tmp_path / "t"), 100)
    wanted = [*range(105, 190), *range(500, 560), 560, None]
    matched = spark.createDataFrame([(w,) for w in wanted], "idx long")
    got = ld.subset_tiles(readers.read_ld_tiles(spark, str(tmp_path / "t")), matched, 100)
    assert rows(got, "i", "j", "r") == sorted((i, j, r) for (i, j), r in cells.items() if i in wanted and j in wanted)
    assert "dynamicpruning" in plan(got)
    assert rows(got, "i", "j", "r") == rows(ld.subset_ld(triples, matched), "i", "j", "r")


def test_a_store_of_many_tiles_has_few_folders(spark, tmp_path):
    triples = spark.range(40_000).select((F.col("id") * 7 % 4000).alias("i"), (4000 + F.col("id") * 11 % 4000).alias("j"), F.lit(0.5).alias("r")).distinct()
    writers.write_ld_tiles(triples, str(tmp_path / "t"), 10)
    store = readers.read_ld_tiles(spark, str(tmp_path / "t"))
    assert store.select("ti", "tj").distinct().count() > 1000
    assert len([*(tmp_path / "t").rglob("*.parquet")]) <= 256
    matched = spark.range(0, 8000, 3).select(F.col("id").alias("idx"))
    got = ld.subset_tiles(store, matched, 10)
    assert rows(got, "i", "j", "r") == rows(ld.subset_ld(triples, matched), "i", "j", "r") and got.count() > 0
    assert ld.subset_tiles(store, matched.limit(0), 10).count() == 0


def test_a_matrix_of_more_variants_than_a_chunk(spark, tmp_path):
    rng, n = random.Random(13), 3001
    matched = spark.range(n).select(F.col("id").alias("input_pos"), F.format_string("1:%d:A:C", "id").alias("variant"), (F.col("id") * 7 % n).alias("idx"))
    upper = {(i, j): rng.random() for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(500)) if i < j}
    cells = ld.complete_symmetric(spark.createDataFrame([(i, j, r) for (i, j), r in upper.items()], "i long, j long, r double"), matched)
    assert writers.write_matrix_blocks(ld.matrix_blocks(cells, matched), str(tmp_path / "m")) == 4 * n + 16
    assert sorted(f.name for f in (tmp_path / "m").iterdir())[:2] == ["rows_00000_cols_00000.tsv", "rows_00000_cols_00001.tsv"]
    read = readers.read_matrix(spark, str(tmp_path / "m"))
    assert read.count() == n * n
    name = {k * 7 % n: f"1:{k}:A:C" for k in range(n)}
    want = [(name[i], name[i], 1.0) for i in range(n)] + [(name[a], name[b], r) for (i, j), r in upper.items() for a, b in ((i, j), (j, i))]
    assert rows(read.filter("r <> 0"), "variant", "other", "r") == sorted(want)
    none = ld.matrix_blocks(cells, matched.filter("idx < 0"))
    assert none.count() == 0


def test_a_matrix_moves_and_keeps_its_stored_cells(spark, tmp_path):
    """Whole lines, dense text files and the checkpoint of all cells each grew with the square of the variants."""
    from kinmer.plans import files

    n = 2500
    matched = spark.range(n).select(F.col("id").alias("input_pos"), F.format_string("1:%d:A:C", "id").alias("variant"), F.col("id").alias("idx"))
    cells = ld.complete_symmetric(spark.createDataFrame([(0, 1, 0.25), (0, 999, 0.5), (1000, 2499, -0.125), (3, 4, None)], "i long, j long, r double"), matched)
    told = ld.matrix_rows(cells, matched, ending=".tsv.gz")
    assert told.agg(F.sum(F.size("cells"))).first()[0] == n + 8 and "value" not in told.columns
    assert writers.write_matrix_blocks(told, str(tmp_path / "m")) == 3 * n + 9
    assert sum(f.stat().st_size for f in (tmp_path / "m").iterdir()) < n * n // 20  # bytes, 0.05 a cell; four before
    got = readers.read_matrix(spark, str(tmp_path / "m"))
    assert "Exchange" not in plan(got) and got.count() == n * n
    want = [(k, k, 1.0) for k in range(n)] + [(0, 1, 0.25), (1, 0, 0.25), (0, 999, 0.5), (999, 0, 0.5), (1000, 2499, -0.125), (2499, 1000, -0.125)]
    assert rows(got.filter("r <> 0"), "variant", "other", "r") == sorted((f"1:{i}:A:C", f"1:{j}:A:C", r) for i, j, r in want)
    assert got.filter("r IS NULL").count() == 0
    lines = {(r.file, r.at): r.value for r in ld.matrix_blocks(cells, matched).collect()}
    assert lines["rows_00000_cols_00000.tsv", 0].split("\t") == ["1:0:A:C", "1.0", "0.25", *["0.0"] * 997, "0.5"]
    assert lines["rows_00002_cols_00000.tsv", 2000].split("\t") == ["1:2000:A:C", *["0.0"] * 1000]
    with pytest.raises(Exception, match="[Dd]uplicat"):
        ld.matrix_blocks(cells.union(cells), matched).collect()
    got = files.matrix_file(spark, "/root/testdata/sf0.001")
    assert "ExistingRDD" not in plan(got) and got.count() > 0  # read from its files, not written as rows once more


def test_own_columns_stay(spark):
    df = spark.createDataFrame([("1:5:A:C", 9.0, "x", "y")], "variant string, neglog10_pval_EUR double, cut string, parsed string")
    assert {r.cut for r in ld.threshold_variants(df).collect()} == {"x"}
    assert ld.split_variants(df, ["cut"]).first().parsed == "y"


def test_a_frequent_allele_is_written_in_even_files(spark, tmp_path):
    alleles = ["HOT"] * 9000 + [f"R{k % 20}" for k in range(1000)]
    df = spark.createDataFrame([(f"p{k}", a, k) for k, a in enumerate(alleles)], "pair_id string, allele_safe string, parts int")
    writers.write_annotated(df, str(tmp_path / "a"), rows_per_file=1000)
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "a" / "allele_safe=HOT").glob("*.parquet")]
    assert len(sizes) == 9 and sum(sizes) == 9000 and max(sizes) < 1.25 * min(sizes)
    assert all(len([*f.glob("*.parquet")]) == 1 for f in (tmp_path / "a").glob("allele_safe=R*"))
    assert rows(spark.read.parquet(str(tmp_path / "a")), "pair_id", "allele_safe", "parts") == rows(df, "pair_id", "allele_safe", "parts")


def test_many_rare_alleles_share_tasks(spark, tmp_path):
    df = spark.range(6000).select(F.concat(F.lit("p"), "id").alias("pair_id"), F.format_string("R%04d", F.col("id") % 600).alias("allele_safe"))
    df = df.union(spark.range(3000).select(F.concat(F.lit("q"), "id"), F.lit("HOT"))).union(spark.range(5).select(F.concat(F.lit("n"), "id"), F.lit(None).cast("string")))
    writers.write_annotated(df, str(tmp_path / "a"), rows_per_file=1000)
    files = [*(tmp_path / "a").rglob("*.parquet")]
    assert len({f.name.split("-")[1] for f in files}) <= 4 * spark.sparkContext.defaultParallelism + 4  # tasks that wrote
    assert len(files) == 604  # three of the frequent one, one of each other
    assert rows(spark.read.parquet(str(tmp_path / "a")).na.fill("?"), "pair_id", "allele_safe") == rows(df.na.fill("?"), "pair_id", "allele_safe")


def test_parts_of_groups_follow_their_rows(spark):
    from kinmer.operators import casecontrol

    df = spark.range(2500).select(F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2400, F.concat(F.lit("r"), F.col("id") % 40)).alias("k"), "id")
    told = casecontrol.with_parts(df, ["k"], "id", "part", rows=500)
    assert told.columns == ["k", "id", "part"] and told.select("k", "id").exceptAll(df).isEmpty() and told.count() == 2500
    parts = {r.k: (r.n, r.most) for r in told.groupBy("k", "part").count().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).collect()}
    assert parts.pop("hot")[0] == 4 and {n for n, _ in parts.values()} == {1} and len(parts) == 41


def test_totals_without_a_window(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), (None, 3, 1), (None, None, 2)], "k string, v int, k_of int")
    from kinmer.operators import common

    got = common.group_sum(df, ["k"], "v", "s")
    assert got.columns == ["k", "v", "k_of", "s"] and "Window" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 1, 5, 3), ("a", 2, 7, 3), (None, 3, 1, 3), (None, None, 2, 3)], key=repr)


def test_pairs_are_neither_sorted_nor_made_twice(spark):
    from kinmer.plans import inputs

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        triples, index, asked = inputs.ld_tables(spark, "/root/testdata/sf0.001")
        matched, _ = ld.match_variants(asked, index)
        assert "posexplode" not in plan(index) and plan(triples).count("posexplode(") == 1
        subset = ld.subset_ld(spark.range(9).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("r")), spark.range(5).withColumnRenamed("id", "idx"))
        assert "SortMergeJoin" not in plan(subset) and rows(subset, "i", "j") == [(k, k + 1) for k in range(4)]
        assert plan(ld.complete_symmetric(triples, matched)).count("posexplode(") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_index_groups_lines_in_tasks_of_their_number(spark, monkeypatch):
    from kinmer.plans import inputs

    monkeypatch.setattr(inputs, "LINES_A_TASK", 1000)
    _, index, _ = inputs.ld_tables(spark, "/root/testdata/sf0.001")
    shuffles = [line for line in plan(index).splitlines() if "Exchange" in line]
    assert len(shuffles) == 3 and all(", 6)" in line for line in shuffles)  # not the session's number of partitions
    assert plan(index).rindex("ObjectHashAggregate") < plan(index).index("Exchange hashpartitioning(l_orderkey")  # nothing is grouped in the scan
    assert index.rdd.getNumPartitions() == 6 and index.count() > 0


def test_lines_without_an_order_link_no_parts(spark, tmp_path):
    import duckdb
    from oracle import same

    from kinmer.plans import general

    lines = [(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, 4), (3, 4), (None, 4), (None, 5), (None, 1), (4, None), (4, 6), (5, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"Brand#{k % 2}") for k in range(1, 9)], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    for name in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = general.ld_matrix(spark, str(tmp_path))
    same(got, db, general.ORACLES["ld_matrix"])
    assert rows(got.filter("i < j"), "i", "j") == [(1, 2), (1, 3)]
