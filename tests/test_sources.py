"""Files written and read back; streams over files that arrive."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from kinmer.operators import alleles, hits
from kinmer.operators.casecontrol import map_groups
from kinmer.schemas import GWAS_P, HITS, TCELL, WIDE
from kinmer.sources import formats, readers, writers
from kinmer.streaming import ingest


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sp|P1|N one\nACD\nEFG\n>plain\nAAAA\n>sp|P1|N two\nCC\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">7|P9|1-3\nACD\n")
    df = readers.read_fasta(spark, str(tmp_path))
    assert sorted((r.id, r.acc, r.seq) for r in df.collect()) == [("7|P9|1-3", "P9", "ACD"), ("plain", "plain", "AAAA"), ("sp|P1|N", "P1", "ACDEFG"), ("sp|P1|N", "P1", "CC")]
    assert {r.acc: r.seq for r in hits.lookup_sequences(df).collect()} == {"P1": "CC", "P9": "ACD", "plain": "AAAA"}
    writers.write_fasta(df.select("id", F.repeat("seq", F.lit(30)).alias("seq")), str(tmp_path / "out"))
    again = readers.read_fasta(spark, str(tmp_path / "out"))
    assert {len(r.seq) for r in again.collect()} == {180, 120, 60, 90}


def test_predictions_and_stream(spark, tmp_path):
    fasta, xls, out = tmp_path / "fasta", tmp_path / "xls", str(tmp_path / "wide")
    fasta.mkdir(), xls.mkdir()
    (fasta / "matched_pairs_chunk_1.fasta").write_text(">VIRAL_7_1_P1\nACD\n>HUMAN_7_1_Q1\nACE\n>VIRAL_7_2_P1\nCDE\n>HUMAN_7_2_Q1\nCDE\n>odd\nA\n")
    lines = ["HLA-A01:01\t\t", "Pos\tPeptide\tBA_score\tBA_Rank", "0\tACD\t0.9\t1.0", "0\tACE\tx\t2.0", "0\tCDE\t0.1\t3.0", "0\tCDE\t0.1\t3.0", ""]
    (xls / "HLA-A01_01_matched_pairs_chunk_1.xls").write_text("\n".join(lines))
    (xls / "HLA-B_matched_pairs_chunk_1.xls").write_text("\nPeptide\tBA_score\nACD\t0.5\n")
    headers = readers.read_pair_headers(spark, str(fasta))
    assert headers.count() == 4
    read = readers.read_predictions(spark, str(xls))
    assert {(r.Allele, r.row_no, r.Peptide, r.BA_score) for r in read.collect()} >= {("HLA-A01:01", 1, "ACE", None), ("Unknown", 0, "ACD", 0.5)}
    for _ in range(2):  # the second run finds no new file
        ingest.aggregate_stream(spark, str(xls), headers, out, str(tmp_path / "state"))
    got = ingest.read_results(spark, out).collect()
    assert [(r.pair_id, r.Allele, r.Peptide_viral, r.Peptide_human, r.uniprot_human) for r in got] == [("7_1", "HLA-A01:01", "ACD", "ACE", "Q1")]
    state = str(tmp_path / "state")
    (xls / "late_matched_pairs_chunk_1.xls").write_text("\n".join(["HLA-C", *lines[1:]]))
    for force, n in ((False, 2), (True, 2), (False, 2)):
        ingest.aggregate_stream(spark, str(xls), headers, out, state, force=force)
        assert ingest.read_results(spark, out).count() == spark.read.parquet(out).count() == n
    (xls / "HLA-B_matched_pairs_chunk_1.xls").write_text("\n".join(["HLA-B", *lines[1:]]))  # gave no rows before
    (xls / "new_matched_pairs_chunk_1.xls").write_text("\n".join(["HLA-D", *lines[1:]]))
    for force in (False, False, True, False):
        ingest.aggregate_stream(spark, str(xls), headers, out, state, force=force)
        assert sorted(r.Allele for r in ingest.read_results(spark, out).collect()) == ["HLA-A01:01", "HLA-B", "HLA-C", "HLA-D"]


def test_annotated_stream_and_partitions(spark, tmp_path):
    wide = spark.createDataFrame([("1_1", "HLA-A*01:01", "V", "H", "p", "q", "x_chunk_4.xls", 0.9, 0.1, 1.0, 1.0)], WIDE)
    writers.write_tsv_parts(wide, str(tmp_path / "in"))
    ingest.annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    df = ingest.read_results(spark, str(tmp_path / "out"))
    assert df.first().Binding_Class == "Human_dominant"
    writers.write_annotated(df, str(tmp_path / "by_allele"))
    kept = readers.read_annotated(spark, str(tmp_path / "by_allele")).filter("allele_safe = 'HLA-A_01:01'")
    assert kept.count() == 1


def test_tables_and_lists(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("q\tsp|P|n\t90.0\t80\t1\t0\t100\t200\t1\t80\t5\t84\t1e-5\t50.0\n")
    assert readers.read_hits(spark, str(tmp_path / "hits.tsv")).schema == HITS
    (tmp_path / "ids.txt").write_text("b\n\n a \nb\n")
    assert [r.id for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("input_pos").collect()] == ["b", "a", "b"]
    (tmp_path / "alleles.txt").write_text("A1 HLA-A01\nA2\n\n")
    assert sorted((r.id, r.name) for r in readers.read_allele_list(spark, str(tmp_path / "alleles.txt")).collect()) == [("A1", "HLA-A01"), ("A2", "A2")]
    assert readers.read_allele_list(spark, str(tmp_path / "alleles.txt"), "skip").count() == 1
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t34aa, >A1... *\n1\t34aa, >A2... at 100%\n>Cluster 1\n0\t34aa, >A3... at 1%\n")
    clusters = readers.read_clusters(spark, str(tmp_path / "c.clstr"))
    assert sorted((r.cluster, r.representative, r.member) for r in clusters.collect()) == [("Cluster 0", "A1", "A1"), ("Cluster 0", "A1", "A2")]
    listed = spark.createDataFrame([("A1", "HLA-A01")], "id string, name string")
    mapping = alleles.mapping_table(alleles.with_names(clusters, listed), listed).collect()
    assert [tuple(r) for r in mapping] == [("A1", "HLA-A01", "A1,A2", "HLA-A01,NA")]
    (tmp_path / "pseudo.txt").write_text("A1  YFAM\nA9 KKK\n")
    assert [(r.id, r.seq) for r in alleles.attach_pseudoseq(listed, readers.read_pseudoseq(spark, str(tmp_path / "pseudo.txt"))).collect()] == [("A1", "YFAM")]
    assert {r.file for r in readers.file_inventory(spark, str(tmp_path), "*.txt").collect()} == {"ids.txt", "alleles.txt", "pseudo.txt"}


def test_bgz(spark, tmp_path):
    blocks = gzip.compress(b"variant\tpval\n1:1:A:C\t0.5\n") + gzip.compress(b"1:2:A:C\tNA\n2:3:A:C\t0.01\n")
    (tmp_path / "g.tsv.bgz").write_bytes(blocks)
    got = readers.read_bgz_tsv(spark, str(tmp_path / "g.tsv.bgz"), GWAS_P).collect()
    assert [tuple(r) for r in got] == [("1:1:A:C", 0.5), ("1:2:A:C", None), ("2:3:A:C", 0.01)]


def test_bgz_splits(spark, tmp_path):
    """Blocks that begin anywhere in lines, ranges shorter and longer than a block, one line longer than both."""
    lines = [f"{k % 22}:{k}:A:C\t{k / 7}" for k in range(60_000)]
    lines[30_000] = "x" * 200_000 + "\t0.25"
    rows = [("g.tsv.bgz", -1, "variant\tpval"), *(("g.tsv.bgz", k, line) for k, line in enumerate(lines))]
    assert writers.write_named_files(spark.createDataFrame(rows, "file string, at long, value string"), str(tmp_path / "b")) == len(rows)
    assert gzip.decompress((tmp_path / "b" / "g.tsv.bgz").read_bytes()).decode().split("\n")[:-1] == [v for _, _, v in rows]
    want = sorted((v.split("\t")[0], float(v.split("\t")[1])) for v in lines)
    for split in (3_000, 70_000, 1 << 20):
        got = readers.read_bgz_tsv(spark, str(tmp_path / "b"), GWAS_P, split)
        assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        writers.write_named_files(spark.createDataFrame(rows[:2], "file string, at long, value string"), str(tmp_path / "b"))


def test_json_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"structure_id": 1, "receptor_ids": [1, 2]}, {"structure_id": 2}]')
    df = readers.read_json_pages(spark, str(tmp_path), TCELL)
    assert df.count() == 2 and readers.read_json_pages(spark, str(tmp_path), TCELL, 1).count() == 1


def test_fasta_chunks(spark, tmp_path):
    pairs = spark.createDataFrame([(k, 1, "P", "Q", "ACD", "ACE") for k in range(7)], "pep int, i int, uniprot_viral string, uniprot_human string, peptide_viral string, peptide_human string")
    writers.write_fasta_chunks(pairs, str(tmp_path / "out"), ["pep"], n=4, per_dir=2)
    files = [tmp_path / "out" / f"chunk_{d}" / f"matched_pairs_chunk_{c}.fasta" for d, c in ((1, 1), (1, 2), (2, 3), (2, 4))]
    assert [p.read_text().count(">") for p in files] == [4, 4, 4, 2]
    assert files[0].read_text().startswith(">VIRAL_0_1_P\nACD\n>HUMAN_0_1_Q\nACE\n")
    headers = readers.read_pair_headers(spark, str(tmp_path / "out" / "*" / "*.fasta")).collect()
    assert sorted((r.chunk, r.row_no, r.type, r.pair_id) for r in headers)[:3] == [(1, 0, "VIRAL", "0_1"), (1, 1, "HUMAN", "0_1"), (1, 2, "VIRAL", "1_1")]
    assert {r.chunk for r in headers} == {1, 2, 3, 4} and len(headers) == 14
    with pytest.raises(ValueError):
        writers.write_fasta_chunks(pairs, str(tmp_path / "odd"), ["pep"], n=3)


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 0.01, "1:1:A:C"), ("t", 0.05, "1:2:A:C")], "trait string, threshold double, variant string")
    writers.write_ids(df, str(tmp_path / "ids"), "variant", ["trait", "threshold"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1:1:A:C", "1:2:A:C"]
    writers.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), df.schema).count() == 2
    writers.write_kmer_index(df.withColumnRenamed("variant", "kmer"), str(tmp_path / "kmers"))
    assert spark.read.parquet(str(tmp_path / "kmers")).count() == 2
    grouped = map_groups(df, ["trait"], lambda pdf: pdf.groupby("trait").threshold.sum().reset_index(), "trait string, threshold double")
    assert grouped.first().threshold == pytest.approx(0.06)


# Data sources


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 7).cast("string").alias("file"), F.col("id").alias("at"), F.when(F.col("id") == 1999, F.raise_error("broken")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        writers.write_named_files(rows, str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").rglob("*") if f.is_file()]
    good = rows.filter("id < 1999")
    assert writers.write_named_files(good, str(tmp_path / "out"), "overwrite") == 1999
    assert sorted(f.name for f in (tmp_path / "out").rglob("*")) == list("0123456")
    with pytest.raises(Exception, match="exists"):  # what is there stays, and the new job leaves nothing
        good.select("file", "value").coalesce(1).sort("file").write.format("named_files").mode("append").save(str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").rglob("*")) == list("0123456")
    with pytest.raises(Exception, match="several tasks"):
        good.select("file", "value").repartition(3).write.format("named_files").mode("overwrite").save(str(tmp_path / "twice"))
    assert not [f for f in (tmp_path / "twice").rglob("*") if f.is_file()]


def test_predictions_format_agrees_and_prunes(spark, tmp_path):
    for k in range(4):
        rows = [f"P{i}\t{i / 4}\t{'x' if i % 5 == 0 else i}" if i % 3 else "" for i in range(40 * k)]
        (tmp_path / f"a_chunk_{k}.xls").write_text("\n".join([f"HLA-{k} x", "Peptide\tBA_score\tBA_Rank", *rows]) + "\r\n" * (k % 2))
    (tmp_path / "a_chunk_9.xls").write_text("")
    want = sorted(tuple(r) for r in readers.read_predictions(spark, str(tmp_path)).collect())
    for split in (1 << 20, 64, 7):
        got = readers.load_predictions(spark, str(tmp_path), split=split)
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    raw = spark.read.format("predictions").option("split", 100)
    every, some = raw.load(str(tmp_path / "*.xls")), raw.option("pathGlobFilter", "a_chunk_[12].xls").load(str(tmp_path))
    assert 1 < some.rdd.getNumPartitions() < every.rdd.getNumPartitions()
    one = every.filter("source_file = 'a_chunk_1.xls' AND BA_score > 1").count()
    assert one == sum(1 for i in range(40) if i % 3 and i > 4) and every.count() == len(want)
    (tmp_path / "a_chunk_3.xls").unlink()  # a file that isn't chosen isn't opened
    assert some.count() == sum(r[0] in ("a_chunk_1.xls", "a_chunk_2.xls") for r in want)


def test_small_files_share_partitions(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"a_chunk_{k}.xls").write_text(f"HLA-{k}\nPeptide\tBA_score\tBA_Rank\n" + "".join(f"P{i}\t{i}\t{k}\n" for i in range(k % 7)))
    raw = spark.read.format("predictions").option("split", 4096).load(str(tmp_path))
    assert 1 < raw.rdd.getNumPartitions() < 10
    for split in (64, 4096):
        got = readers.load_predictions(spark, str(tmp_path), split=split)
        assert sorted((r.chunk, r.row_no, r.Peptide) for r in got.collect()) == sorted((k, i, f"P{i}") for k in range(300) for i in range(k % 7))
    monkeypatch.setattr(formats, "MOST_PARTITIONS", 5)
    reader = formats.PredictionReader({"path": str(tmp_path), "split": "64"}, raw.schema)
    parts = reader.partitions()
    assert len(parts) <= 6 and max(r.end - r.start for p in parts for r in p.ranges) <= 64


def test_files_of_many_batches_are_paired_at_once(spark, tmp_path, monkeypatch):
    """Also when a run breaks off after its note, or between micro-batches and pairing, and goes on in the next."""
    xls, out, state = tmp_path / "xls", str(tmp_path / "out"), str(tmp_path / "state")
    xls.mkdir()
    headers = spark.createDataFrame([("f", c, r, ("VIRAL", "HUMAN")[r], "p_0") for c in range(6) for r in range(2)], "file string, chunk long, row_no int, type string, pair_id string")

    def add(*chunks):
        for c in chunks:
            (xls / f"x_chunk_{c}_A.xls").write_text(f"HLA-{c}\nPeptide\tBA_score\tBA_Rank\nP{c}\t1\t2\nQ{c}\t1\t2\n" + "R\t1\t2\n" * (c == 1))

    def run():
        ingest.aggregate_stream(spark, str(xls), headers, out, state, files_per_batch=1)

    add(0, 1, 2)
    with monkeypatch.context() as m:
        real = ingest.list_folder
        m.setattr(ingest, "delete_folder", lambda *a: (_ for _ in ()).throw(OSError("broken")))
        with pytest.raises(OSError):
            run()
        assert real(spark, f"{state}/generation=0/landed")
    add(3, 4)
    run()
    assert sorted(r.Allele for r in ingest.read_results(spark, out).collect()) == ["HLA-0", "HLA-2", "HLA-3", "HLA-4"]
    assert sorted(n for n in real(spark, f"{out}/generation=0") if n.startswith("batch=")) == ["batch=-1", "batch=0", "batch=3"]
    with monkeypatch.context() as m:
        m.setattr(ingest, "_numbers", lambda *a: (_ for _ in ()).throw(OSError("broken")))
        add(5)
        with pytest.raises(OSError):
            run()
    run()
    assert sorted(r.Allele for r in ingest.read_results(spark, out).collect()) == ["HLA-0", "HLA-2", "HLA-3", "HLA-4", "HLA-5"]


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_listed_prediction_files_are_read_as_lines_are(spark, tmp_path, split):
    for k in range(40):
        names = ["Pos", "Peptide", "BA_score", "BA_Rank"][k % 2 :: 1 + k % 3 // 2] if k % 5 else ["BA_Rank", " Peptide ", "Peptide"]
        body = [["1\tP1\t0.5\t2", "", "  ", "\t", "é\tQ\r", "x\t y \t 1e1 \t1.0d"][(k + i) % 6] for i in range(k % 9)]
        (tmp_path / f"a_chunk_{k % 7}_{k}.xls").write_bytes(("\n".join([["HLA-A more", "", " \r"][k % 3], "\t".join(names), *body]) + "\n" * (k % 2)).encode())
    (tmp_path / "empty_chunk_1.xls").write_text("")
    (tmp_path / "one_chunk_1.xls").write_text("HLA-B")
    with gzip.open(tmp_path / "packed_chunk_2.xls.gz", "wt") as f:
        f.write("HLA-Z\nPeptide\tBA_score\n" + "PP\t1\n" * 30)
    listed = spark.createDataFrame([(str(f), f.name, f.stat().st_size) for f in tmp_path.iterdir()], "path string, file string, size long")
    got, want = readers.read_prediction_files(listed, split=split), readers.read_predictions(spark, str(tmp_path))
    assert got.schema.names == want.schema.names
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100


def test_micro_batches_cost_names_only(spark, tmp_path):
    """Each batch read its files by Spark's text scan, after a task for each of them that looked it up."""
    xls, state = tmp_path / "xls", tmp_path / "state"
    rows = spark.range(120).select(F.format_string("x_chunk_%d_A.xls", F.col("id")).alias("file"), F.lit(0).alias("at"), F.lit("HLA-A\nPeptide\tBA_score\tBA_Rank\nP\t1\t2\nQ\t1\t2").alias("value"))
    writers.write_named_files(rows.repartition(3, "file").sortWithinPartitions("file"), str(xls), dealt=True)
    headers = spark.range(120).select(F.lit("f").alias("file"), F.col("id").alias("chunk"), F.explode(F.expr("array(0, 1)")).alias("row_no")).withColumns({"type": F.when(F.col("row_no") == 0, "VIRAL").otherwise("HUMAN"), "pair_id": F.lit("p")})
    key, landed, look = "spark.sql.sources.parallelPartitionDiscovery.parallelism", [], spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    real = ingest._pair_landed

    def pair(spark, headers, out, state):
        landed.extend(sorted(spark.read.parquet(f"{state}/landed").columns))
        real(spark, headers, out, state)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ingest, "_pair_landed", pair)
        ran = ingest.aggregate_stream(spark, str(xls), headers, str(tmp_path / "out"), str(state), files_per_batch=50)
    assert landed == ["batch", "file", "path", "size"] and spark.conf.get(key) == look
    assert [p["numInputRows"] for p in ran.recentProgress if p["numInputRows"]] == [50, 50, 20]  # a row a file
    assert ingest.read_results(spark, str(tmp_path / "out")).count() == 120
