"""Boundary rows of the operators, stated by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from kinmer.functions import names
from kinmer.functions import sequences as fs
from kinmer.operators import alleles, binding, casecontrol, common, epitopes, hits, inventory, ld, predictions, segments, selection, sequences, summaries
from kinmer.schemas import HITS, WIDE


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    "rank_v, rank_h, score_v, score_h, a, b, c",
    [
        (2.0, 5.0, 0.75, 0.25, "Human_dominant", "Equivalent_binding", "Non_binder"),
        (2.0, 2.0, 0.25, 0.75, "Viral_dominant", "Equivalent_binding", "Equivalent_binding"),
        (1.0, 1.0, 0.875, 0.25, "Human_dominant", "Human_dominant", "Human_dominant"),
        (2.01, 0.1, 0.9, 0.1, "Non_binder", "Non_binder", "Non_binder"),
        (None, 1.0, 0.5, 0.5, "Non_binder", "Non_binder", "Non_binder"),
        (1.0, 1.0, math.nan, 0.5, "Non_binder", "Non_binder", "Non_binder"),
    ],
)
def test_binding_class(spark, rank_v, rank_h, score_v, score_h, a, b, c):
    df = spark.createDataFrame([(rank_v, rank_h, score_v, score_h)], "BA_Rank_viral double, BA_Rank_human double, BA_score_viral double, BA_score_human double")
    got = df.select(binding.binding_class(), binding.binding_class(edge="equivalent"), binding.binding_class("both", "equivalent")).first()
    assert tuple(got) == (a, b, c)


def _annotated(spark, told):
    return spark.createDataFrame(
        [(p, "V", "H", "pv", "ph", a, c) for p, a, c in told],
        "pair_id string, uniprot_viral string, uniprot_human string, peptide_viral string, peptide_human string, allele string, Binding_Class string",
    )


def test_pair_summary(spark):
    told = [("p", "a1", "Human_dominant"), ("p", "a2", "Viral_dominant"), ("p", "a3", "Equivalent_binding"), ("p", "a4", "Non_binder"), ("p", "a1", "Equivalent_binding"), ("q", "a1", "Non_binder"), ("r", "a1", None)]
    got = {r.pair_id: r for r in summaries.pair_summary(_annotated(spark, told)).collect()}
    assert set(got) == {"p", "q"}
    p, q = got["p"], got["q"]
    assert (p.Human_dominant, p.Viral_dominant, p.Equivalent_binding, p.n_alleles_tested) == (1, 1, 2, 4)
    assert (p.Human_dominant_fraction, p.Viral_dominant_fraction, p.Equivalent_binding_fraction) == (0.25, 0.25, 0.5)
    parts = summaries.with_fractions(summaries.pivot_classes(summaries.class_counts(_annotated(spark, told))).join(summaries.pair_metadata(_annotated(spark, told)), "pair_id"))
    assert {tuple(r[c] for c in parts.columns) for r in got.values()} == {tuple(r) for r in parts.collect()}
    assert (q.n_alleles_tested, q.Human_dominant_fraction, q.Viral_dominant_fraction, q.Equivalent_binding_fraction) == (0, 0, 0, 0)


def test_fractions_of_a_known_pair(spark):
    df = spark.createDataFrame([("p", 744, 105, 95)], "pair_id string, Human_dominant long, Viral_dominant long, Equivalent_binding long")
    r = summaries.with_fractions(df).first()
    assert r.n_alleles_tested == 944
    assert (r.Human_dominant_fraction, r.Viral_dominant_fraction, r.Equivalent_binding_fraction) == (0.788135593220339, 0.11122881355932203, 0.10063559322033898)
    assert summaries.with_bias(summaries.with_fractions(df)).select(summaries.pair_category()).first()[0] == "Human_dominant"


def test_kmers(spark):
    proteins = spark.createDataFrame([("a", "acdXefg"), ("b", "AC"), ("c", None), ("d", "")], "acc string, seq string")
    assert rows(sequences.kmer_rows(proteins, 3), "acc", "pos0", "kmer") == [("a", 0, "ACD"), ("a", 4, "EFG")]
    long = "ACDEFGHIKL" * 100
    got = sequences.kmer_rows(spark.createDataFrame([("x", long)], "acc string, seq string"), 8).collect()
    assert {(r.pos0, r.kmer) for r in got} == {(i, long[i : i + 8]) for i in range(len(long) - 7)} and len(got) == len(long) - 7
    assert one(spark, fs.kmers(F.lit("ABCD"), 3)) == [(0, "ABC"), (1, "BCD")]
    assert one(spark, fs.kmers(F.lit("AB"), 3)) == []


def test_jaccard_and_alignment(spark):
    assert one(spark, fs.jaccard(F.lit("ABCD"), F.lit("BCDE"))) == pytest.approx(1 / 3)
    assert one(spark, fs.jaccard(F.lit("AB"), F.lit("CD"))) == 0
    match = {(c, c): 1.0 for c in "ACDE"} | {("A", "C"): -1.0, ("C", "A"): -1.0}
    score = fs.alignment_score(match)
    df = spark.createDataFrame([("ACDE", "ACDE"), ("ADE", "ACDE"), ("A", "C"), ("", ""), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(score("a", "b")).collect()] == [1.0, 0.75, 0.0, 0.0, None]


def test_ranges_and_headers(spark):
    cut = [one(spark, fs.cut_range(F.lit("ABCDE"), F.lit(s), F.lit(e))) for s, e in ((1, 5), (2, 3), (0, 2), (4, 6), (3, 2))]
    assert cut == ["ABCDE", "BC", None, None, None]
    assert one(spark, fs.accession(F.lit("sp|P1|N"))) == "P1" and one(spark, fs.accession(F.lit("P2"))) == "P2"
    assert tuple(one(spark, fs.pair_header(F.lit("VIRAL_7_3_P1")))) == ("VIRAL", "7_3", "P1")
    assert one(spark, fs.pair_header(F.lit("VIRAL_7_3"))) is None
    assert one(spark, fs.segment_id(F.lit("7"), F.lit("P1"), F.lit(1), F.lit(9), F.lit(81.256))) == "7|HUMAN_P1|1-9|sim=81.26"


def test_names(spark):
    a = F.lit("hla_b*07:02")
    assert one(spark, names.hla_letter(a)) == "B" and one(spark, names.hla_letter(a, upper=False)) == "b"
    assert one(spark, names.hla_letter(a, default=None, strict=True)) is None
    assert one(spark, names.hla_letter(F.lit("HLA-G*01"), "ABCDEFG")) == "G" and one(spark, names.hla_letter(F.lit("HLA-G*01"))) == "Unknown"
    assert one(spark, names.safe_allele(a)) == "hla_b_07_02" and one(spark, names.safe_allele(a, colon=False)) == "hla_b_07:02"
    assert [one(spark, names.allele_group(F.lit(x))) for x in ("HLA-A01", "HLA-B", "HLA-E")] == ["HLA-A", "HLA-B", "HLA-others"]
    assert tuple(one(spark, names.parse_variant(F.lit("1:20:A:C")))) == ("1", 20, "A", "C")
    assert tuple(one(spark, names.parse_variant(F.lit("1:x")))) == ("1", None, None, None)
    assert one(spark, names.chunk_no(F.lit("a_chunk_12_chunk_3.xls"))) == 12 and one(spark, names.chunk_no(F.lit("a"))) is None
    assert one(spark, names.join_sorted(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "a|b"
    assert one(spark, names.join_sorted(F.array(F.lit("b"), F.lit("a"), F.lit("b")), False)) == "a|b|b"
    assert one(spark, names.join_sorted(F.lit(None).cast("array<string>"))) == ""
    got = one(spark, names.parse_list_name(F.lit("t1d_p0.01.txt")))
    assert (got.trait, got.threshold) == ("t1d", 0.01)


def test_similarity_filter(spark):
    def hit(q, s, pident, length):
        return (q, s, float(pident), length, 0, 0, 100, 100, 1, 9, 1, 9, 0.0, 1.0)

    df = spark.createDataFrame([hit("a", "sp|P1|x", 100, 75), hit("b", "sp|P2|x", 95, 100), hit("c", "P3", 95.01, 100), hit("d", "sp|P4|x", 74.99, 100), hit("e", "plain", 80, 100), hit("f", "sp|OLD|x", 80, 100)], HITS)
    retired = spark.createDataFrame([("OLD",), ("OLD",)], "id string")
    kept = hits.drop_retired(hits.filter_similarity(hits.with_similarity(df)), retired)
    assert [r.qseqid for r in kept.orderBy("qseqid").collect()] == ["a", "b", "e"]


def test_positional_pairs(spark):
    df = spark.createDataFrame(
        [("p", 1, 5, 1, "ACDEF", "ACDGF"), ("r", 9, 5, 1, "ACDEF", "ACDGFACDGF"), ("s", 1, 2, 1, "ACDEF", "ACDGF"), ("t", 1, 4, 2, "XACDEF", "acdg")],
        "qseqid string, sstart int, send int, qstart int, seq_viral string, seq_human string",
    )
    pairs = hits.positional_pairs(df, 3)
    assert pairs.agg(hits.identical()).first()[0] == 1
    assert rows(hits.drop_identical(pairs).filter("qseqid = 'p'"), "i", "peptide_viral", "peptide_human") == [(2, "CDE", "CDG"), (3, "DEF", "DGF")]
    assert {r.qseqid for r in pairs.collect()} == {"p", "t"}
    moved = hits.positional_pairs(df.filter("qseqid = 't'"), 3, align_query=True)
    assert rows(moved, "peptide_viral", "peptide_human")[0] == ("ACD", "ACD")


def test_cut_and_resolve(spark):
    meta = spark.createDataFrame([(1, "P", 1, 3), (2, "P", 4, 9), (3, "Q", 1, 2)], "pep_id long, UniProt_acc string, start int, end int")
    proteins = spark.createDataFrame([("P", "ACDEF")], "acc string, seq string")
    found, failed = hits.cut_peptides(meta, proteins)
    assert rows(found, "pep_id", "peptide") == [(1, "ACD")]
    assert rows(failed, "pep_id", "reason") == [(2, "Out of bounds"), (3, "Sequence not found")]
    mapping = spark.createDataFrame([("Q", "Z")], "Original_ID string, Mapped_ID string")
    assert rows(hits.resolve_ids(meta, mapping), "pep_id", "resolved") == [(1, "P"), (2, "P"), (3, "Z")]


def test_pair_predictions(spark):
    told = [("f1", "A", "1_1", "VIRAL", "x"), ("f1", "A", "1_1", "HUMAN", "y"), ("f1", "A", "1_1", "HUMAN", "z"), ("f2", "A", "1_1", "HUMAN", "w"), ("f1", "A", "2_1", "VIRAL", "x"), ("f1", "A", "3_1", "VIRAL", "s"), ("f1", "A", "3_1", "HUMAN", "s")]
    df = spark.createDataFrame(told, "source_file string, Allele string, pair_id string, type string, Peptide string")
    pairs = predictions.drop_identical_peptides(predictions.pair_predictions(df))
    assert rows(pairs, "source_file", "pair_id", "Peptide_viral", "Peptide_human") == [("f1", "1_1", "x", "y"), ("f1", "1_1", "x", "z")]


def test_confirmed_hits_and_nulls(spark):
    told = [("1", "p", 1, 3.51, 1), ("1", "p", 2, 9.0, 1), ("2", "p", 1, 3.5, 0), ("2", "p", 2, 9.0, 0), ("1", "q", 1, None, 1), ("1", "q", 2, 9.0, 1), ("2", "q", 1, 9.0, 0), ("2", "q", 2, 9.0, 0), ("1", "r", 1, 1.0, 1), ("1", "r", 2, 1.0, 1)]
    assay = spark.createDataFrame(told, "id1 string, pep_id string, repnum int, zscore double, casestat int")
    kept = casecontrol.confirmed_once(casecontrol.confirm_hits(assay))
    assert rows(kept, "id1", "pep_id", "hit_both") == [("1", "p", 1), ("2", "p", 0)]
    t = casecontrol.case_control_table(kept).first()
    assert (t.Prop_cases, t.Prop_controls, t.cases_with, t.controls_with) == (1.0, 0.0, 30, 0)


def test_fisher(spark):
    assert casecontrol.fisher_p([(3, 27), (0, 30)]) == pytest.approx(14 / 59)
    assert casecontrol.fisher_p([(15, 15), (15, 15)]) == pytest.approx(1)
    assert casecontrol.fisher_p([(3, 27), (9, 21)]) == pytest.approx(casecontrol.fisher_p([(9, 21), (3, 27)]))
    assert casecontrol.fisher_p([(0, 0), (3, 27), (0, 30)]) == pytest.approx(casecontrol.fisher_p([(3, 27), (0, 30)]))
    counts = spark.createDataFrame([("a", 0.0, 0.1, 3, 27, 0, 30), ("b", None, 0.1, 3, 27, None, None)], "pep_id string, Prop_controls double, Prop_cases double, cases_with int, cases_without int, controls_with int, controls_without int")
    for mode in ("2x2", "compat"):
        got = {r.pep_id: r.p_value for r in casecontrol.fisher_exact(counts, mode).collect()}
        assert got["a"] == pytest.approx(14 / 59) and got["b"] is None


def test_epitopes(spark):
    df = spark.createDataFrame(
        [(1, "A" * 7, ["v"]), (2, "A" * 8, ["v", epitopes.HUMAN]), (3, "A" * 14, [epitopes.HUMAN]), (4, "A" * 14, []), (5, "A" * 15, ["v"]), (6, "A" * 14, None), (7, "A" * 14, ["v"]), (8, None, ["v"])],
        "structure_id long, linear_sequence string, parent_source_antigen_source_org_iris array<string>",
    )
    assert rows(epitopes.foreign_source(epitopes.filter_length(df, 8, 14)), "structure_id") == [(2,), (7,)]
    linked = spark.createDataFrame([(1, "S", "A", [1, 2, 1], "e")], "structure_id long, linear_sequence string, alleles string, receptor_ids array<long>, note string")
    receptors = spark.createDataFrame([(1, "r"), (2, "r")], "receptor_id long, note string")
    pairs = epitopes.epitope_receptor(linked, receptors)
    assert rows(pairs, "receptor_id", "note_epitope", "note_receptor") == [(1, "e", "r"), (1, "e", "r"), (2, "e", "r")]
    assert rows(epitopes.unique_pairs(pairs), "receptor_id") == [(1,), (2,)]


def test_ld(spark):
    index = spark.createDataFrame([("1", 10, "A", "C", 1), ("1", 20, "A", "C", 2)], "chr string, pos long, ref string, alt string, idx long")
    asked = spark.createDataFrame([("1:10:A:C", 0), ("1:99:A:C", 1), ("1:20:A:C", 2)], "variant string, input_pos long")
    triples = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 3, 0.1)], "i long, j long, r double")
    matched, seen = ld.match_variants(asked, index)
    assert matched.count() == 3 and ld.require_match(seen) == {"matched": 2, "total": 3}
    cells = ld.complete_symmetric(ld.subset_ld(triples, matched), matched)
    assert rows(cells, "i", "j", "r", "r2") == [(1, 1, 1.0, 1.0), (1, 2, 0.5, 0.25), (2, 1, 0.5, 0.25), (2, 2, 1.0, 1.0)]
    dense = ld.dense_matrix(cells, matched)
    assert [tuple(r) for r in dense.collect()] == [("1:10:A:C", 1.0, 0.5), ("1:20:A:C", 0.5, 1.0)]
    none, seen = ld.match_variants(asked.filter("input_pos = 1"), index)
    none.count()
    with pytest.raises(ValueError):
        ld.require_match(seen)


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.01), ("c", 0.0500001)], "variant string, pval double")
    got = ld.threshold_variants(df, mode="p").groupBy("variant").count()
    assert rows(got, "variant", "count") == [("a", 4), ("b", 2)]
    logs = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("n", None)], "variant string, neglog10_pval_EUR double")
    assert rows(ld.threshold_variants(logs).groupBy("variant").count(), "variant", "count") == [("a", 4), ("b", 2)]


def test_chunks_and_orders(spark):
    df = spark.createDataFrame([(f"HLA-A{k:03d}",) for k in range(61)] + [("HLA-E1",)], "name string")
    counts = alleles.allele_chunks(df).groupBy("allele_group", "chunk_name").count()
    assert rows(counts, "allele_group", "chunk_name", "count") == [("HLA-A", "000", 30), ("HLA-A", "001", 30), ("HLA-A", "002", 1), ("HLA-others", "000", 1)]
    numbered = common.number_rows(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"])
    assert all(r.k == r.row_no for r in numbered.collect())


def test_row_numbers_of_many_uneven_rows(spark, tmp_path):
    """Over a million rows of uneven width, written and read back: each number once, in order."""
    df = spark.range(1_500_000).select((F.col("id") * 7919 % 1_500_007).alias("k"), F.expr("repeat('x', cast(pow(id % 50, 2) AS int) % 200)").alias("pad"), F.lit(0).alias("at"), F.lit(0).alias("part"))
    common.number_rows(df, ["k"]).write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    assert tuple(read.agg(F.count(F.lit(1)), F.count_distinct("row_no"), F.min("row_no"), F.max("row_no")).first()) == (1_500_000, 1_500_000, 0, 1_499_999)
    after = read.select((F.col("row_no") + 1).alias("row_no"), F.col("k").alias("before"))
    assert read.join(after, "row_no").filter("k <= before").count() == 0 and read.columns == ["k", "pad", "at", "part", "row_no"]


def test_frequent_kmers_and_long_lists(spark, monkeypatch):
    names = [f"AAA{a}{b}" for a in "CDEFG" for b in "HIKLM"] + ["CCCC", "AA"]
    df = spark.createDataFrame([(n,) for n in names], "peptide string")
    want = rows(sequences.shared_kmer_pairs(df), "a", "b", "jaccard")
    monkeypatch.setattr(sequences, "PART", 4)
    assert len(want) == 25 * 24 // 2 + 0 and rows(sequences.shared_kmer_pairs(df), "a", "b", "jaccard") == want
    same = spark.createDataFrame([(k, "S") for k in range(5)], "id int, seq string").withColumn("input_pos", F.col("id"))
    assert rows(sequences.cluster_identical(same, size=2), "block_no", "members", "n") == [(0, [0, 1], 5), (1, [2, 3], 5), (2, [4], 5)]
    index = sequences.kmer_index(same.select(F.col("id").cast("string").alias("acc"), F.lit("ACDEACDE").alias("seq")), 4, size=3)
    assert rows(index.filter("kmer = 'ACDE'"), "block_no", "n") == [(0, 3), (1, 3), (2, 3), (3, 1)]
    assert rows(sequences.posting_rows(index).filter("kmer = 'ACDE'"), "acc", "pos0") == [(str(k), p) for k in range(5) for p in (0, 4)]


def test_mean_alignment(spark):
    score = fs.BLOSUM62
    assert len(score) == 400 and all(score[a, b] == score[b, a] for a, b in score) and (score["W", "W"], score["A", "A"], score["D", "E"], score["C", "W"]) == (11, 4, 2, -2)

    def best(a, b):
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + score[x, y])
        return table[-1][-1] / max(len(a), len(b))

    names = ["ACDEFGHIK", "ACDEFGHIL", "WWWWW", "MKTAYIAKQR", "VVVV", "ACD", "PQRSTVWYA"]
    df = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "peptide string")
    pairs = [best(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    for block in (2, 100):
        assert tuple(sequences.mean_alignment(df, block=block).first()) == (len(pairs), pytest.approx(sum(pairs) / len(pairs)))
    assert tuple(sequences.mean_alignment(df.limit(0)).first()) == (0, None)
    both = spark.createDataFrame([("ACD", "ACE"), (None, "A"), ("", "")], "a string, b string")
    assert [r.s for r in both.select(fs.alignment_score()(F.col("a"), F.col("b")).alias("s")).collect()] == [pytest.approx(best("ACD", "ACE")), None, 0.0]


def test_hosts_sources_and_labels(spark):
    """Records of assays name the human species by its OBO address."""
    human, other = "http://purl.obolibrary.org/obo/NCBITaxon_9606", "http://purl.obolibrary.org/obo/NCBITaxon_11103"
    df = spark.createDataFrame(
        [(1, "I", "Positive", "Linear peptide", [human], [other]), (2, "I", "Positive", "Linear peptide", [other], [other]), (3, "I", "Positive", "Linear peptide", [human], [human])],
        "structure_id long, mhc_class string, qualitative_measure string, structure_type string, host_organism_iris array<string>, parent_source_antigen_source_org_iris array<string>",
    )
    kept = epitopes.filter_assays(df, "I")
    assert rows(kept, "structure_id") == [(1,), (3,)] and rows(epitopes.foreign_source(kept), "structure_id") == [(1,)]
    points = spark.createDataFrame([(f"a{k}", float(h), float(v)) for k, (h, v) in enumerate([(9, 9), (9, 0), (0, 9), *[(1, 1)] * 17])], "allele string, Human_pct double, Viral_pct double")
    got = {r.allele: r.category for r in summaries.dominance(points).collect()}
    assert [got[f"a{k}"] for k in range(4)] == ["Dual_high", "Human_dominant", "Viral_dominant", "Neutral"]


def test_own_columns_of_any_name_stay(spark):
    """Columns named like helpers, in other case too, come through unchanged."""
    df = spark.createDataFrame([("HLA-A1", 2, 1), ("HLA-A2", 1, 2)], "name string, Chunk int, v int").withColumns({c: F.lit("own") for c in ("row", "rank", "at", "part", "first")})
    for got in (
        alleles.allele_chunks(df), common.top_n_per_group(df, ["name"], ["v"], 1), common.first_per_group(df, ["name"], "v"),
        common.number_rows(df, ["v"]), common.number_global_chunks(df, 1, ["v"], "n"), hits.drop_retired(df.withColumn("retired", F.lit("own")), df.select(F.lit("none").alias("x")), "name"),
    ):
        assert set(df.columns) <= set(got.columns) and rows(got, "name", "v", "row", "rank", "at", "part", "first") == [(f"HLA-A{k}", k, *["own"] * 5) for k in (1, 2)]
    table = spark.createDataFrame([(0.5, 0.25, 15, 15, 8, 22, "own")], "Prop_cases double, Prop_controls double, cases_with int, cases_without int, controls_with int, controls_without int, rounded_cases string")
    assert casecontrol.fisher_exact(table, "compat").first().rounded_cases == "own"


def test_pairs_of_named_peptides(spark):
    found = spark.createDataFrame([("7|P1|1-9", "sp|Q1|N", 1, 4), ("8|P2|1-9", "Q2", 1, 4), ("9|P3|1-9", "Q9", 1, 4)], "qseqid string, sseqid string, sstart int, send int")
    peptides = spark.createDataFrame([("7|P1|1-9", "ACDE"), ("8|P2|1-9", "ACDF")], "id string, seq string")
    proteins = spark.createDataFrame([("Q1", "ACDG"), ("Q2", "ACDH")], "acc string, seq string")
    pairs = hits.positional_pairs(hits.attach_both(found, peptides, proteins), 4)
    assert rows(pairs, "pair_id", "pep", "uniprot_viral", "hu_prot_id", "peptide_human") == [("7_1", "7", "P1", "Q1", "ACDG"), ("8_1", "8", "P2", "Q2", "ACDH")]


def test_quantile_and_histogram(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert selection.quantile(df, "x", 0.95).first()[0] == pytest.approx(8.95)
    assert [r.n for r in common.histogram(df, "x", 3).orderBy("bin").collect()] == [3, 0, 1]
    assert [r.n for r in common.histogram(df.filter("x = 1"), "x", 2).orderBy("bin").collect()] == [1, 0]
    assert common.histogram(df.filter("x > 99"), "x", 2).count() == 0


def test_rows_and_metrics(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("a", 2), (None, 3)], "k string, v int")
    assert rows(common.top_n_per_group(df, ["k"], [F.desc("v")], 1), "v") == [(2,), (3,), (3,)]
    assert [r.v for r in common.top_k(df, "v", 2, "k").collect()] == [3, 3]
    assert rows(common.group_sum(df, ["k"], "v", "s").filter("k = 'a'"), "v", "s") == [(1, 3), (2, 3)]
    assert rows(common.first_per_group(df.filter("k IS NOT NULL"), ["k"], "v"), "k", "v") == [("a", 1), ("b", 3)]
    assert common.union_all(df, df.select("k")).filter("v IS NULL").count() == 4
    assert rows(common.union_distinct(df, df, ["k", "v"], ["v"]).filter("k = 'a'"), "k", "v") == [("a", 1), ("a", 2)]
    kept, seen = common.observed(df.filter("v > 1"), n=F.count(F.lit(1)), keys=F.count("k"))
    assert kept.count() == 3 and seen.get == {"n": 3, "keys": 2}
    assert common.spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows(segments.carry_forward(df.filter("k IS NOT NULL").withColumn("h", F.when(F.col("v") == 1, "x")), "h", ["k"], "v", "last"), "k", "v", "last")[:2] == [("a", 1, "x"), ("a", 2, "x")]


def test_compare_and_completeness(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(common.compare_keys(left, right, "k"), "k", "side") == [(1, "left"), (2, "both"), (3, "right")]
    grid = (spark.createDataFrame([("c1",), ("c2",)], "chunk string"), spark.createDataFrame([("a",), ("b",)], "allele string"))
    assert rows(inventory.work_grid(*grid), "chunk", "allele") == [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b")]
    done = spark.createDataFrame([("c1", "a"), ("c1", "a"), ("c1", "b"), ("zz", "a")], "chunk string, allele string")
    assert rows(inventory.missing_work(*grid, done), "chunk", "allele") == [("c2", "a"), ("c2", "b")]
    assert rows(inventory.completeness(*grid, done), "chunk", "n_done", "percent", "status") == [("c1", 2, 100.0, "complete"), ("c2", 0, 0.0, "none")]


def test_identical_clusters(spark):
    df = spark.createDataFrame([("x", "AA", 2), ("y", "AA", 1), ("z", "CC", 3)], "id string, seq string, input_pos int")
    got = {r.representative: (r.members, r.n) for r in sequences.cluster_identical(df).collect()}
    assert got == {"y": (["y", "x"], 2), "z": (["z"], 1)}
    assert rows(sequences.cluster_rows(df), "representative", "member") == [("y", "x"), ("y", "y"), ("z", "z")]


def test_annotate_accepts_strings_and_missing_values(spark):
    wide = spark.createDataFrame([("1_1", "HLA-A*01:01", "V", "H", "p", "q", "x_chunk_4.xls", 0.9, math.nan, 1.0, None)], WIDE)
    r = binding.annotate(wide).first()
    assert (r.Binding_Class, r.BA_score_human, r.allele_safe, r.chunk_source, r.hla_class) == ("Non_binder", None, "HLA-A_01:01", 4, "A")


def test_empty_tables(spark):
    none = spark.createDataFrame([], WIDE)
    assert summaries.pair_summary(binding.annotate(none)).count() == 0
    assert summaries.dominance(summaries.allele_summary_pct(binding.annotate(none))).count() == 0
    assert sequences.mean_similarity(spark.createDataFrame([], "peptide string")).first().mean_similarity == 0
