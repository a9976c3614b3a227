"""Segmented scans and exact selection against brute force, with small splits and small cells."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmer.operators import segments, selection
from kinmer.sources import readers


def largest_task(spark, job) -> int:
    """The most rows that a task reads from a shuffle while `job` runs."""
    context, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    store, none = context.statusStore(), spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).attemptId() for k in range(found.size())}

    before = stages()
    job()
    context.listenerBus().waitUntilEmpty()
    most = 0
    for stage, attempt in stages().items():
        if stage not in before:
            tasks = store.taskList(stage, attempt, 100_000)
            read = [tasks.apply(k).taskMetrics() for k in range(tasks.size())]
            most = max([most, *(m.get().shuffleReadMetrics().recordsRead() for m in read if m.isDefined())])
    return most


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_predictions_over_many_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(1), []
    for k in range(3):
        names = rng.sample(["Pos", "Peptide", "BA_score", "BA_Rank"], 4)
        lines, n = [f"HLA-{k} more", "\t".join(names)], 0
        for i in range(rng.randrange(30, 90)):
            if rng.random() < 0.2:
                lines.append(rng.choice(["", " ", "\r"]))
                continue
            row = {"Pos": "1", "Peptide": f"P{i}", "BA_score": str(i / 8), "BA_Rank": "x" if i % 9 == 0 else str(i)}
            lines.append("\t".join(row[c] for c in names) + rng.choice(["", "\r"]))
            want.append((f"a_chunk_{k}.xls", k, f"HLA-{k}", n, f"P{i}", i / 8, None if i % 9 == 0 else float(i)))
            n += 1
        (tmp_path / f"a_chunk_{k}.xls").write_text("\n".join(lines) + "\n", newline="")
    read = readers.read_predictions(spark, str(tmp_path))
    assert readers.read_lines(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 3
    assert sorted(tuple(r) for r in read.collect()) == sorted(want)
    assert "Window" not in plan(read) or "windowspecdefinition(file" in plan(read)


def test_clusters_over_many_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(2), []
    for f in range(2):
        lines = []
        for c in range(12):
            members = [f"m{f}_{c}_{i}" for i in range(rng.randrange(1, 30))]
            star = rng.choice([None, *members])
            lines += [f">Cluster {c % 5}", *[f"{i}\t9aa, >{m}... {'*' if m == star else 'at 99%'}" for i, m in enumerate(members)]]
            want += [(f"Cluster {c % 5}", star, m) for m in members if star]
        (tmp_path / f"c{f}.clstr").write_text("\n".join(lines) + "\n")
    got = readers.read_clusters(spark, str(tmp_path))
    assert sorted((r.cluster, r.representative, r.member) for r in got.collect()) == sorted(want)


def test_headers_over_many_splits(spark, tmp_path, small_splits):
    for c in (1, 2):
        (tmp_path / f"matched_pairs_chunk_{c}.fasta").write_text("".join(f">{'VIRAL' if k % 2 == 0 else 'HUMAN'}_p{k // 2}_1_Q{k}\nACDE\n>odd\nA\n" for k in range(70)))
    got = readers.read_pair_headers(spark, str(tmp_path)).collect()
    assert sorted((r.chunk, r.row_no, r.uniprot) for r in got) == sorted((c, k, f"Q{k}") for c in (1, 2) for k in range(70))


def test_running_values_of_batches_and_runs(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.random() < 0.3, rng.choice([None, None, 1, 2])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, flag boolean, v int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [tuple(r) for r in segments.scan_runs(df, ["k"], "place", {"n": "flag"}, {"last": "v"}).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, key, place, n, last = [], object(), 0, 0, None
    for k, flag, v in rows:
        if k != key:
            key, place, n, last = k, 0, 0, None
        last = v if v is not None else last
        want.append((k, flag, v, place, n, last))
        place, n = place + 1, n + flag
    assert got == want


@pytest.mark.parametrize("groups", [["a"], ["a", "b", None], list("abcdefgh")])
def test_carry_forward(spark, groups):
    rng = random.Random(len(groups))
    rows = [(rng.choice(groups), k, rng.choice([None] * 9 + ["x", "y", "z"]), "own") for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, pos long, v string, part string").repartition(5)
    got = {r.pos: r.last for r in segments.carry_forward(df, "v", ["g"], "pos", "last").collect()}
    held, want = {}, {}
    for g, k, v, _ in rows:
        held[g] = v if v is not None else held.get(g)
        want[k] = held[g]
    assert got == want
    assert segments.carry_forward(df.limit(0), "v", ["g"], "pos", "last").count() == 0


@pytest.mark.parametrize("name", ["spread", "ties", "decades", "two", "infinite"])
def test_order_statistics(spark, name):
    rng = np.random.default_rng(5)
    values = {
        "spread": rng.normal(size=30_000), "ties": rng.integers(0, 7, 30_000).astype(float), "decades": 10.0 ** rng.integers(-300, 300, 20_000),
        "two": np.repeat([1.0, 2.0], [29_999, 1]), "infinite": np.concatenate([[np.inf, -np.inf], np.arange(20_000.0)]),
    }[name]
    table = spark.createDataFrame([(float(v),) for v in values], "x double").unionByName(spark.range(50).select(F.lit(None).cast("double").alias("x")))
    ranks = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1})
    got = selection.order_statistics(table, {"x": ranks}, small=500)
    ordered = np.sort(values)
    assert {r: got["x", r] for r in ranks} == {r: ordered[r] for r in ranks}


def test_quantiles_of_other_types_and_of_nothing(spark):
    df = spark.createDataFrame([(k, None) for k in range(1, 11)], "k int, none double").withColumn("d", (F.col("k") * 10).cast("decimal(12,2)"))
    assert selection.exact_quantiles(df, {"k": [0.5, 1.0], "d": [0.25], "none": [0.5]}) == {"k": [5.5, 10.0], "d": [32.5], "none": [None]}
    assert selection.quantile(df, "k", 0.5).first()[0] == 5.5
    assert selection.quantile(df.limit(0), "k", [0.5, 0.9]).first()[0] == [None, None]


def test_no_task_holds_more_than_a_cell(spark):
    million = spark.range(0, 1_000_000, 1, 8).select(F.pmod(F.xxhash64("id"), F.lit(1 << 50)).cast("double").alias("x"))
    table = selection.cut(million)
    found = []
    most = largest_task(spark, lambda: found.append(selection.exact_quantiles(table, {"x": [0.5, 0.95]}, small=20_000)))
    values = np.sort(table.toPandas()["x"].to_numpy())
    assert found[0]["x"] == pytest.approx([np.quantile(values, 0.5), np.quantile(values, 0.95)], rel=1e-15)
    assert 0 < most <= 4 * 20_000  # four ranks, a cell each
