"""Collocations, contamination, the filter audit and the sieve against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinmer.llm import collocations, decontaminate, filter_audit, sieve

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n long, w1 string, part string, mask int, digest string, term string"
#: Null and empty texts, a null language and id, repeated rows, a very long text, letters beyond ASCII.
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "Red fox runs. red FOX runs, red fox sits", "en"),
    (4, "Red fox runs. red FOX runs, red fox sits", "en"), (None, "red fox runs", None), (5, "red fox " * 20_000, "fr"), (6, "É é ünï x漢字! é ünï", "de"),
    (7, "z" * 50_000, "de"), (8, "red fox runs", "en"), (9, "red fox runs", "en"), (10, "<a> & $5 | ABC", ""),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, 7, "own", "p", 3, "d", "t") for i, t, l in rows], SCHEMA)


def random_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd", "É", "x1", "the", "of"]
    ends = [" ", " ", " ", "\t", ". ", ",", "\n", "-", " \x0b"]
    return [(k, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(80))), rng.choice(["en", "de", None])) for k in range(n)]


# 11: collocations


def phrases_of(docs, longest, least, top, covered):
    f = defaultdict(Counter)
    for _, text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                f[lang or ("und" if lang is None else "")].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest, least, top, chunk, group", [(3, 3, 2000, 1 << 24, 1 << 23), (2, 2, 5, 300, 20_000), (4, 2, 50, 1, 50_000)])
def test_collocations(spark, longest, least, top, chunk, group):
    docs = random_docs(longest) + ODD
    got = collocations.collocations(frame(spark, docs).repartition(3), longest, least, top, 50, chunk=chunk, group=group)
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(docs, longest, least, top, 50)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, ODD).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, ". , ", "en")])).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_001, 3_000_000_000_007, 9_000_000_000_011
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r")))
    assert row.first()[0] == 1_000_000 * a * a // (l * r)


# 12: contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(docs, items, window=10):
    asked = set()
    for i, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        asked |= {("" if i is None else str(i), tuple(w[k : k + window])) for k in range(max(len(w) - window + 1, 1)) if w}
    out = []
    for i, text, *_ in docs:
        w = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for item, p in asked:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, block", [(3, 12 << 20), (2, 200), (10, 1)])
def test_contamination(spark, window, block):
    rng = random.Random(window)
    docs = random_docs(window) + ODD[:6] + ODD[7:]
    words = ["a", "b", "c", "dd", "É", "x1", "the", "of"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(30)] + [(40, None), (41, ""), (None, "A-b c"), (42, "RED fox"), (42, "red fox runs red"), (43, "nowhere seen"), (44, "a a a a")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, block int")
    got = decontaminate.contamination(frame(spark, docs).repartition(3), table, window, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == contaminated(docs, items, window)


def test_contamination_of_nothing_and_by_nothing(spark):
    docs, items = frame(spark, ODD), spark.createDataFrame([(1, "red fox runs")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.contaminated for r in none)
    long = decontaminate.contamination(frame(spark, ODD[6:7]), spark.createDataFrame([(1, "fox red")], "item_id long, text string")).first()
    assert (long.n_words, long.n_hit) == (40_000, 39_998)


def test_matches_and_proximity(spark):
    docs = [(1, "one two three. Four five", "en"), (2, "two x one", "en"), (3, "one", "en"), (4, "three", "en"), (5, "one two two one", "en")]
    phrases = spark.createDataFrame([("p", ["one", "two"]), ("q", ["two", "three"])], "item string, terms array<string>")
    index = decontaminate.Index.build(frame(spark, docs).coalesce(1))
    exact = sorted(tuple(r) for r in decontaminate.matches(index, phrases).collect())
    assert exact == [(1, "p", 0, 2), (1, "q", 1, 2), (5, "p", 0, 2)]
    near = {(r.doc_id, r.item) for r in decontaminate.matches(index, phrases, within=2).collect()}
    assert near == {(1, "p"), (1, "q"), (2, "p"), (5, "p")}
    assert {(r.doc_id, r.item) for r in decontaminate.matches(index, phrases, within=1).collect()} == {(1, "p"), (1, "q"), (5, "p")}
    kept = decontaminate.is_clean(frame(spark, docs), decontaminate.hits(index, phrases))
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4}
    index.delete()


# 13: the filter audit


def audited(docs, labels):
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        own = {f for f, x in zip("ABCDE", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), copy]) if x}
        fails.append((lang or "", own, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out, shapley = [], Counter()
    for part in {p for p, *_ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                of = [x for x in fails if x[0] == part and f in x[1]]
                shapley[part, f] += len(removed)
                out.append((part, "".join(order), k + 1, len(left), len(removed), len(of) - len(removed), sum(x[1] == {f} for x in of), sum(x[2] for x in removed), sum(x[3] for x in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    rng = random.Random(3)
    docs = random_docs(3, 40) + ODD
    docs += [(100 + k, rng.choice(docs)[1], rng.choice(["en", "de", "fr"])) for k in range(30)]
    docs += [(200 + k, " ".join(f"w{rng.randrange(400)}" for _ in range(150)), "en") for k in range(20)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 220, 3), 4, 4]] + [(None, 1, 1)]
    got = filter_audit.audit(frame(spark, docs).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, ODD).limit(0), labels).count() == 0
    assert filter_audit.audit(frame(spark, ODD[:1]), labels).count() == 600


def test_copies_moves_texts_that_repeat_only(spark):
    docs = frame(spark, [(k, f"text {k % 900}", "en") for k in range(1000)])
    got = filter_audit.copies(docs)
    assert {r.doc_id for r in got.collect()} == set(range(900, 1000))


# The sieve


@pytest.mark.parametrize("most", [sieve.MOST_BITMAPS, 1])
def test_sieve_loses_no_key_and_splits_the_rows(spark, most):
    keys = spark.range(0, 60_000, 3).select(F.col("id").alias("key"))
    found = sieve.build_sieve(keys, most)
    rows = spark.range(90_000).select("id", F.lit("x").alias("bits"), F.lit(1).alias("bitmap"))
    passed, failed = ({r.id for r in part.collect()} for part in (found.passing(rows, F.col("id")), found.failing(rows, F.col("id"))))
    assert not passed & failed and len(passed) + len(failed) == 90_000
    wanted = set(range(0, 60_000, 3))
    assert wanted <= passed
    assert len(passed - wanted) < (0.01 if most > 1 else 0.6) * 70_000


def test_sieve_of_nothing(spark):
    found = sieve.build_sieve(spark.range(0).select("id"))
    assert found.passing(spark.range(10), F.col("id")).count() == 0
    assert found.failing(spark.range(10), F.col("id")).count() == 10


@pytest.mark.parametrize("few", [0, sieve.FEW])
def test_joins_by_a_sieve(spark, few):
    rows = spark.createDataFrame([(k % 50 if k % 7 else None, str(k % 3), k) for k in range(400)], "a long, b string, v int").repartition(3)
    keys = spark.createDataFrame([(k, "1", -k) for k in range(0, 50, 2)], "a long, b string, w int")
    want = {(a, b, v) for a, b, v in (tuple(r) for r in rows.collect()) if a is not None and a % 2 == 0 and b == "1"}
    assert {(r.a, r.b, r.v) for r in sieve.matching(rows, keys, ["a", "b"], few).collect()} == want
    assert {tuple(r) for r in sieve.others(rows, keys, ["a", "b"], few).collect()} == {tuple(r) for r in rows.collect()} - want


# Groups of candidates, bounded by bytes


def test_groups_of_few_long_members_are_dealt_out(spark, monkeypatch):
    """Sixty texts of some hundred shingles each, where a part holds no more than five of them: the same components."""
    from kinmer.llm import groups, simhash

    rng = random.Random(21)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(4)]
    docs = []
    for k in range(60):
        words = list(base[k % 4])
        words[rng.randrange(150)] = f"x{k}"
        docs.append((k, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.similar_components(table).collect()}
    assert {k: k % 4 for k in range(60)} == want
    monkeypatch.setattr(groups, "BLOCK_BYTES", 5 * 8 * 150)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 5 * 8 * 150)
    assert {r.doc_id: r.component_id for r in simhash.similar_components(table).collect()} == want
