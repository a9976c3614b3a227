"""Operators for corpora against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from oracle import connect, same

from kinmer.llm import bpe, exact_dedup, graph, groups, html_extract, licenses, media, packing, quality, sharding, simhash, url_filter, webp
from kinmer.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
#: Null, empty, blank and very long texts, repeats of rows and texts, and letters beyond ASCII.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "Ünï çödé 漢字 \U0001f600"),
    (7, "word " * 30_000), (8, "x" * 60_000), (9, "A B C D"), (10, "<|endoftext|> is's 12345 The THE"), (None, "no id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """ODD with extra columns whose names operators use themselves."""
    rows = [(i, t, "k", 7, 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, _hash int, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name])


# 1: URL filters


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def judged(url, rules, default="allow"):
    host, path = url_parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


@pytest.mark.parametrize("first_rate, at_once", [(0.5, 1000), (2**-10, 1000), (2**-10, 12)])
def test_url_rules(spark, first_rate, at_once):
    rng = random.Random(1)
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in {(rng.choice(["a.b", "b", "c.a.b", "B.org", "org"]) + rng.choice(["", ".net"]), rng.choice(["/", "/x/", "/x/y", "", "/é"])) for _ in range(60)}]
    rules = [(v, h.lower(), p) for v, h, p in rules]
    hosts, paths = ["a.b", "c.a.b", "z.c.a.b", "B.ORG", "ab", "xa.b", "a.b.net", ""], ["", "/", "/x", "/x/", "/x/y/z?q=/x", "/é#f", "?x", "#", "/X/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "http:/a.b/", "a://b://c/", "http://a.b/\nx"]
    pages = spark.createDataFrame([(k, u, "old", "old") for k, u in enumerate(urls + urls)], "page_id long, url string, host string, rule string")
    rules_df = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = url_filter.UrlRules(rules_df, pages, first_rate=first_rate, rules_at_once=at_once)
    rows = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in got.judge(pages).collect()}
    assert rows == {k: judged(u, rules) for k, u in enumerate(urls + urls)}
    if first_rate == 0.5:
        assert len(got.slices) == 1 and len(got.slices[0][0].levels) > 1
    if at_once == 12:
        assert len(got.slices) > 1


def test_url_rules_without_rows(spark):
    pages, rules = spark.createDataFrame([], "page_id long, url string"), url_filter.rules_table(spark)
    assert url_filter.judge_pages(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert tuple(url_filter.judge_pages(some, rules.limit(0)).first()) == (1, "a.com", "/", None, "allow")


# 2: packing


def check_packing(docs, rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in docs:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()) if len(ids) <= 2048 else None)] += 1
    got = Counter((r.doc_id, r.doc_tokens, r.ids_crc32 if r.doc_tokens <= 2048 else None) for r in rows if r.start == 0)
    assert got == want
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[(r.doc_id, r.doc_tokens)].append((r.start, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    for (_, total), parts in starts.items():
        assert sum(n for _, n in parts) % total == 0
    return 1 - sum(r.length for r in rows) / (2048 * len(sequences))


def test_packing(spark, odd, empty, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert check_packing(corpus, packing.pack_documents(docs).collect()) < 0.03
    check_packing(corpus, packing.pack_documents(docs, docs_per_group=20).collect())
    check_packing(ODD, packing.pack_documents(odd).collect())
    assert packing.pack_documents(empty).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 500)
    bins, offsets = packing.first_fit_decreasing(lengths)
    free, want = [], np.zeros(500, int)
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if k == len(free):
            free.append(2048)
        want[i] = k
        assert offsets[i] == 2048 - free[k]
        free[k] -= lengths[i]
    assert (bins == want).all()


def test_equal_rows_are_packed_in_several_groups(spark):
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("the same text").alias("text")).repartition(3)
    packed = packing.pack_documents(docs)
    sizes = packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000 and len(sizes) == 10 and max(r["count"] for r in sizes) < 2500


# 3: BPE


def test_bpe_is_exact(spark, odd, empty, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    library, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.word_bpe()
    rng = random.Random(3)
    pool = [*"aaabbcd eett'sS hHeE  \n\tİΣσςßéÉü漢字\U0001f60012٣ⅷ́\x1c\x85​!?#\u1c89\ua7cb\u088f", "the", "ing", "<|endoftext|>", "<|startoftext|>", "</w>", "'ll", "aaaaaaa"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + [t for _, t in corpus]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)) and not 0xAC00 <= c < 0xD7A4]
    texts = [f"{a}{m}{b}" for m in marks for a in ("a", "á", "\u1100", "か") for b in ("\u0301", "\u0327", "z")]
    texts += ["".join(rng.choice(marks if rng.random() < 0.7 else "aeouAEOUнИか한") for _ in range(rng.randrange(2, 12))) for _ in range(20_000)]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t
    want = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(odd).collect())) == want
    encoded = bpe.encode_texts(odd)
    assert {r.doc_id: len(r.ids) for r in encoded.collect()}[4] == 4
    assert by_id(bpe.decode_ids(encoded))[4].text == "a</w> b</w> c</w> d</w>"
    assert bpe.round_trip(empty).count() == 0


# 4: sharding


def test_sharding(spark, odd, empty, corpus):
    for rows, n in ((odd, len(ODD)), (spark.createDataFrame(corpus, "doc_id long, text string"), len(corpus)), (spark.range(5000).selectExpr("id doc_id", "cast(id % 7 AS string) text"), 5000)):
        got = sharding.shuffle_into_shards(rows).collect()
        assert len(got) == n
        shards = defaultdict(list)
        for r in got:
            shards[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        sizes = [len(shards.get(s, [])) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    truth = {i: (8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in ODD}
    assert all((r.size, r.text_crc32) == truth[r.doc_id] for r in sharding.shuffle_into_shards(odd).collect())
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_sharding_is_uniform(spark):
    got = sharding.shuffle_into_shards(spark.range(24_000).selectExpr("id doc_id", "'x' text")).collect()
    by_source = np.zeros((24, 24))
    for r in got:
        by_source[r.doc_id // 1000, r.shard] += 1
    chi = ((by_source - 1000 / 24) ** 2 / (1000 / 24)).sum()
    assert 400 < chi < 660  # 529 degrees of freedom
    slots = np.array([r.slot for r in got if r.doc_id < 12_000])
    assert abs(slots.mean() - 499.5) < 12


def test_communication_matrix():
    parts = [5, 0, 17, 1, 100]
    m = sharding.communication_matrix(parts, 24)
    assert m.sum(axis=1).tolist() == parts and set(m.sum(axis=0)) == {5, 6} and (m >= 0).all()
    rng = np.random.default_rng(0)
    draws = [sharding._draw(rng, 2 * 10**9, 46 * 10**9, 480) for _ in range(3000)]
    assert abs(np.mean(draws) - 20) < 0.4 and abs(np.std(draws) - math.sqrt(480 / 24 * 23 / 24)) < 0.3


# 5: quality


def test_quality(spark, odd, empty):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    forest = quality.fit_quality(docs, labels)
    rows = by_id(quality.score_quality(docs, forest))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(truth[i], rows[i].score) for i in truth if rows[i].held_out]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    kept = quality.keep_good(docs, forest)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    scored = quality.score_quality(odd, forest).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(empty, forest).count() == 0
    bounded, _ = quality.training_rows(docs, labels, max_rows=50)
    assert len(bounded) == 50
    none = labels.limit(0)
    assert all(r.score > 0.9999 for r in quality.score_quality(odd, quality.fit_quality(odd, none)).collect())


def plain_statistics(text):
    """The features one by one, as their names say."""
    body = (text or "").encode()
    if not body:
        return [0.0] * len(quality.FEATURES)
    words, letters = body.split(), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    n, share = max(1, len(words)), lambda keep: sum(keep(chr(b)) for b in body) / len(body)
    lines = [x for x in body.split(b"\n") if x.strip()]
    times = Counter(words)
    return [
        math.log(1 + len(body)), math.log(1 + len(words)),
        share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in " \t\n\v\f\r"), share(lambda c: c == "\n"),
        share(lambda c: c >= "\x80"), share(lambda c: "!" <= c <= "~" and c not in letters), share(lambda c: c in ".,;:?'\"-()"),
        share(lambda c: c in "#$%&*@^~_=+"), share(lambda c: c in "|<>{}[]\\/`"), share(lambda c: c == "!"),
        -sum(k / len(body) * math.log2(k / len(body)) for k in Counter(body).values()),
        sum(map(len, words)) / n, len(set(words)) / n, sum(len(w) < 4 for w in words) / n,
        sum(w[-1] < 128 and chr(w[-1]) not in letters for w in words) / n, sum(len(w) == 1 and chr(w[0]) not in letters for w in words) / n,
        sum(w.isupper() for w in words) / n, sum(words[k] == words[k - 1] for k in range(1, len(words))) / n,
        max(times.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + n / max(1, len(lines))),
        math.log(1 + max(map(len, words), default=0)),
    ]


def test_statistics(corpus):
    rng = random.Random(22)
    texts = [t for _, t in ODD] + [t for _, t in corpus[:120]] + ["".join(rng.choices("aB3 \n\t.!#|é漢", k=rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-9), t


def test_boosted_trees_against_brute_force():
    """Every split is the best of all thresholds, every leaf the sum of gradients over that of hessians, tree after tree."""
    rng = np.random.default_rng(23)
    x = rng.integers(0, 12, (240, 4)).astype(float)
    y = ((x[:, 0] > 6) ^ (x[:, 2] > 3) | (rng.random(240) < 0.1)).astype(float)
    forest = quality.fit(x, y, trees=5, depth=2, least=20)
    margin = np.full(240, math.log(y.mean() / (1 - y.mean())))
    for t in range(5):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        score = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
        leaves = {0: np.arange(240)}
        for k in range(3):
            rows = leaves.pop(k)
            gains = []
            for f in range(4):
                for cut in np.unique(x[:, f])[:-1]:
                    low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(low), len(high)) >= 20:
                        gains.append(score(low) + score(high) - score(rows))
            f, cut = forest.feature[t, k], forest.at_most[t, k]
            low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
            if gains and max(gains) > 1e-9:
                assert score(low) + score(high) - score(rows) == pytest.approx(max(gains))
            else:
                assert len(high) == 0
            leaves[2 * k + 1], leaves[2 * k + 2] = low, high
        for k, rows in leaves.items():
            value = 0.1 * grad[rows].sum() / (hess[rows].sum() + 1)
            assert forest.value[t, k] == pytest.approx(value)
            margin[rows] += value
    assert forest.score(x) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit(x, y, trees=60, rate=0.3, least=8)
    def walk(row):
        total = f.bias
        for t in range(len(f.feature)):
            k = 0
            for _ in range(f.depth):
                k = 2 * k + 1 + (row[f.feature[t, k]] > f.at_most[t, k])
            total += f.value[t, k]
        return 1 / (1 + math.exp(-total))
    assert np.allclose(f.score(x), [walk(r) for r in x]) and ((f.score(x) > 0.5) == y).mean() > 0.97


# 6: media


class Coder:
    """Writes VP8L images with any features, to test the decoder."""

    def __init__(self, width, height):
        self.w = webp.BitWriter()
        self.w.put(0x2F, 8), self.w.put(width - 1, 14), self.w.put(height - 1, 14), self.w.put(1, 1), self.w.put(0, 3)

    def code(self, symbols, alphabet):
        symbols = sorted(set(symbols)) or [0]
        if len(symbols) == 1 and symbols[0] < 256:
            self.w.put(1, 1), self.w.put(0, 1), self.w.put(1, 1), self.w.put(symbols[0], 8)
            return {symbols[0]: (0, 0)}
        if len(symbols) == 1:
            symbols = [0, *symbols]
        lengths = [0] * alphabet
        for s, n in zip(symbols, webp.code_lengths([1] * len(symbols))):
            lengths[s] = n
        self.w.put(0, 1), self.w.put(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.w.put(4 if k < 16 else 0, 3)
        self.w.put(0, 1)
        for n in lengths:
            self.w.put(int(f"{n:04b}"[::-1], 2), 4)
        return webp.PrefixCode(lengths).codes

    def pixels(self, items, cache_bits, whole, groups=None):
        """items: ('lit', argb), ('copy', length, distance code) or ('cache', index)."""
        self.w.put(cache_bits > 0, 1)
        if cache_bits:
            self.w.put(cache_bits, 4)
        if whole:
            self.w.put(0, 1)
        green, red, blue, alpha, dist, plan = [], [], [], [], [], []
        for it in items:
            if it[0] == "lit":
                a, r, g, b = it[1] >> 24, it[1] >> 16 & 255, it[1] >> 8 & 255, it[1] & 255
                green.append(g), red.append(r), blue.append(b), alpha.append(a), plan.append([(0, g), (1, r), (2, b), (3, a)])
            elif it[0] == "copy":
                (s, n, x), (d, m, z) = prefix(it[1]), prefix(it[2])
                green.append(256 + s), dist.append(d), plan.append([(0, 256 + s), (None, x, n), (4, d), (None, z, m)])
            else:
                green.append(280 + it[1]), plan.append([(0, 280 + it[1])])
        codes = [self.code(s, n) for s, n in zip((green, red, blue, alpha, dist), (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))]
        for step in itertools.chain(*plan):
            self.w.put(*(step[1:] if step[0] is None else codes[step[0]][step[1]]))

    def file(self):
        body = self.w.bytes()
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def prefix(value):
    """(symbol, extra bits, their value) of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    second = v >> (n - 1) & 1
    return 2 * n + second, n - 1, v & ((1 << (n - 1)) - 1)


def samples(argb):
    return np.array(argb, np.uint32).view(np.uint8).reshape(-1, 4)


def test_webp_back_references_and_cache():
    rng = random.Random(5)
    width, height, bits = 16, 12, 5
    items, out = [], []
    cache = [0] * (1 << bits)
    while len(out) < width * height:
        kind = rng.choice(["lit", "copy", "cache"]) if out else "lit"
        if kind == "lit":
            out.append(rng.choice([0xFF102030, 0x01020304, rng.randrange(1 << 32)]))
            items.append(("lit", out[-1]))
        elif kind == "cache":
            key = rng.randrange(1 << bits)
            items.append(("cache", key))
            out.append(cache[key])
        else:
            n, far = min(rng.randrange(1, 9), width * height - len(out)), rng.randrange(1, len(out) + 1)
            near = [k for k, (x, y) in enumerate(webp.NEAR, 1) if max(1, x + y * width) == far]
            items.append(("copy", n, rng.choice(near) if near and rng.random() < 0.7 else far + 120))
            for _ in range(n):
                out.append(out[-far])
        for p in out[-9:]:
            cache[(webp.CACHE_HASH * p & 0xFFFFFFFF) >> (32 - bits)] = p
    c = Coder(width, height)
    c.w.put(0, 1)
    c.pixels(items, bits, True)
    got = webp.decode(c.file())
    assert (got.reshape(-1, 4) == samples(out)).all()
    assert (webp.decode_many([c.file(), webp.encode(b"x" * 192)])[0] == got[:, :, 1]).all()


def test_webp_transforms():
    rng = np.random.default_rng(6)
    width, height = 13, 9
    image = rng.integers(0, 256, (height, width, 4)).astype(np.int64)  # B, G, R, A
    for mode in range(14):
        left = np.zeros_like(image)
        for y, x in itertools.product(range(height), range(width)):
            if x == 0 or y == 0:
                guess = np.array([0, 0, 0, 255]) if x == y == 0 else image[y, x - 1] if y == 0 else image[y - 1, x]
            else:
                l, t, tl = image[y, x - 1], image[y - 1, x], image[y - 1, x - 1]
                tr = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
                half = lambda a, b: (a + b) // 2
                guess = [
                    np.array([0, 0, 0, 255]), l, t, tr, tl, half(half(l, tr), t), half(l, tl), half(l, t), half(tl, t), half(t, tr),
                    half(half(l, tl), half(t, tr)), l if abs(t - tl).sum() < abs(l - tl).sum() else t, np.clip(l + t - tl, 0, 255),
                    np.clip(half(l, t) + np.fix((half(l, t) - tl) / 2), 0, 255),
                ][mode]
            left[y, x] = (image[y, x] - guess) % 256
        c = Coder(width, height)
        c.w.put(1, 1), c.w.put(0, 2), c.w.put(0, 3)  # predictor, blocks of 4
        c.pixels([("lit", mode << 8)] * (4 * 3), 0, False)
        c.w.put(1, 1), c.w.put(2, 2)  # subtract green
        left[:, :, 0] = (left[:, :, 0] - left[:, :, 1]) % 256
        left[:, :, 2] = (left[:, :, 2] - left[:, :, 1]) % 256
        c.w.put(0, 1)
        c.pixels([("lit", int(p)) for p in left.astype(np.uint8).reshape(-1, 4).copy().view(np.uint32).ravel()], 0, True)
        assert (webp.decode(c.file()) == image).all(), mode


def signed(x):
    return (x + 128) % 256 - 128


def test_webp_cross_colour_and_palette():
    rng = np.random.default_rng(7)
    width, height = 10, 6
    image = rng.integers(0, 256, (height, width, 4)).astype(np.int64)
    table = rng.integers(0, 256, (2, 3, 3))  # green to red, green to blue, red to blue for blocks of 4
    coded = image.copy()
    for y, x in itertools.product(range(height), range(width)):
        gr, gb, rb = (int(signed(v)) for v in table[y // 4, x // 4])
        g, r = int(signed(image[y, x, 1])), int(signed(image[y, x, 2]))
        coded[y, x, 2] = (image[y, x, 2] - (gr * g >> 5)) % 256
        coded[y, x, 0] = (image[y, x, 0] - (gb * g >> 5) - (rb * r >> 5)) % 256
    c = Coder(width, height)
    c.w.put(1, 1), c.w.put(1, 2), c.w.put(0, 3)
    c.pixels([("lit", 0xFF000000 | int(rb) << 16 | int(gb) << 8 | int(gr)) for gr, gb, rb in table.reshape(-1, 3)], 0, False)
    c.w.put(0, 1)
    c.pixels([("lit", int(p)) for p in coded.astype(np.uint8).reshape(-1, 4).copy().view(np.uint32).ravel()], 0, True)
    assert (webp.decode(c.file()) == image).all()
    for n, pack in ((2, 3), (4, 2), (16, 1), (40, 0)):
        colours = rng.integers(0, 256, (n, 4))
        index = rng.integers(0, n, (height, width))
        c = Coder(width, height)
        c.w.put(1, 1), c.w.put(3, 2), c.w.put(n - 1, 8)
        steps = np.diff(colours, axis=0, prepend=np.zeros((1, 4), int)) % 256
        c.pixels([("lit", int(p)) for p in steps.astype(np.uint8).copy().view(np.uint32).ravel()], 0, False)
        c.w.put(0, 1)
        each, per = 8 >> pack, 1 << pack
        rows = [[sum(int(v) << each * k for k, v in enumerate(row[x : x + per])) for x in range(0, width, per)] for row in index]
        c.pixels([("lit", v << 8) for row in rows for v in row], 0, True)
        assert (webp.decode(c.file()) == colours[index]).all(), n


def test_webp_payloads(corpus):
    rng = random.Random(8)
    payloads = [bytes(rng.randrange(256) for _ in range(192 * n)) for n in (1, 2, 3, 40)] + [b" " * 192 * 16385, b"a" * 192 * 2000]
    payloads += [media.payload_of(t)[1] for _, t in corpus]
    for _ in range(40):  # passages that repeat near and far, of few bytes and many
        bits = [bytes(rng.choices(range(rng.choice([1, 2, 5, 200])), k=rng.randrange(1, 400))) for _ in range(6)]
        payloads.append(media.payload_of("")[1] + b"".join(rng.choice(bits) for _ in range(rng.randrange(60))).ljust(192 * 130, b"z")[: 192 * 130])
    files = [webp.encode(p) for p in payloads]
    for p, f, many in zip(payloads, files, webp.decode_many(files)):
        assert many.tobytes()[: len(p)] == p and (len(p) > 10**5 or (webp.samples(f) == many).all())
    kinds = [{"palette": any(t[0] == 3 for t in h.transforms), "copies": h.groups[0][4].bits > 0} for h in (webp._read_header(webp.BitReader(webp._stream(f))) for f in files)]
    assert all(k["palette"] for k in kinds) and 20 < sum(k["copies"] for k in kinds) < len(kinds)
    with pytest.raises(ValueError):
        webp.decode(files[3][:200])
    with pytest.raises(ValueError):
        webp.decode_many([files[3][:200], files[5][:-30]])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF----WEBPVP8 ----")


def test_media_are_smaller_in_any_script():
    rng = random.Random(21)
    for letters, words in (("abcdefghijklmnop", 5), ("абвгдежзиклмнопрст", 6), ([chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600)], 3), ("ابتثجحخدذرزسشصضط", 5)):
        text = " ".join("".join(rng.choices(letters, weights=[1 / (k + 1) for k in range(len(letters))], k=rng.randrange(1, 2 * words))) for _ in range(500))
        n, payload = media.payload_of(text)
        assert len(webp.encode(payload)) < 0.85 * len(payload)
    assert all(len(webp.encode(media.payload_of(t)[1])) < 192 for t in ("", "one word"))


def test_payloads_of_several_images(monkeypatch):
    monkeypatch.setattr(webp, "MAX_PAYLOAD", 192 * 3)
    payload = bytes(range(192)) * 7
    stored = webp.encode(payload)
    parts = webp.split_files(stored)
    assert len(parts) == 3 and b"".join(p.tobytes() for p in webp.decode_many(parts))[: len(payload)] == payload


def test_media_rows(odd, empty):
    rows = media.read_media(media.store_texts(odd)).collect()
    want = Counter()
    for i, t in ODD:
        body = (t or "").encode()
        full = body + b" " * (-len(body) % 192 if body else 192)
        want[(i, len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same_text = [r for r in rows if r.doc_id in (4, 5)]
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in same_text}) == 1
    assert media.read_media(media.store_texts(empty)).count() == 0


# 7: exact de-duplication


@pytest.mark.parametrize("most", [1, exact_dedup.MOST_BITMAPS])
def test_exact_dedup(odd, empty, most):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    rows = exact_dedup.mark_exact_duplicates(odd, most=most).collect()
    want = Counter()
    for i, t in ODD:
        ids = [k for k in groups[t or ""] if k is not None]
        best = max(ids) if ids else None
        want[(i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    assert exact_dedup.mark_exact_duplicates(empty, most=most).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd, most=most)
    assert kept.columns == odd.columns
    assert sorted((r.text or "", r.doc_id or 0, r["_hash"]) for r in kept.collect()) == sorted((t, max((k for k in ids if k is not None), default=0), 7) for t, ids in groups.items())
    least = exact_dedup.mark_exact_duplicates(odd, keep="smallest", most=most)
    assert {r.keep_id for r in least.filter("doc_id = 5").collect()} == {4}


def test_unique_texts_do_not_move(spark):
    """Of 3000 texts, 30 of them twice, those that are grouped by their bytes are the repeated ones and few others."""
    docs = spark.createDataFrame([(k, f"text number {k % 2970}") for k in range(3000)], "doc_id long, text string").repartition(4)
    moved = exact_dedup.repeated_digests(docs, "text").passing(docs, exact_dedup._digest("text"))
    assert {r.doc_id for r in moved.collect()} >= {*range(30), *range(2970, 3000)} and moved.count() < 60 + 90
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert {r.doc_id for r in kept.collect()} == set(range(30, 3000))


def test_exact_dedup_with_columns_of_its_own_names(spark):
    names = ["null", "NULL_", "_null", "_own", "_rank", "_text", "bits", "bitmap", "digest", "group_size", "keep_id"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(["a", "b", "a", None, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert sorted(tuple(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [rows[1], rows[2], rows[4]]
    assert exact_dedup.mark_exact_duplicates(docs).count() == 5


# 8: licences


def test_licences(spark, odd, empty):
    mit = dict(licenses.KNOWN_TEXTS)["MIT"]
    told = {
        1: "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"),
        2: mit.replace("sublicense", "sub-licence").replace('"Software"', "“Software”"),
        3: mit + "\nmore",
        4: "Some words\n  * released under the MIT licence\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        5: "Released under the MIT License.",
        6: None,
        7: "not Released under the MIT License. really",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in told.items()], "doc_id long, text string, license_id string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "CC-BY-NC-4.0,MIT"), 5: ("MIT", "MIT"), 6: (None, ""), 7: (None, "")}
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(empty).count() == 0


def test_licence_files_as_found(spark):
    """Titles and owners' lines of all forms before the text, wrapped in other places; a line of prose that begins with copyright stays."""
    mit, bsd = dict(licenses.KNOWN_TEXTS)["MIT"], dict(licenses.KNOWN_TEXTS)["BSD-3-Clause"]
    heads = [
        "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n", "The MIT License (MIT)\n\nCopyright © 2015-2020 A & B, Inc.\nAll rights reserved.\n\n", "Copyright Jane Doe 2020\n", "Copyright The Go Authors. All rights reserved.\n",
        "Copyright [yyyy] [name]\n", "# MIT Licence\nCopyright <YEAR> <HOLDER>\n\n", "   The MIT License\n\n * Copyright: Some One\n(c) Other\n", "",
    ]
    wrapped = [re.sub(r"\s+", " ", mit), mit.replace(" ", "\n"), re.sub(r"\s+", " ", mit).replace("copyright", "\ncopyright").replace("COPYRIGHT", "\nCOPYRIGHT")]
    docs = [(k, h + wrapped[k % 3]) for k, h in enumerate(heads)] + [(100, "BSD 3-Clause License\n\nCopyright (c) 2019, X\n\n" + bsd.replace(" ", "\n")), (101, "MIT License"), (102, "Copyright 2020 X\n" + mit + " not"), (103, "My License\n" + mit)]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(len(heads)), "MIT"), 100: "BSD-3-Clause", 101: "MIT", 102: None, 103: "MIT"}


def test_licences_of_a_folder(spark, tmp_path):
    """Whole texts by name, in other case, spelling, line breaks and with another owner, beside ones that differ by a word."""
    for name, text in licenses.KNOWN_TEXTS:
        (tmp_path / f"X-{name}.txt").write_text(text)
    system = Path("/usr/share/common-licenses")
    whole = {f.name: f.read_text(errors="replace") for f in sorted(system.glob("*")) if f.is_file() and not f.is_symlink()} if system.is_dir() else {}
    for name, text in whole.items():
        (tmp_path / name).write_text(text)
    known = licenses.read_licenses(spark, str(tmp_path))
    texts = {f"X-{n}": t for n, t in licenses.KNOWN_TEXTS} | whole
    docs = []
    for k, (name, text) in enumerate(sorted(texts.items())):
        other = re.sub(r"[ \n]+", "\n", text.upper() if k % 2 else text.replace("license", "licence"))
        docs += [(3 * k, f"Copyright (c) 20{k:02} Somebody\n\n{text}"), (3 * k + 1, "\n" + other if "opyright" not in text else text.swapcase()), (3 * k + 2, text + " unless")]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), texts=known).collect()}
    for k, name in enumerate(sorted(texts)):
        assert got[3 * k] == got[3 * k + 1] == name and got[3 * k + 2] is None


# 9: HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("just words in a row that run on for a while without any tag at all", "just words in a row that run on for a while without any tag at all"),
        ("<nav><a href=/x>Home</a></nav><article><h1>T &amp;&lt;x</h1><p>One\n two<br>three <b>bo</b>ld</p><p>x</article><footer>foot</footer>", "T &<x\nOne two three bold\nx"),
        ("<article><p>a &copy b &#233;&nbsp;c</p><script>var p='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>d</p>", "a © b é c\nd"),
        ("<div class='cookie-notice'><p>we use cookies</p></div><main><p>kept</p><div id=\"comments\"><p>reader says</p></div><form><p>send</p></form></main><aside><p>side</p></aside>", "kept"),
        ("<header><h1>Site</h1></header><article><p>body</p><div class='ad'>buy</div><ul class=\"menu\"><li>x</li></ul></article>", "body"),
        ("<article><p>cut off in the mid<b", "cut off in the mid"), ("<article><p title='a > b'>x</p><p>y &am", "x\ny &am"),
        ("<div id='content-sidebar-wrap'><article><p>inside</p></article></div>", "inside"),
        ("<div class='siteheader'>Site</div><div id=content><h1>T</h1><p>Of.</p><p>One two</p><div class=topnav>m</div></div><div>tail</div>", "T\nOf.\nOne two"),
        ("<head><title>t</title><body><p>a long enough paragraph of text here</p><ul><li><a href=x>next</a></ul>", "a long enough paragraph of text here"),
        ("<p>" + "word " * 5000 + "</p>", ("word " * 5000).strip()),
        (
            "<article><h1>T</h1><section id='related-work'><p>one two three four</p></section><div class=\"search-results-analysis\"><p>five</p></div><p class='notice-board'>six</p>"
            "<div class='related-posts'><a href=x>more</a></div><p class='cookie-notice'>seven</p><div class='ad-slot-3'>buy</div><div class='x share-buttons'>tell</div><div class='comment-body'>eight</div></article>",
            "T\none two three four\nfive\nsix",
        ),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def nameless(page):
    """The page without names of its parts: sectioning elements as div, no class, id or role."""
    page = re.sub(r"<(/?)(?:article|nav|aside|footer|header|main|section|form|menu|dialog)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_blocks_of_nameless_pages(spark):
    """Pages that the table's blocks aren't from: words, links and neighbours alone tell main text from furniture."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 500 AND page_id < 900").collect()]
    kept = right = main = 0
    for page in pages:
        blocks = html_extract.blocks_of(nameless(page))
        truth = [b.in_article and not b.in_furniture for b in html_extract.blocks_of(page)]
        assert len(truth) == len(blocks) and not any(b.in_article or b.in_furniture for b in blocks)
        got = html_extract.block_tree().predict(html_extract.features_of(blocks)) > 0.5
        kept, right, main = kept + got.sum(), right + (got & truth).sum(), main + sum(truth)
    assert right / kept > 0.98 and right / main > 0.98


def test_counts_and_densities_decide_without_names():
    used = {html_extract.FEATURES[f] for f in html_extract.block_tree().feature if f >= 0}
    assert {"words", "links", "links_before", "words_after"} <= used


def test_pages(spark):
    import html as h

    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    for r, p in zip(html_extract.extract_pages(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == p.url
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# 10: SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_components(docs, rows):
    marks = [(i, plain_fingerprint(t)) for i, t in docs]
    ids = sorted({i for i, _ in marks if i is not None})
    links = [(a, b) for (a, x), (b, y) in itertools.combinations([m for m in marks if m[0] is not None], 2) if (x ^ y).bit_count() <= 4]
    root = components(ids, links)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows if r.doc_id is not None) == Counter((i, f"{f:016x}", root[i]) for i, f in marks if i is not None)


def test_simhash(spark, odd, empty, corpus):
    check_components(ODD, simhash.simhash_components(odd).collect())
    rng = random.Random(9)
    near = []
    for k, (_, text) in enumerate(corpus[:60]):
        words = (text or "").split()
        for j in range(3):
            some = list(words)
            if some:
                some[rng.randrange(len(some))] = f"new{j}"
            near.append((10_000 + 10 * k + j, " ".join(some)))
    docs = [*corpus, *near]
    rows = simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_components(docs, rows)
    assert sum(r.component_id != r.doc_id for r in rows) > 50
    assert simhash.simhash_components(empty).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_similar_components(spark, odd, empty, corpus):
    rng, docs = random.Random(12), list({t: (i, t) for i, t in corpus}.values())
    for k, (i, text) in enumerate(docs[:120]):
        words = text.split()
        if len(words) >= 30:
            for _ in range(max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            docs.append((20_000 + k, " ".join(words)))
    rows = by_id(simhash.similar_components(spark.createDataFrame(docs, "doc_id long, text string")))
    sets = {i: shingle_set(t) for i, t in docs}
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(sets, 2)]
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(near) > 60 and np.mean([rows[a].component_id == rows[b].component_id for a, b in near]) > 0.95
    close = components(sets, [(a, b) for a, b, j in pairs if j > 0.3])
    assert np.mean([close[i] == close[r.component_id] for i, r in rows.items()]) > 0.98  # others stay apart
    kept = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows.values()})
    same_text = {r.doc_id: r.component_id for r in simhash.similar_components(odd).collect()}
    assert same_text[1] == same_text[2] == same_text[3] == 1 and same_text[4] == same_text[5] == same_text[9] == 4 and same_text[6] == 6
    assert simhash.similar_components(empty).count() == 0
    clash = odd.withColumnsRenamed({"score": "gone_id", "kept": "_body", "_hash": "Gone_Body"})
    assert len(simhash.drop_near_duplicates(clash).columns) == len(odd.columns)


def test_blocks_miss_no_link(spark):
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    marks = sorted(fps)
    reps = spark.createDataFrame([(k, [f - (f >> 63 << 64)]) for k, f in enumerate(marks)], "rep_id long, fp array<long>")
    want = components(range(len(marks)), [(a, b) for a, b in itertools.combinations(range(len(marks)), 2) if (marks[a] ^ marks[b]).bit_count() <= 4])
    for blocks in (5, 6, 7, 8):
        keys = simhash.F.explode(simhash.choice_keys(simhash.F.col("fp"), blocks, 4)).alias("key")
        keyed = reps.select("rep_id", "fp", keys).select(simhash.F.xxhash64("key.which", "key.bits").alias("group"), "rep_id", simhash.F.get("fp", 0).alias("w0"))
        links = [(r.a, r.b) for r in simhash.fingerprint_links(keyed, 4).collect()]
        assert components(range(len(marks)), links) == want
    assert [simhash.block_count(n, 4) for n in (0, 10**5, 10**9)] == sorted(simhash.block_count(n, 4) for n in (0, 10**5, 10**9))


def test_components(spark):
    rng = random.Random(11)
    for edges in ([(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], [(rng.randrange(400), rng.randrange(400)) for _ in range(300)], [(5, 5)], []):
        df = spark.createDataFrame(edges + edges[:5], "a long, b long")
        got = {r.node: r.component for r in graph.connected_components(df).collect()}
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        assert got == components(nodes, edges) if nodes else got == {}


def test_similar_links_are_verified(spark):
    rng, docs = random.Random(13), []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        docs.append((2 * k, " ".join(words)))
        for at in rng.sample(range(0, 200, 6), 1 + k % 9):
            words[at] = f"x{rng.randrange(10**6)}"
        docs.append((2 * k + 1, " ".join(words)))
    sets = {i: shingle_set(t) for i, t in docs}
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # no link below 0.8
    missed = sum(got[i] != c for i, c in want.items())
    assert sum(i != c for i, c in want.items()) > 50 and missed <= 5


def test_set_forest():
    rng = random.Random(14)
    sets = [np.array(sorted(rng.sample(range(14), rng.randrange(6, 13))), np.uint64) for _ in range(60)]
    jaccard = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    want = [(a, b) for a, b in itertools.combinations(range(60), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    pairs = groups.forest(groups.Sets([x.astype("<u8").tobytes() for x in sets], 0.8), 60)
    assert all(tuple(sorted(p)) in want for p in pairs) and components(range(60), pairs) == components(range(60), want)


def edited(rng, words, n):
    """`words` with n of them replaced."""
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return words


def test_large_groups_are_dealt_out(spark):
    """A dense group, two dense ones joined by a chain, and loose members, in blocks of eight."""
    rng, rows = random.Random(17), []
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(4)]
    texts = [" ".join(edited(rng, base[0], 1)) for _ in range(60)]
    step = base[1]
    for k in range(40):  # each next one differs from the last by a word, so ends are far apart
        step = edited(rng, step, 1)
        texts.append(" ".join(step))
    texts += [" ".join(edited(rng, base[2], rng.randrange(1, 12))) for _ in range(50)] + [" ".join(edited(rng, base[3], 60)) for _ in range(20)]
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    rows = [(k % 2, k, np.unique(simhash.shingle_hashes(t, 5)).tobytes()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "group long, node long, body binary")
    links = [(r.a, r.b) for r in groups.large_group_links(df, lambda b: groups.Sets(b, 0.8), 8).collect()]
    assert set(map(tuple, map(sorted, links))) <= {p for p in near}
    within = [p for p in near if p[0] % 2 == p[1] % 2]
    assert components(range(len(texts)), links) == components(range(len(texts)), within)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(range(len(texts)), near)
    for hot in (16, 1000):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(docs, hot=hot).collect()}
        assert all(want[i] == want[c] for i, c in got.items()) and sum(got[i] != c for i, c in want.items()) <= 2


def test_far_homes_prune_no_link(spark):
    """Many kinds of near copies in one group, some a few edits from another kind: the links are brute force's."""
    rng, texts = random.Random(24), []
    for k in range(8):
        kind = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(edited(rng, kind, rng.randrange(3))) for _ in range(25)]
        if k % 2:  # a chain that leads to a kind of its own
            for _ in range(6):
                kind = edited(rng, kind, 2)
                texts += [" ".join(edited(rng, kind, rng.randrange(2))) for _ in range(3)]
    sets = [shingle_set(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    rows = [(0, k, np.unique(simhash.shingle_hashes(t, 5)).tobytes()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "group long, node long, body binary")
    links = [(r.a, r.b) for r in groups.large_group_links(df, lambda b: groups.Sets(b, 0.8), 32).collect()]
    assert set(map(tuple, map(sorted, links))) <= set(near) and components(range(len(texts)), links) == components(range(len(texts)), near)
    marks = sorted({f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for f in [rng.getrandbits(64) for _ in range(6)] for _ in range(40)})
    df = spark.createDataFrame([(0, k, bytearray(m.to_bytes(8, "little"))) for k, m in enumerate(marks)], "group long, node long, body binary")
    links = [(r.a, r.b) for r in groups.large_group_links(df, lambda b: groups.Fingerprints(b, 4), 32).collect()]
    want = components(range(len(marks)), [(a, b) for a, b in itertools.combinations(range(len(marks)), 2) if (marks[a] ^ marks[b]).bit_count() <= 4])
    assert components(range(len(marks)), links) == want


def test_hot_keys_of_fingerprints(spark):
    rng = random.Random(18)
    docs = []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        docs += [(100 * k + j, " ".join(edited(rng, words, 1))) for j in range(30)]
    rows = simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string"), hot=16).collect()
    check_components(docs, rows)


def test_recall_at_the_threshold():
    """Pairs of just the similarity asked for share a block and stay within the radius, at any number of documents."""
    rng = np.random.default_rng(19)
    for n in (10**4, 10**7):
        blocks, found = simhash.Blocks.suited(n, 0.8), 0
        for _ in range(60):
            both = rng.integers(0, 2**63, 1600).astype("<u8")
            a, b = np.concatenate([both, rng.integers(0, 2**63, 200).astype("<u8")]), np.concatenate([both, rng.integers(0, 2**63, 200).astype("<u8")])
            marks = np.stack([simhash._majority(x, simhash.LONG_WORDS) for x in (a, b)])
            keys = blocks.keys(marks)
            near = np.bitwise_count(marks[0, :4] ^ marks[1, :4]).sum() <= simhash.radius_of(0.8, 256, 3.5)
            found += bool(near and (keys[0] == keys[1]).any())
        assert found >= 55


def test_block_groups_do_not_grow():
    """As documents double blocks grow by a bit, so that as many share one by chance; random fingerprints fill them evenly."""
    rng = np.random.default_rng(20)
    marks = rng.integers(0, 2**63, (1 << 16, 8)).astype("<u8") * np.uint64(2) + rng.integers(0, 2, (1 << 16, 8)).astype("<u8")
    for n in (1 << 22, 1 << 23, 1 << 30):
        blocks = simhash.Blocks.suited(n, 0.8)
        assert n / 2**blocks.width == 32
        keys = simhash.Blocks(blocks.width, 1).keys(marks)
        for one in keys.T[:4]:
            assert len(np.unique(one)) == pytest.approx(2**blocks.width * -np.expm1(-len(marks) / 2**blocks.width), rel=0.02)


def test_repeated_lines_count_once(spark):
    rng, docs = random.Random(15), []
    for k in range(20):
        line = " ".join(f"line{k}x{j}" for j in range(12))
        lone = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (400, 100, 100)]
        docs += [(4 * k, f"{lone[0]} {line}"), (4 * k + 1, " ".join([lone[0], *[line] * 5]))]
        docs += [(4 * k + 2, " ".join([lone[1], *[line] * 12])), (4 * k + 3, " ".join([lone[2], *[line] * 12]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - (i % 4 == 1) for i, _ in docs}


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>one</p><video-player src=x></video-player><p>three</p>", "one\nthree"),
        ("<p>one <svg-icon></svg-icon>two</p><button-group><p>three</p></button-group><style-guide></style-guide><p>four</p>", "one two\nthree\nfour"),
        ("<p>one <svg width='1'/> two</p><p>three</p>", "one two\nthree"),
        ("<p>one <svg><svg><path d='M0'/></svg><text>no</text></svg> two</p>", "one two"),
        ("<p>if <math><mi>x</mi><mo>&gt;</mo><mn>1</mn></math> holds</p>", "if x>1 holds"),
        ("<p>one <button>no</p><p>two</p><button>no<p>no</p></button><p>three</p>", "one\ntwo\nthree"),
        ("<p>one <span class=share><select><option>no</span></p><p>two</p><script>no<p>no</p>", "one\ntwo"),
    ],
)
def test_embedded_elements_swallow_no_text(inside, text):
    page = f"<html><body><nav><a href=/>Home</a></nav><article>{inside}</article></body></html>"
    assert [b.text for b in html_extract.blocks_of(page) if b.in_article] == text.split("\n")


def test_ids_of_long_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for space in (" ", "\n"):
        text = "a" + space * 2_000_000 + "b<|endoftext|>\n c"
        assert packing.byte_bpe()(text) == coder.encode(text).ids


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(16)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(4)]
    near = [f"{t} more" for t in long]
    docs = [(1, long[0]), (5, near[0]), (5, long[1]), (7, long[2]), (7, near[2]), (8, long[3]), (None, near[3])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    least = min(long[2], near[2], key=lambda t: hashlib.md5(t.encode()).digest())
    assert got == sorted([(1, long[0]), (5, long[1]), (7, least), (8, long[3]), (0, near[3])])
