"""URL rules by host suffix and path prefix, decided by exact Bloom filter cascades.

Every key a URL could match (a suffix of its host with a prefix of its path) is looked up in a
cascade of Bloom filters: level 1 holds the rules, level 2 the corpus's keys that level 1 lets
through wrongly, level 3 the rules that level 2 lets through wrongly, and so on until a level lets
nothing through. The false keys are taken over the complete set of the corpus's keys, so a lookup
is exact for each of them and the rules are never joined to pages. A second cascade, over the rules,
tells blocking ones from allowing ones.

Filters are literals in the plan. Their size is a few bytes a rule and is bounded: a longer list is
dealt by hash into slices, each with a cascade of its own over the keys of that slice, and pages pass
through them one after the other, the best match so far beside them. The first level lets the fewer
keys through the more URLs there are. Keys are aggregated before they move, so a rule that a third of
all pages match counts once a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.llm.shared import ASCII_UPPER, cut, unused

#: The rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Bits in all levels of a cascade: 8 MB as a literal.
MAX_BITS = 1 << 26
#: A rule's shape in one number: labels of its host times SHAPE, and the length of its path.
SHAPE = 1 << 20
MAX_SHAPES = 10_000


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _bit(key: Column, level: int, probe: int, bits: int) -> Column:
    """A probe's place in a level's filter; each level hashes anew, so no false key can pass all."""
    first, second = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return F.pmod(F.shiftright(first, 2) + F.shiftright(second, 2) % (1 << 56) * probe, F.lit(bits))


@dataclass
class Cascade:
    """Levels of (bits, probes, words of 64 bits)."""

    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Whether `key`, of the universe the cascade was built over, is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            found = F.when(self.passes(key, k), found).otherwise(F.lit(k % 2 == 0))
        return found

    def passes(self, key: Column, level: int) -> Column:
        """The level's filter alone: true for all keys that it holds and for some others."""
        bits, probes, words = self.levels[level - 1]
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal
        # The literal stands once in the plan, whatever the number of probes.
        return F.forall(F.array(*[_bit(key, level, p, bits) for p in range(probes)]), lambda at: self._is_set(held, at))

    @staticmethod
    def _is_set(held: Column, at: Column) -> Column:
        word = F.get(held, F.shiftright(at, 6).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0

    def add(self, keys: DataFrame, n: int, false_rate: float) -> None:
        """Append a level that holds the `n` distinct `key`s."""
        probes = max(1, round(-math.log2(false_rate)))
        bits = max(64, -(-math.ceil(n * probes / math.log(2)) // 64) * 64)
        if bits + sum(b for b, _, _ in self.levels) > MAX_BITS:
            raise ValueError(f"the filters of {n} keys pass {MAX_BITS} bits")
        level = len(self.levels) + 1
        at = F.explode(F.array(*[_bit(F.col("key"), level, p, bits) for p in range(probes)])).alias("at")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        words = [0] * (bits // 64)
        for row in keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(mask).alias("bits")).collect():
            words[row.word] = row.bits
        self.levels.append((bits, probes, words))


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 2**-10, rate: float = 0.5, max_levels: int = 64) -> Cascade:
    """A cascade exact on every `key` of `universe` and of `listed` (one column each, repeats allowed).

    The first level's false rate is low, since the universe may be large and the list small; later
    levels hold few keys. Null keys are not listed.
    """
    cascade, inside = Cascade(), cut(listed.select("key").dropna().distinct())
    n = inside.count()
    if n == 0:
        return cascade
    cascade.add(inside, n, first_rate)
    through = universe.filter(cascade.passes(F.col("key"), 1)).select("key").distinct()
    outside = cut(through.join(inside, "key", "left_anti"))
    wrong, other = outside, inside
    for level in range(2, max_levels):
        n = wrong.count()
        if n == 0:
            return cascade
        cascade.add(wrong, n, rate)
        wrong, other = cut(other.filter(cascade.passes(F.col("key"), level))), wrong
    raise RuntimeError("the cascade does not end")


def first_rate_for(universe: int) -> float:
    """A false rate of the first level that leaves the second, which holds the universe's false keys, an eighth of MAX_BITS."""
    return min(2.0**-10, MAX_BITS / 8 / 1.5 / max(universe, 1))


class UrlRules:
    """Rules (verdict, host, path) ready to judge the URLs of one corpus."""

    def __init__(
        self,
        rules: DataFrame,
        urls: DataFrame,
        url: str = "url",
        default: str = DEFAULT,
        first_rate: float | None = None,
        rules_at_once: int | None = None,
    ):
        """`rules` has verdict (allow or block), host and path; a rule that repeats must not contradict itself.

        Hosts are lower-cased like those of URLs. From the rules the driver learns three small things:
        their number and their shapes (labels of the host and length of the path, at most MAX_SHAPES).
        The first level's false rate follows from the number of URLs, and how many rules one cascade takes
        from that rate; a slice's cascade is built over the corpus's keys of that slice alone.
        """
        keyed = rules.select("verdict", F.translate("host", ASCII_UPPER, ASCII_UPPER.lower()).alias("host"), "path").dropna()
        shape = (F.size(F.split("host", r"\.")) * SHAPE + F.length("path")).cast("long")
        keyed = cut(keyed.select("verdict", shape.alias("shape"), F.concat("host", "path").alias("key")).distinct())
        self.shapes = sorted(r["shape"] for r in keyed.select("shape").distinct().limit(MAX_SHAPES + 1).collect())
        if len(self.shapes) > MAX_SHAPES:
            raise ValueError(f"rules of more than {MAX_SHAPES} shapes")
        self.default = default
        self.slices: list[tuple[Cascade, Cascade]] = []
        rate = first_rate or first_rate_for(urls.count() * len(self.shapes))
        at_once = rules_at_once or int(MAX_BITS / 2 / (1.5 * -math.log2(rate)))
        self.n_slices = max(1, -(-keyed.count() // at_once))
        universe = urls.select(F.explode(self.keys(host_of(F.col(url)), path_of(F.col(url)))).alias("key"))
        for k in range(self.n_slices):
            some = keyed.filter(self._in_slice(F.col("key"), k))
            listed = build_cascade(some, universe.filter(self._in_slice(F.col("key"), k)), rate)
            self.slices.append((listed, build_cascade(some.filter("verdict = 'block'"), some, 2.0**-10)))

    def _in_slice(self, key: Column, k: int) -> Column:
        return F.lit(True) if self.n_slices == 1 else F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(self.n_slices)) == k

    def keys(self, host: Column, path: Column) -> Column:
        """Every rule a URL could match: for each shape of rules the host's last labels with the path's first letters."""
        if not self.shapes:
            return F.array().cast("array<string>")
        labels, length = F.size(F.split(host, r"\.")), F.length(path)
        shapes = F.split(F.lit(",".join(map(str, self.shapes))), ",").cast("array<bigint>")  # folded to one literal
        fitting = F.filter(shapes, lambda x: (host != "") & (F.floor(x / SHAPE) <= labels) & (x % SHAPE <= length))
        return F.transform(
            fitting,
            lambda x: F.concat(
                F.call_function("substring_index", host, F.lit("."), F.negate(F.floor(x / SHAPE)).cast("int")), F.left(path, (x % SHAPE).cast("int"))
            ),
        )

    def judge(self, df: DataFrame, url: str = "url") -> DataFrame:
        """`df` with host, path, rule and verdict; any columns of these names are replaced.

        `df` is the corpus the rules were prepared for. The longest matching rule wins (host and path
        together); where none matches, rule is null and the verdict the default. Null URLs and ones
        without `://` have an empty host and path and match none.
        """
        told = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        best, longest = unused(told, "best"), unused(told, "longest")
        told = told.withColumn(best, F.lit(None).cast("struct<length:int,key:string,verdict:string>"))
        for k, (listed, blocking) in enumerate(self.slices):
            hits = F.filter(self.keys(F.col("host"), F.col("path")), lambda x: self._in_slice(x, k) & listed.contains(x))  # noqa: B023
            told = told.withColumn(longest, F.array_max(F.transform(hits, lambda x: F.struct(F.length(x), x.alias("key"))))["key"])
            verdict = F.when(blocking.contains(F.col(longest)), "block").otherwise("allow")
            own = F.struct(F.length(longest).alias("length"), F.col(longest).alias("key"), verdict.alias("verdict"))
            told = told.withColumn(best, F.array_max(F.array(best, F.when(F.col(longest).isNotNull(), own)))).drop(longest)
            if k + 1 < len(self.slices):
                told = cut(told)  # one slice's filters in a plan at a time
        return told.withColumns({"rule": F.col(f"{best}.key"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(self.default))}).drop(best)


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_pages(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`."""
    slim = pages.select("page_id", F.col(url).alias("url"))
    return UrlRules(rules, slim).judge(slim).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), matched AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN matched USING (page_id)
"""
