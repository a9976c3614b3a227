"""Keys that a scan tests before any row moves: a blocked Bloom filter of bounded size, and an exact join behind it.

The filter is a table of bitmaps made by Spark's `bitmap_construct_agg`: a key chooses one bitmap of 4 KB and
a few bits in it. The table is broadcast, so rows that fail the test stay in their tasks and their texts are
never shuffled. Its size follows from the number of keys up to MOST_BITMAPS, 256 MB; beyond that only the false
rate grows, smoothly (10 bits a key, a rate near one percent, up to 200 million keys; 2 bits and 40 percent at a
thousand million). Nothing rests on the rate but how much moves: what passes is joined or grouped exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmer.llm.shared import cut, unused

#: Bits of one bitmap, which is what `bitmap_construct_agg` makes.
BITMAP_BITS = 4096 * 8
#: Most bitmaps of a filter: 2^31 bits.
MOST_BITMAPS = 1 << 16
BITS_A_KEY = 12


@dataclass
class Sieve:
    """Bitmaps (bitmap, bits) in number `n`, with `probes` bits for each key."""

    bitmaps: DataFrame
    n: int
    probes: int

    def _test(self, key: Column, bits: Column) -> Column:
        """Whether all of the key's bits are set; looked at one by one, so most foreign keys end at the first."""
        def is_set(probe: int) -> Column:
            at = _position(key, probe)
            byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1

        told = is_set(0)
        for probe in range(1, self.probes):
            told = told & is_set(probe)
        return told

    def _apply(self, df: DataFrame, key: Column, how: str) -> DataFrame:
        name, bits = unused(df, "bitmap"), unused(df, "bits")
        table = self.bitmaps.select(F.col("bitmap").alias(name), F.col("bits").alias(bits))
        return df.join(F.broadcast(table), (_bitmap(key, self.n) == F.col(name)) & self._test(key, F.col(bits)), how)

    def passing(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows whose key is in the filter, and some others."""
        return self._apply(df, key, "left_semi")

    def failing(self, df: DataFrame, key: Column) -> DataFrame:
        """All other rows: none of them has a key that the filter was made of."""
        return self._apply(df, key, "left_anti")


def _bitmap(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bitmap"), key), F.lit(n))


def _position(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), key), F.lit(BITMAP_BITS)).cast("int")


def build_sieve(keys: DataFrame, most: int = MOST_BITMAPS) -> Sieve:
    """A filter of all values of the one column of `keys`; it is made once and written to the shared folder."""
    key = F.col(keys.columns[0])
    count = max(keys.count(), 1)
    n = min(most, math.ceil(count * BITS_A_KEY / BITMAP_BITS))
    probes = min(max(1, round(n * BITMAP_BITS / count * math.log(2))), 6)
    at = F.explode(F.array(*[_position(key, p) for p in range(probes)])).alias("at")
    rows = keys.filter(key.isNotNull()).select(_bitmap(key, n).alias("bitmap"), at)
    return Sieve(cut(rows.groupBy("bitmap").agg(F.bitmap_construct_agg("at").alias("bits"))), n, probes)


#: A table of so many keys is small enough to be sent to all tasks as it is (some tens of bytes a row).
FEW = 100_000


def matching(df: DataFrame, keys: DataFrame, on: list[str], few: int = FEW) -> DataFrame:
    """The inner join of `df` with `keys`, a written table with one row for each key.

    Few keys are broadcast; beyond `few` of them a filter of bounded size is, and what passes it is joined by a
    shuffle: at any size rows without a key stay where they are.
    """
    if keys.count() <= few:
        return df.join(F.broadcast(keys), on)
    return build_sieve(keys.select(F.xxhash64(*on))).passing(df, F.xxhash64(*on)).join(keys, on)


def others(df: DataFrame, keys: DataFrame, on: list[str], few: int = FEW) -> DataFrame:
    """The rows of `df` that have none of these keys (null ones never match), in the way of `matching`."""
    if keys.count() <= few:
        return df.join(F.broadcast(keys.select(*on)), on, "left_anti")
    sieve, key = build_sieve(keys.select(F.xxhash64(*on))), F.xxhash64(*on)
    return sieve.failing(df, key).unionByName(sieve.passing(df, key).join(keys.select(*on), on, "left_anti"))
