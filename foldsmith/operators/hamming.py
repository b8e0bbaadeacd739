"""Exact Hamming search over an index of hash segments, instead of all pairs [J6, J7, J11, C5].

A 64-bit hash is cut into m segments. Hashes within d = m r + a bits agree up to r bits in one of the first a + 1 segments, or up
to r - 1 bits in one of the others, so it is enough to look up each segment with that many bits turned over. Equal hashes are one
entry; a segment value that many entries share (blank images, say) is dealt to several parts, and what looks it up goes to all of them.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.session import materialize

#: Entries of a segment value that one part of it holds (about), and lookups of a hash at most: the table of bits to turn over is broadcast.
PART, MOST_MASKS = 4096, 1 << 15


def segments(m: int) -> list[tuple[int, int]]:
    """(first bit, width) of m segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def radii(most: int, m: int) -> list[int]:
    """Bits by which each segment may differ so that no hash within `most` is missed; -1: the segment is not looked up."""
    r, a = divmod(most, m)
    return [r if i <= a else r - 1 for i in range(m)]


def lookups(most: int, m: int) -> list[int]:
    """Values that a probe looks up in each segment."""
    return [sum(comb(width, i) for i in range(r + 1)) for (_, width), r in zip(segments(m), radii(most, m))]


def cost(n_entries: int, most: int, m: int) -> float:
    """Rows that a probe makes: one for each lookup, and the entries that a random hash would meet."""
    return sum(n + n_entries * n / 2**width for n, (_, width) in zip(lookups(most, m), segments(m)))


def best_m(n_entries: int, most: int) -> int:
    """The number of segments that costs least, of those with MOST_MASKS lookups at most."""
    return min((m for m in range(2, max(2, min(most + 1, 16)) + 1) if sum(lookups(most, m)) <= MOST_MASKS), key=lambda m: cost(n_entries, most, m))


def _value(h: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else h


def _entries(hashes: DataFrame, m: int) -> DataFrame:
    """(seg, value, part, parts, h) of different hashes h: their segments, hot values dealt to parts."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _value(F.col("h"), a, w).alias("value")) for i, (a, w) in enumerate(segments(m)))))
    rows = materialize(hashes.select("h", each.alias("s")).select("h", "s.*"), "hash-segments")
    hot = rows.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("seg", "value", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    return rows.join(materialize(hot, "hash-hot"), ["seg", "value"], "left").select("seg", "value", "h", F.coalesce("parts", F.lit(1)).alias("parts"))


def _masks(spark: SparkSession, m: int, ring: list[range]) -> DataFrame:
    """(seg, mask): the bits to turn over in each segment; their number depends on the distance alone."""
    rows = [(i, sum(1 << b for b in bits)) for i, (_, width) in enumerate(segments(m)) for r in ring[i] for bits in combinations(range(width), r)]
    return spark.createDataFrame(rows, "seg int, mask long")


def _candidates(probes: DataFrame, entries: DataFrame, m: int, ring: list[range]) -> DataFrame:
    """(q, h): probes and entries that share a segment up to the bits of the ring; a pair may come more than once."""
    spark = probes.sparkSession
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _value(F.col("q"), a, w).alias("own")) for i, (a, w) in enumerate(segments(m)))))
    asks = probes.select("q", each.alias("s")).select("q", "s.*").join(F.broadcast(_masks(spark, m, ring)), "seg")
    asks = asks.select("q", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    parts = entries.where("parts > 1").select("seg", "value", F.col("parts").alias("many")).distinct()
    asks = asks.join(parts, ["seg", "value"], "left").select("q", "seg", "value", F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1)).alias("part"))
    dealt = entries.select("seg", "value", "h", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"))
    return asks.join(dealt, ["seg", "value", "part"]).select("q", "h")


def near_hashes(probes: DataFrame, hashes: DataFrame, most: int, m: int | None = None) -> DataFrame:
    """(q, h, distance): every different hash h within `most` bits of each different probe q (columns q and h; null matches nothing)."""
    probes = materialize(probes.select("q").where("q IS NOT NULL").distinct(), "hash-probes")
    hashes = materialize(hashes.select("h").where("h IS NOT NULL").distinct(), "hash-entries")
    m = m or best_m(hashes.count(), most)
    found = _candidates(probes, _entries(hashes, m), m, [range(r + 1) for r in radii(most, m)])
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("h"))).cast("long")
    return found.withColumn("distance", distance).where(F.col("distance") <= most).distinct()


#: Segments of the nearest search, and rings: bits turned over in each. After ring r nothing within 4 r + 3 bits is unseen.
NEAREST_SEGMENTS, RINGS = 4, 4


def nearest_hashes(probes: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((q, distance) of the probes whose least distance is settled, probes (q) that have nothing within 4 RINGS - 1 bits).

    Rings of growing radius around every probe; a probe leaves once its best is no farther than what the ring has seen in full.
    """
    left = materialize(probes.select("q").where("q IS NOT NULL").distinct(), "hash-probes")
    entries = materialize(_entries(hashes.select("h").where("h IS NOT NULL").distinct(), NEAREST_SEGMENTS), "hash-index")
    done, best = None, left.withColumn("best", F.lit(65).cast("long"))
    for r in range(RINGS):
        found = _candidates(left, entries, NEAREST_SEGMENTS, [range(r, r + 1)] * NEAREST_SEGMENTS)
        least = found.groupBy("q").agg(F.min(F.bit_count(F.col("q").bitwiseXOR(F.col("h")))).cast("long").alias("now"))
        best = materialize(best.join(least, "q", "left").select("q", F.least("best", "now").alias("best")), "hash-ring")
        sure = NEAREST_SEGMENTS * (r + 1) - 1
        settled = best.where(F.col("best") <= sure).select("q", F.col("best").alias("distance"))
        done = settled if done is None else done.unionByName(settled)
        best = best.where(F.col("best") > sure)
        left = best.select("q")
        if left.isEmpty():
            break
    return done, left
