"""Minimax contiguous sharding with DataFrame and SQL functions only.

Groups (equal texts) are atomic and ordered by the SHA-256 of their text. The smallest capacity is searched for with
which a greedy fill needs no more than the given number of shards; then the order is cut under that capacity, as close
to equal shares of what is left as it allows, so that no shard stays empty behind a large group without need.

The search never holds the groups. It works on units, runs of consecutive groups: at first the 65,536 ranges of the
digest's first 16 bits. A fill over whole units can always be done (upper bound); one that may cut a unit anywhere
gives a lower bound. Between the two only a few units can hold a cut; they are split by the next bits of the digest,
and the search is repeated until no unit that may hold a cut has more than one group. The result is that of a search
over all groups, while the units stay at some thousands whatever the input.

Defined cases: a null or empty text has size 1 and the CRC of no bytes; null texts form one group with the empty
ones; repeated rows and equal doc_ids stay as rows; a null doc_id is placed like any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

SHARDS = 16
FIRST_HEX, MORE_HEX = 4, 2   # hex digits of the digest that name a unit at first, and more with each split
SLOT_PARTS = 4096            # parts of a shard whose rows are numbered on their own


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Units before each shard's end if every unit is atomic; None if ``shards`` do not suffice.

    ``ends`` are running sums of the sizes of the units.
    """
    cuts, filled = [], 0
    while len(cuts) < shards:
        at = bisect_right(ends, filled + capacity)
        if at == (cuts[-1] if cuts else 0):
            if at < len(ends):
                return None
        cuts.append(at)
        filled = ends[at - 1] if at else 0
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search of the least capacity for which the greedy fill of atomic units does."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Units before each shard's end: near equal shares of the rest, none above a capacity that the greedy fill meets."""
    sums = [0, *ends]
    least = [len(ends)]  # least[k]: the first unit from which k shards hold the rest
    for _ in range(shards):
        least.append(bisect_left(sums, sums[least[-1]] - capacity))
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        goal = sums[at] + (sums[-1] - sums[at]) / left
        near = bisect_left(sums, goal)
        near -= near > at and goal - sums[near - 1] < sums[near] - goal
        at = min(max(near, least[left - 1], at), bisect_right(sums, sums[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def reach(ends: list[int], capacity: int, shards: int) -> list[tuple[int, int]]:
    """For each cut of the greedy fill the units (first, last) that may hold it at this capacity.

    The early end takes whole units as atomic, the late end takes a unit as divisible.
    """
    spans, early, late = [], 0, 0
    for _ in range(shards):
        early = max(early, bisect_right(ends, (ends[early - 1] if early else 0) + capacity))
        late = min(late + capacity, ends[-1])
        spans.append((early, bisect_right(ends, late)))
    return spans


def _units(groups: DataFrame, width: int):
    """Units named by the first ``width`` hex digits: name, size, groups, largest group, in order."""
    unit = groups.groupBy(F.substring("digest", 1, width).alias("unit")).agg(
        F.sum("group_size").alias("size"), F.count("*").alias("n"), F.max("group_size").alias("largest"))
    return [(r.unit, r.size, r.n, r.largest) for r in unit.orderBy("unit").collect()]


def cut_points(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest capacity, and for each shard but the last the largest digest prefix that it holds.

    ``groups`` has ``digest`` (hex) and ``group_size``. A prefix stands for every digest that starts with it; an empty
    one means that the shard and those before it are empty.
    """
    width = FIRST_HEX
    units = _units(groups, width)
    while True:
        sizes = [u[1] for u in units]
        ends = list(accumulate(sizes))
        high = smallest_capacity(sizes, shards)
        low = max([-(-ends[-1] // shards), *[u[3] for u in units]]) if units else 0
        # Cuts move right as the capacity grows: the early ones of the lower bound to the late ones of the upper.
        open_units = set()
        if low < high:
            first, last = reach(ends, low, shards), reach(ends, high, shards)
            for k in range(shards - 1):
                open_units.update(range(first[k][0], min(last[k][1] + 1, len(units))))
        else:
            for at in greedy_cuts(ends, high, shards) or []:
                open_units.update(range(max(0, at - 1), min(at + 1, len(units))))
        split = [i for i in open_units if units[i][2] > 1 and len(units[i][0]) < 64]
        if not split:
            break
        names = [units[i][0] for i in split]
        width = min(64, max(len(n) for n in names) + MORE_HEX)
        chosen = None
        for length in sorted({len(n) for n in names}):
            some = F.substring("digest", 1, length).isin([n for n in names if len(n) == length])
            chosen = some if chosen is None else chosen | some
        finer = _units(groups.filter(chosen), width)
        whole = set(split)
        units = sorted([u for i, u in enumerate(units) if i not in whole] + finer)
    cuts = even_cuts(ends, high, shards)
    return high, [units[at - 1][0] if at else "" for at in cuts[:-1]]


def shard_of(digest, cuts: list[str]):
    """The shard of a digest: the first whose last prefix is not before it."""
    out = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        if cuts[k]:
            out = F.when(F.substring(digest, 1, len(cuts[k])) <= cuts[k], F.lit(k)).otherwise(out)
    return out


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0, without gaps in each shard)."""
    spark = docs.sparkSession
    home = shared_dir(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                F.sha2(text.cast("binary"), 256).alias("digest")).write.parquet(f"{home}/rows")
    rows = spark.read.parquet(f"{home}/rows")
    rows.groupBy("digest").agg(F.sum("size").alias("group_size")).write.parquet(f"{home}/groups")
    _, cuts = cut_points(spark.read.parquet(f"{home}/groups"), count)
    dealt = rows.select("doc_id", "size", "text_crc32", shard_of("digest", cuts).cast("int").alias("shard"),
                        F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLOT_PARTS)).alias("part"))
    # Rows are numbered within many small parts; the parts' counts, a bounded table, give where each one starts.
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS first")
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY doc_id, text_crc32) - 1 AS place")
    return (numbered.join(starts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot")))
