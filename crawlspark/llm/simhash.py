"""SimHash near-duplicates by a grid join over per-segment bit counts.

A fingerprint becomes 32 counts of ones, one for each segment of two bits. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so it is a lower bound. The vectors are cut into blocks, more of
them the more fingerprints there are, so that the expected size of the fullest cell stays below a bound; two of them at Manhattan distance ``bits`` or less agree wholly on at least ``blocks - bits`` blocks, so each pair meets in
a grid cell named by such a set of blocks and their counts. In a cell the Manhattan distance discards, and the Hamming
distance of the fingerprints decides: no link is missed and none is wrong.

Equal fingerprints are one point, and a cell links its points by the edges of a search that removes each point it
reaches. So a group of thousands of near copies costs about its size, not its square.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows and equal
doc_ids stay as rows of their own; a null doc_id is never a component's id (null where no member has one); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import per_text

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
CELL_POINTS, MOST_BLOCKS = 4096, 10
HOT_SHARE = 1000  # a fingerprint with more than this part of all rows is hot: there are fewer of them than this
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
SMALL_CELL = 48


def fingerprint(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero without words."""
    words = text.lower().split()  # bytes: only A-Z changes, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    if len(words) > width:
        starts, stops = starts[: len(words) - width + 1], stops[width - 1:]
    else:
        starts, stops = [0], [len(joined)]
    ones = np.zeros(64, dtype=np.int64)
    one = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 16):
        hashes = [one(joined[a:b], seed) for a, b in zip(starts[i:i + (1 << 16)], stops[i:i + (1 << 16)])]
        rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    return per_text(docs, "fp long", lambda: lambda texts: [[fingerprint(t) for t in texts]])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks over the packed counts, one for each set of ``blocks - bits`` blocks."""
    if not bits < blocks <= SEGMENTS:
        raise ValueError(f"blocks must be from {bits + 1} to {SEGMENTS}")
    cuts = [2 * (SEGMENTS * i // blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [signed(sum(chosen)) for chosen in combinations(parts, blocks - bits)]


def blocks_for(points: int, bits: int = MAX_BITS, most: int = MOST_BLOCKS) -> int:
    """The fewest blocks with which the fullest cell holds about ``CELL_POINTS`` of so many fingerprints.

    A segment's likeliest count is one, of half the fingerprints, so cells that agree on m segments hold up to 2^-m.
    Any number of blocks finds the same links; more of them mean smaller cells and more keys (15 for 6, 210 for 10).
    """
    for blocks in range(bits + 2, most):
        widths = sorted(SEGMENTS * (i + 1) // blocks - SEGMENTS * i // blocks for i in range(blocks))
        if points >> sum(widths[: blocks - bits]) < CELL_POINTS:
            return blocks
    return most


def counts_column(fp):
    """The segment counts packed into a long, each in unary (00, 01, 11): their XOR's ones are the Manhattan distance."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def counts_array(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(LOW_BITS), (fp >> np.uint64(1)) & np.uint64(LOW_BITS)
    return low | high | ((low & high) << np.uint64(1))


def close(fp: np.ndarray, counts: np.ndarray, i, j, bits: int) -> np.ndarray:
    """For index pairs: the lower bound first, then the exact distance."""
    near = np.bitwise_count(counts[i] ^ counts[j]) <= bits
    near[near] = np.bitwise_count((fp[i] ^ fp[j])[near]) <= bits
    return near


def cell_forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the points of one cell; each point reached leaves the rest."""
    counts, left, heads, tails = counts_array(fp), np.arange(len(fp)), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = close(fp, counts, left, np.full(len(left), i), bits)
            if hit.any():
                found = left[hit]
                heads.append(np.full(len(found), i))
                tails.append(found)
                queue.extend(found.tolist())
                left = left[~hit]
        queue = queue if len(left) else []
    if not heads:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(heads), np.concatenate(tails)


def links_of_runs(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal cells: small cells all at once, large ones by their forest."""
    counts, out = counts_array(fp), []
    small = (sizes > 1) & (sizes <= SMALL_CELL)
    first, size = starts[small], sizes[small]
    for step in range(1, SMALL_CELL):
        first, size = first[size > step], size[size > step]
        if not len(first):
            break
        each = size - step
        i = np.repeat(first - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        hit = close(fp, counts, i, i + step, bits)
        out.append((fp[i[hit]], fp[i[hit] + step]))
    for a, n in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        i, j = cell_forest(fp[a:a + n], bits)
        out.append((fp[a + i], fp[a + j]))
    return out


def fingerprint_links(points: DataFrame, bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """Links a, b between distinct fingerprints (column ``fp``) whose closure is that of all pairs within ``bits``.

    ``blocks`` is by default what the number of fingerprints asks for.
    """
    masks = block_masks(bits, blocks or blocks_for(points.count(), bits))
    keys = F.array(*[counts_column(F.col("fp")).bitwiseAND(F.lit(m)) for m in masks])
    cells = points.select("fp", F.posexplode(keys).alias("part", "cell"))
    dealt = cells.repartition("part", "cell").sortWithinPartitions("part", "cell", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches):
        def done(part, cell, fp):
            cut = np.flatnonzero((part[1:] != part[:-1]) | (cell[1:] != cell[:-1])) + 1
            starts = np.concatenate(([0], cut))
            found = links_of_runs(fp, starts, np.diff(np.concatenate((starts, [len(fp)]))), bits)
            a = np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)]).view(np.int64)
            b = np.concatenate([y for _, y in found] or [np.empty(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

        held: list[tuple] = []  # the batches of the cell that is not complete yet
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, part, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            fp = fp.view(np.uint64)
            other = np.flatnonzero((part != part[-1]) | (cell != cell[-1]))
            tail = int(other[-1]) + 1 if len(other) else 0
            if held and (held[0][0][0], held[0][1][0]) != (part[0], cell[0]) or held and tail:
                whole = (part[0], cell[0]) == (held[0][0][0], held[0][1][0])
                if whole:
                    held.append((part[:tail], cell[:tail], fp[:tail]))
                    yield done(*map(np.concatenate, zip(*held)))
                    held, part, cell, fp, tail = [], part[tail:], cell[tail:], fp[tail:], 0
                else:
                    yield done(*map(np.concatenate, zip(*held)))
                    held = []
            if tail:
                yield done(part[:tail], cell[:tail], fp[:tail])
                part, cell, fp = part[tail:], cell[tail:], fp[tail:]
            held.append((part, cell, fp))
        if held:
            yield done(*map(np.concatenate, zip(*held)))

    return dealt.mapInArrow(link, "a long, b long").distinct()


def components(links: DataFrame, home: str) -> DataFrame:
    """node and root, the smallest node reachable, for every node that has a link.

    Each round takes the smallest label of the neighbours and then the label of one's label; its labels are written to
    ``home``, so that no round depends on an executor of an earlier one.
    """
    spark = links.sparkSession
    links.write.parquet(f"{home}/links")
    links = spark.read.parquet(f"{home}/links")
    both = links.union(links.select("b", "a"))
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    for turn in range(1, 1000):
        hop = (both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
               .agg(F.min("root").alias("m")))
        new = label.join(hop, "node").select("node", F.least("root", "m").alias("near"), F.col("root").alias("old"))
        jump = new.join(new.select(F.col("node").alias("near"), F.col("near").alias("root")), "near").select("node", "root", "old")
        jump.write.parquet(f"{home}/labels-{turn}")
        written = spark.read.parquet(f"{home}/labels-{turn}")
        label = written.select("node", "root")
        if written.filter("root <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of ``bits`` or fewer differing bits)."""
    spark = docs.sparkSession
    home = shared_dir(spark, "simhash")
    fingerprints(docs).write.parquet(f"{home}/fingerprints")
    rows = spark.read.parquet(f"{home}/fingerprints")
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = components(fingerprint_links(points.select("fp"), bits, blocks), home)
    linked = points.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "root").select("fp", "least_id")
    (points.join(named, "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id"))
     .write.parquet(f"{home}/classes"))
    classes = spark.read.parquet(f"{home}/classes")
    # Rows of a hot fingerprint meet its class where they are; fewer than HOT_SHARE fingerprints can be hot.
    total = classes.agg(F.sum("n").alias("n")).first().n or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(classes.filter(is_hot).drop("n"))
    columns = ("doc_id", "fp", "component_id")
    rest = rows.join(hot, "fp", "left_anti").join(classes.filter(~is_hot), "fp")
    return rows.join(hot, "fp").select(*columns).unionByName(rest.select(*columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, all columns as they are.

    It is the row of the smallest doc_id, rows without one last, then of the smallest digest of the text; of rows that
    share both one stays. So rows that share a doc_id but not a group are a document each, and no group loses all its rows.
    """
    spark = docs.sparkSession
    home = shared_dir(spark, "simhash-one")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    (per_text(keyed, "fp long", lambda: lambda texts: [[fingerprint(t) for t in texts]], keep=("doc_id", "digest"))
     .write.parquet(f"{home}/fingerprints"))
    rows = spark.read.parquet(f"{home}/fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    points = rows.groupBy("fp").agg(first)
    roots = components(fingerprint_links(points.select("fp")), home).withColumnRenamed("node", "fp")
    groups = points.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    groups.select(F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest")).write.parquet(f"{home}/firsts")
    firsts = spark.read.parquet(f"{home}/firsts")

    def chosen(rows: DataFrame, digest) -> DataFrame:
        return rows.join(firsts, rows["doc_id"].eqNullSafe(firsts["first_id"]) & (digest == firsts["first_digest"]), "left_semi")

    kept = chosen(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    repeated = chosen(rows, rows["digest"]).groupBy("doc_id", "digest").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
