"""Near-duplicates by 64-bit SimHash fingerprints, compared bit plane by bit plane.

A fingerprint is split into six blocks.  At most four differing bits leave two blocks untouched, so every pair of
linked fingerprints meets in one of fifteen tables keyed by two blocks.  Inside a bucket the fingerprints stand as
64 bit planes; one fingerprint meets 64 others per machine word, a carry-save counter adds up differing bits, and a
word is abandoned once all its lanes are over the radius.  Buckets beyond ``CHUNK`` rows are dealt as pairs of chunks,
so no bucket is held by one task.  A task reports a forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import pick
from tessera.session import cut

SEED = 42
RADIUS = 4
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most rows of one bucket that meet in one task.
CHUNK = 4096
#: Words of 64 lanes compared at once; bounds a task's memory.
PANEL = 1 << 15
#: Planes after which abandoned words are dropped.
CHECKS = (16, 24, 32, 48)


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return run(text)


# ---- comparison inside sorted buckets ---------------------------------------------------------

def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) planes of 64 lanes each."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def close_pairs(values: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), first[i] <= j < last[i], at most ``radius`` (under 8) bits apart, panel by panel."""
    planes, full = bit_planes(values), np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.where((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), full, np.uint64(0))
    begin, n = first // 64, np.where(last > first, (last - 1) // 64 - first // 64 + 1, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PANEL, "right")) - 1)
        reps = n[at:to]
        q = np.repeat(np.arange(at, to), reps)
        w = np.arange(len(q)) - np.repeat(total[at:to] - total[at], reps) + begin[q]
        at = to
        if not len(q):
            continue
        low, high = np.clip(first[q] - w * 64, 0, 63).astype(np.uint64), np.clip(w * 64 + 64 - last[q], 0, 63).astype(np.uint64)
        over = ~((full << low) & (full >> high))  # lanes outside the range are over from the start
        ones, twos, fours = (np.zeros(len(q), np.uint64) for _ in range(3))
        for p in range(0, 64, 2):
            a, b = planes[p][w] ^ own[q, p], planes[p + 1][w] ^ own[q, p + 1]
            half = ones ^ a
            carry = (ones & a) | (half & b)
            ones = half ^ b
            carry2 = twos & carry
            twos = twos ^ carry
            over = over | (fours & carry2)
            fours = fours ^ carry2
            if p + 2 in CHECKS or p == 62:
                dead = over | beyond(ones, twos, fours, radius)
                live = dead != full
                if not live.all():
                    q, w, ones, twos, fours, over, dead = (x[live] for x in (q, w, ones, twos, fours, over, dead))
                if not len(q):
                    break
        if len(q):
            row, lane = np.nonzero(np.unpackbits((~dead).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], w[row] * 64 + lane


def beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is over the radius."""
    out = np.zeros_like(ones)
    equal = ~out
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= plane
        else:
            out |= equal & plane
            equal &= ~plane
    return out


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the trees of all pairs; ``root`` points at ever smaller positions."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root[:] = root[root]


def bucket_forest(group: np.ndarray, side: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and side; links inside groups as (value, smaller value)."""
    n = len(values)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    length = np.diff(edge)
    end = np.repeat(edge[1:], length)
    other = np.repeat(edge[:-1] + np.add.reduceat((side < 1).astype(np.int64), edge[:-1]), length)  # where side 1 begins
    first = np.where(side < 0, np.arange(n) + 1, other)
    last = np.where(side == 1, first, end)
    root = np.arange(n)
    for a, b in close_pairs(values, first, last, radius):
        join_roots(root, a, b)
    linked = np.flatnonzero(root != np.arange(n))
    return values[linked], values[root[linked]]


def links_of(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0

    def flush(f: pd.DataFrame) -> pd.DataFrame:
        key = pd.util.hash_array(f["key"].to_numpy()) ^ (pd.util.hash_array(f["pair"].to_numpy()) << np.uint64(1))
        a, b = bucket_forest(key, f["side"].to_numpy(), f["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < 1 << 15:
            continue
        f = pd.concat(held, ignore_index=True)
        tail = (f["key"] == f["key"].iloc[-1]) & (f["pair"] == f["pair"].iloc[-1])  # may go on in the next batch
        if not tail.all():
            yield flush(f[~tail])
        held = [f[tail]]
        size = int(tail.sum())
    if size:
        yield flush(pd.concat(held, ignore_index=True))


def near_links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``radius`` do; ``fps`` holds distinct ``fp``."""
    starts = np.concatenate([[0], np.cumsum(BLOCKS)])
    if radius > len(BLOCKS) - 2:
        raise ValueError("two of the blocks must stay untouched")
    part = lambda i: F.shiftrightunsigned(F.col("fp"), int(starts[i])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))
    tables = [(F.lit(t).cast("bigint") * (1 << 22) + part(i) * (1 << 11) + part(j)) for t, (i, j) in enumerate(combinations(range(6), 2))]
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(sizes, "key").withColumn("m", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int")
    low, high = (lambda x: F.least(F.col("mine"), x)), (lambda x: F.greatest(F.col("mine"), x))
    # side -1: all pairs of one chunk; 0 and 1: the two sides of a pair of chunks
    dealt = met.withColumn("mine", mine).select("key", "fp", "mine", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")).select(
        "key", (low(F.col("o")) * F.col("m").cast("bigint") + high(F.col("o"))).alias("pair"), "fp",
        F.when(F.col("mine") == F.col("o"), -1).when(F.col("mine") < F.col("o"), 0).otherwise(1).alias("side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "side")
    return ordered.mapInPandas(lambda it: links_of(it, radius), "a bigint, b bigint").distinct()


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root) for every linked fingerprint, by alternating large and small stars until nothing moves."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has plain shuffles on both sides and a node with very many links can be split
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, k2 (hash of the text), fp (signed), root (of its component), component_id.

    Null and empty texts have fingerprint zero and link like any other; rows that repeat a doc_id are kept apart by
    their fingerprints; a null doc_id takes part, and its component has the smallest id of the others (null if there
    is none).  An empty table gives an empty result.
    """
    base = cut(pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("k2"), fingerprint(F.col("text")).alias("fp")))
    firsts = base.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = smallest_reachable(near_links(firsts.select("fp"), radius))
    placed = firsts.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return base.join(placed.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "k2", "fp", "root", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component with all its columns: the smallest id, then the smallest hash of the text.

    Documents without an id stay only where no member has one; of rows that repeat id and text one stays.
    """
    found = near_duplicates(docs, radius)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "k2").alias("__g"), F.col("k2").alias("__k2"))).alias("h")
    heads = found.groupBy("root").agg(head).select("h.__g", "h.__k2")
    keyed = docs.withColumns({"__g": F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")), "__k2": F.xxhash64("text")})
    kept = keyed.join(heads, ["__g", "__k2"])
    alike = Window.partitionBy("__g", "__k2").orderBy(F.xxhash64(*[c for c, k in docs.dtypes if "map" not in k]))
    return kept.withColumn("__n", F.row_number().over(alike)).filter("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
