"""Best-fit packing of token pieces by bin completion with branch and bound.

Only counts of piece lengths, at most one per length up to the capacity, reach the planner; it returns patterns with
multiplicities.  Pieces are numbered within their length by slices and look their place up, so neither a hot length
nor all pieces meet in one task, and token ids are never shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from operator import neg

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import pick, tokenizer_path
from tessera.llm.tokens import Encoder
from tessera.operators.ordered import ordinal_in_slots
from tessera.session import cut

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Nodes of the branch and bound, each one filled sequence or a run of equal ones; then the best packing so far is taken.
NODES = 2000
#: Waste allowed to a filling, one run of bin completion for each.
SPARES = (0, 1, 2, 4, 8, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Fillings looked at per node before its branches end.
STEPS = 200
#: Parts of the packing that are taken back and packed anew, and sequences of such a part.
ROUNDS, PART = 24, 40
#: Documents that share a slice when pieces of one length are numbered.
SLICE = 8192

Pattern = tuple[int, tuple[tuple[int, int], ...]]


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)


def token_pieces(text: Column, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> Column:
    """(n, crcs): tokens of the text with the end mark, and the checksum of each piece's ids."""
    @F.pandas_udf("n bigint, crcs array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        enc, out = encoder(tokenizer_path(vocabulary), added=True), []
        mark = np.array([end], "<u4").tobytes()
        for t in texts:
            raw = memoryview(enc.raw(t or "") + mark)
            n = len(raw) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            out.append((n, [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])]))
        return pd.DataFrame(out, columns=["n", "crcs"])

    return run(text)


# ---- the plan over counts of lengths ----------------------------------------------------------

def best_fit(rest: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """The incumbent: always the largest piece that fits."""
    out = []
    for s in sizes:
        while s <= rest and left[s] > out.count(s):
            out.append(s)
            rest -= s
    return out


def reachable(rest: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """For each place in ``sizes`` (descending): the sums up to ``rest`` that pieces from there on can make, as bits."""
    mask, sums = (1 << rest + 1) - 1, 1
    out = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        n, step = min(left[s], rest // s), 1
        while n > 0:
            take = min(step, n)
            sums |= sums << s * take & mask
            n, step = n - take, 2 * step
        out[i] = sums
    return out


def fillings(rest: int, sizes: list[int], left: dict[int, int], spare: int, steps: int = STEPS) -> Iterator[list[int]]:
    """Fillings of ``rest`` that waste at most ``spare``, larger pieces first, until ``steps`` choices were looked at.

    Those that another filling dominates are left out: one with room for a further piece, one where a larger piece fits
    in the place of a piece, and one where a single piece can stand for two.
    """
    at = bisect_left(sizes, -rest, key=neg)
    sizes = sizes[at:]
    sums = reachable(rest, sizes, left)
    chosen: list[int] = []

    def undominated(waste: int) -> bool:
        free = lambda s: left[s] > chosen.count(s)
        if any(s <= waste and free(s) for s in sizes[-1:]) or waste and any(free(s) for s in sizes if s <= waste):
            return False
        for k, s in enumerate(chosen):
            i = bisect_left(sizes, -(s + waste), key=neg)
            if any(x > s and free(x) for x in sizes[i:bisect_left(sizes, -s, key=neg)]):
                return False
            if any(left.get(s + t, 0) > chosen.count(s + t) for t in chosen[k + 1:]):
                return False
        return True

    def descend(rest: int, i: int) -> Iterator[list[int]]:
        nonlocal steps
        steps -= 1
        if steps < 0:
            return
        low = max(0, rest - spare)
        if low == 0 and undominated(rest):
            yield list(chosen)
        while i < len(sizes) and rest > 0 and steps > 0:
            s = sizes[i]
            if s <= rest and left[s] > chosen.count(s):
                under = max(0, rest - s - spare)
                # the piece itself may come again, so sums from its own place count; a sum that needs more than are left ends without a filling
                if sums[i] >> under & (1 << rest - s - under + 1) - 1:
                    chosen.append(s)
                    yield from descend(rest - s, i)
                    chosen.pop()
            if not sums[i + 1] >> low & (1 << rest - low + 1) - 1:
                return
            i += 1

    yield from descend(rest, 0)


def completion(rest: int, sizes: list[int], left: dict[int, int], spare: int = 0) -> list[int]:
    """The filling of ``rest`` with the largest pieces among those that waste at most ``spare``, or else the least that is possible."""
    sizes = sizes[bisect_left(sizes, -rest, key=neg):]
    sums = reachable(rest, sizes, left)
    spare = max(spare, rest - (sums[0].bit_length() - 1))
    out: list[int] = []
    for i, s in enumerate(sizes):
        for n in range(min(left[s], rest // s), 0, -1):
            low = max(0, rest - n * s - spare)
            if sums[i + 1] >> low & (1 << rest - n * s - low + 1) - 1:
                out += [s] * n
                rest -= n * s
                break
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer: pieces over half stand alone, and smaller ones from k on fit only into the room that is left beside those up to capacity - k."""
    n, size = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
    for s, c in counts.items():
        n[s] = c
    best, large = 0, size * 2 > capacity
    for k in range(capacity // 2 + 1):
        alone, beside, small = size > capacity - k, large & (size <= capacity - k), ~large & (size >= k)
        room = n[beside].sum() * capacity - (n * size)[beside].sum()
        best = max(best, int(n[alone].sum() + n[beside].sum() + max(0, -(-int((n * size)[small].sum() - room) // capacity))))
    return best


def pack_counts(counts: dict[int, int], capacity: int, filling, below: float = float("inf")) -> tuple[list[Pattern], int] | None:
    """Patterns and their number of sequences; None as soon as the waste so far allows no fewer than ``below``."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left, reverse=True)
    room = capacity * (below - 1) - sum(s * n for s, n in left.items())  # waste that a better packing may have
    out: list[Pattern] = []
    bins = 0
    while sizes:
        large = sizes[0]
        left[large] -= 1
        fill = [large, *filling(capacity - large, sizes, left)]
        left[large] += 1
        need = {s: fill.count(s) for s in fill}
        times = min(left[s] // c for s, c in need.items())
        room -= times * (capacity - sum(fill))
        if room < 0:
            return None
        out.append((times, tuple(sorted(need.items(), reverse=True))))
        bins += times
        for s, c in need.items():
            left[s] -= c * times
        sizes = [s for s in sizes if left[s]]
    return out, bins


def branch(counts: dict[int, int], capacity: int, best: int, bound: int, nodes: int) -> tuple[list[Pattern], int] | None:
    """Bin completion depth first: a packing in fewer sequences than ``best``, the least found within ``nodes`` nodes.

    A node fills the largest piece left; its branches are the undominated fillings, each used as often as counts and
    waste allow.  A branch ends when its waste, or its pieces over half, leave no packing below the incumbent, or when
    the same pieces were left before with no more waste.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    total, found = sum(s * n for s, n in left.items()), None
    seen: dict[tuple[int, ...], int] = {}
    order = sorted(left, reverse=True)
    chosen: list[Pattern] = []
    waste = bins = 0
    open_: list[Iterator[list[int]]] = []

    def enter() -> bool:
        """Opens the node of what is left; False if it cannot be better."""
        nonlocal nodes, found, best
        sizes = [s for s in order if left[s]]
        if not sizes:
            found, best = (list(chosen), bins), bins
            return False
        room = capacity * (best - 1) - total - waste
        key = tuple(left[s] for s in order)
        halves = sum(left[s] for s in sizes if 2 * s > capacity)
        if nodes <= 0 or room < 0 or bins + halves >= best or seen.get(key, waste + 1) <= waste:
            return False
        nodes -= 1
        seen[key] = waste
        large = sizes[0]
        left[large] -= 1
        near = [completion(capacity - large, sizes, left)]
        left[large] += 1
        open_.append(iter(branches(large, sizes, room, near)))
        return True

    def branches(large: int, sizes: list[int], room: int, near: list[list[int]]) -> Iterator[list[int]]:
        """The filling with the least waste first, then all others."""
        for fill in near:
            if capacity - large - sum(fill) <= room:
                yield fill
        left[large] -= 1
        rest = fillings(capacity - large, sizes, left, min(room, capacity - large))
        while True:
            fill = next(rest, None)
            left[large] += 1
            if fill is None:
                return
            if fill not in near:
                yield fill
            left[large] -= 1

    def undo() -> None:
        nonlocal waste, bins
        times, need = chosen.pop()
        bins -= times
        waste -= times * (capacity - sum(s * c for s, c in need))
        for s, c in need:
            left[s] += times * c

    enter()
    while open_ and best > bound:
        fill = next(open_[-1], None) if nodes > 0 else None
        if fill is None:
            open_.pop()
            if chosen:
                undo()
            continue
        large = next(s for s in order if left[s])
        need: dict[int, int] = {}
        for s in [large, *fill]:
            need[s] = need.get(s, 0) + 1
        lost = capacity - large - sum(fill)
        room = capacity * (best - 1) - total - waste
        if lost > room:
            continue
        times = min([left[s] // c for s, c in need.items()] + ([room // lost] if lost else []))
        for s, c in need.items():
            left[s] -= times * c
        waste, bins = waste + times * lost, bins + times
        chosen.append((times, tuple(sorted(need.items(), reverse=True))))
        if not enter():
            undo()
    return found


def completed(counts: dict[int, int], capacity: int, bound: int, spares: tuple[int, ...]) -> tuple[list[Pattern], int]:
    """The better of best fit and bin completion without branches, with some waste allowed to a single filling."""
    best, bins = pack_counts(counts, capacity, best_fit)
    for spare in spares:
        if bins <= bound:
            break
        better = pack_counts(counts, capacity, lambda r, s, l: completion(r, s, l, spare), bins)
        if better and better[1] < bins:
            best, bins = better
    return best, bins


def taken_back(patterns: list[Pattern], capacity: int, part: int, turn: int) -> tuple[list[Pattern], list[Pattern]]:
    """``part`` sequences, half of them those with most waste, the others dealt by ``turn``; and the rest of the packing."""
    waste = lambda p: capacity - sum(s * c for s, c in p[1])
    by_waste = sorted(range(len(patterns)), key=lambda i: -waste(patterns[i]))
    mixed = sorted(range(len(patterns)), key=lambda i: ((i + 1) * 2654435761 * (2 * turn + 1)) % 4294967296)
    taken: dict[int, int] = {}
    for order, most in ((by_waste, part // 2), (mixed, part)):
        for i in order:
            room = most - sum(taken.values())
            free = patterns[i][0] - taken.get(i, 0)
            if room > 0 and free and (most == part or waste(patterns[i])):
                taken[i] = taken.get(i, 0) + min(free, room, 1 + part // 8)
    rest = [(t - taken.get(i, 0), need) for i, (t, need) in enumerate(patterns) if t > taken.get(i, 0)]
    return [(n, patterns[i][1]) for i, n in taken.items()], rest


def repacked(patterns: list[Pattern], bins: int, capacity: int, bound: int, spares: tuple[int, ...], nodes: int, rounds: int, part: int) -> list[Pattern]:
    """Takes parts of a packing back and packs each anew with branch and bound, until the bound or ``rounds``."""
    for turn in range(rounds):
        if bins <= bound:
            break
        own, rest = taken_back(patterns, capacity, part, turn)
        counts: dict[int, int] = {}
        for times, need in own:
            for s, c in need:
                counts[s] = counts.get(s, 0) + times * c
        n = sum(t for t, _ in own)
        low = lower_bound(counts, capacity)
        if low >= n:
            continue
        new, m = completed(counts, capacity, low, spares)
        if m >= n:
            new, m = branch(counts, capacity, n, low, nodes) or (new, m)
        if m < n:
            patterns, bins = rest + new, bins - n + m
    return patterns


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY, spares: tuple[int, ...] = SPARES, nodes: int = NODES, rounds: int = ROUNDS, part: int = PART) -> list[Pattern]:
    """Patterns (multiplicity, ((length, count), ...)) that hold all pieces in as few sequences as were found.

    Best fit and bin completion without branches give the incumbents, branch and bound looks for fewer, and parts of the
    packing are then taken back and packed anew.  All end at the lower bound.
    """
    bound = lower_bound(counts, capacity)
    best, bins = completed(counts, capacity, bound, spares)
    if bins > bound:
        best, bins = branch(counts, capacity, bins, bound, nodes) or (best, bins)
    return repacked(best, bins, capacity, bound, spares, nodes // 10, rounds, part)


def places(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted (length, first ordinal) codes with (sequence, per sequence, offset, first ordinal) rows, and the number of sequences."""
    used: dict[int, int] = {}
    code, rows, sequence = [], [], 0
    for times, need in patterns:
        offset = 0
        for size, c in need:
            code.append((size << 44) + used.get(size, 0))
            rows.append((sequence, c, offset, used.get(size, 0)))
            used[size] = used.get(size, 0) + c * times
            offset += size * c
        sequence += times
    order = np.argsort(np.array(code, np.int64), kind="stable")
    return np.array(code, np.int64)[order], np.array(rows, np.int64).reshape(-1, 4)[order], sequence


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end mark alone; rows that repeat each other, or an id, are packed as
    documents of their own; a null doc_id stays null; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    base = cut(rows.select("doc_id", token_pieces(F.col("text"), vocabulary, capacity, end).alias("t")).select(
        "doc_id", "t.n", "t.crcs", F.pmod("t.n", F.lit(capacity)).cast("int").alias("r")))
    counts = base.groupBy("r").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).collect()  # at most one row per length below the capacity
    patterns = plan_patterns({x["r"]: x["c"] for x in counts if x["r"]}, capacity)
    code, place, sequences = places(patterns)
    slices = max(1, -(-sum(x["c"] for x in counts) // SLICE))
    longest = max([x["n"] // capacity + 1 for x in counts], default=1)
    mixed = F.xxhash64("doc_id", "n", "crcs")
    numbered = ordinal_in_slots(base.withColumn("h", mixed).withColumn("slot", F.pmod("h", F.lit(slices))), ["r"], ["slot"], ["h", "doc_id"], "k")

    @F.pandas_udf("sequence_id bigint, at bigint")
    def look_up(r: pd.Series, k: pd.Series) -> pd.DataFrame:
        size, nth = r.to_numpy(np.int64), k.to_numpy(np.int64)
        if not len(code):
            return pd.DataFrame({"sequence_id": nth * 0, "at": nth * 0})
        found = place[np.clip(np.searchsorted(code, (size << 44) + nth, "right") - 1, 0, None)]
        step = nth - found[:, 3]
        return pd.DataFrame({"sequence_id": found[:, 0] + step // found[:, 1], "at": found[:, 2] + step % found[:, 1] * size})

    put = numbered.withColumn("p", look_up(F.col("r").cast("bigint"), F.col("k").cast("bigint")))
    pieces = put.select("doc_id", "n", "r", "k", "p", F.posexplode("crcs").alias("piece", "ids_crc32"))
    partial = (F.col("piece") == 0) & (F.col("r") > 0)
    first = F.when(F.col("r") > 0, F.col("r") - capacity).otherwise(0).cast("bigint")
    whole = F.lit(sequences) + (F.col("k").cast("bigint") * capacity + F.col("r")) * longest + F.col("piece")  # a sequence of its own
    return pieces.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") == 0, 0).otherwise(F.col("piece") * capacity + first).cast("bigint").alias("start"),
        F.when(partial, F.col("r")).otherwise(capacity).cast("bigint").alias("length"), F.col("ids_crc32").cast("bigint").alias("ids_crc32"),
        F.when(partial, F.col("p.sequence_id")).otherwise(whole).cast("bigint").alias("sequence_id"),
        F.when(partial, F.col("p.at")).otherwise(0).cast("bigint").alias("offset"))
