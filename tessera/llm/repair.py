"""Repair of conversation structure by Viterbi with survivor coalescence.

The rows of a conversation, in the order of their turns, are written as sorted blocks of bounded size.  One task per
block finds the cheapest edits from every state that may enter it to every state that may leave it; a second pass walks
the blocks of a conversation in order.  Both use one backpointer tree: nodes count their references, a path that no
state survives on is released, and edits leave the tree as soon as all survivors share them.  Equal costs are settled by
comparing the whole unresolved suffixes.  So no task holds a conversation, however long, but for edits that stay open.

States of the target ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import pick
from tessera.session import scratch_path

#: Rows of a block.
BLOCK = 128
#: Rows that one task sorts.
PART_ROWS = 100_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES, ENDS = (0, 1, 2, 3), (0, 3)
#: The role that may come next: the only one that a rerole or an insertion can give.
NEXT = ("user", "user", "assistant", "user")
AFTER = {"user": 2, "assistant": 3}
#: Where a kept role leads: (state, initial) -> state.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"


class Node:
    """One edit, or the edits of one block; ``jump`` leads to some ancestor, so that any is reached in a few steps."""

    __slots__ = ("parent", "piece", "tag", "depth", "jump", "refs")

    def __init__(self, parent: "Node | None", piece: str = "", tag: object = None):
        self.parent, self.piece, self.tag, self.refs = parent, piece, tag, 0
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = parent.depth + 1, parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent
            parent.refs += 1

    def ancestor(self, depth: int) -> "Node":
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node


def pieces(node: Node, top: Node, more: str) -> Iterator[str]:
    for depth in range(top.depth + 1, node.depth + 1):
        yield node.ancestor(depth).piece
    yield more


def before(a: Node, x: str, b: Node, y: str) -> bool:
    """Whether the path to ``a`` followed by ``x`` is less than the path to ``b`` followed by ``y``; only what they do not share is read."""
    low = min(a.depth, b.depth)
    p, q = a.ancestor(low), b.ancestor(low)
    while p is not q:
        p, q = (p.jump, q.jump) if p.jump is not q.jump else (p.parent, q.parent)
    left, right, s, t = pieces(a, p, x), pieces(b, p, y), "", ""
    while True:
        while not s:
            s = next(left, None)
            if s is None:
                return bool(t) or any(right)
        while not t:
            t = next(right, None)
            if t is None:
                return False
        n = min(len(s), len(t))
        if s[:n] != t[:n]:
            return s[:n] < t[:n]
        s, t = s[n:], t[n:]


class Survivors:
    """The cheapest path to each state."""

    def __init__(self, state: int):
        self.root = Node(None)
        self.best: dict[int, tuple[int, Node]] = {state: (0, self.root)}
        self.root.refs = 1

    def release(self, node: Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            node = node.parent
            node.refs -= 1

    def step(self, moves: list[tuple[int, int, int, str, object]]) -> None:
        """Replaces all survivors by the best of ``moves``: (from, to, cost, piece, tag)."""
        won: dict[int, tuple] = {}
        for start, to, cost, piece, tag in moves:
            if start in self.best:
                had, node = self.best[start]
                old = won.get(to)
                if old is None or had + cost < old[0] or had + cost == old[0] and before(node, piece, old[1], old[2]):
                    won[to] = (had + cost, node, piece, tag)
        past, self.best = self.best, {}
        for to, (cost, node, piece, tag) in won.items():
            self.best[to] = (cost, Node(node, piece, tag))
            self.best[to][1].refs = 1
        for _, node in past.values():
            self.release(node)
        self.drop_beaten()

    def insert(self) -> None:
        """Insertions after the rows so far, until none helps."""
        todo = list(self.best)
        while todo:
            start = todo.pop()
            cost, node = self.best[start]
            to = AFTER[NEXT[start]]
            old = self.best.get(to)
            if old is None or cost + INSERT < old[0] or cost + INSERT == old[0] and before(node, "I", old[1], ""):
                self.best[to] = (cost + INSERT, Node(node, "I"))
                self.best[to][1].refs = 1
                todo.append(to)
                if old:
                    self.release(old[1])
        self.drop_beaten()

    def drop_beaten(self) -> None:
        """Ends survivors that cannot win: whatever follows 0 or 1 can follow 3 (or 2 after an insertion), an s that 0 would keep deleted."""
        for state, extra in ((0, DELETE), (1, 0)):
            rivals = [self.best[s][0] + more for s, more in ((3, extra), (2, extra + INSERT)) if s in self.best]
            if state in self.best and rivals and min(rivals) < self.best[state][0]:
                self.release(self.best.pop(state)[1])

    def settled(self) -> Iterator[Node]:
        """Nodes that all survivors share leave the tree, oldest first."""
        any_one = next((n for _, n in self.best.values()), self.root)
        while self.root.refs == 1 and any_one is not self.root:
            self.root = any_one.ancestor(self.root.depth + 1)
            self.root.parent = None
            yield self.root

    def rest(self, state: int) -> list[Node]:
        """The unresolved nodes on the path to a state."""
        out, node = [], self.best[state][1]
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]


def row_moves(initial: str, fault: str) -> list[tuple[int, int, int, str, object]]:
    """What may be done with one row in every state; a blank or duplicate row can only be deleted."""
    out = [(s, s, DELETE, "D", None) for s in STATES]
    if fault in "bd":
        return out
    more = TRUNCATED if fault == "t" else 0
    out += [(s, to, KEEP + more, "K", None) for (s, i), to in KEPT.items() if i == initial]
    return out + [(s, AFTER[NEXT[s]], REROLE + more, "R", None) for s in STATES]


MOVES = {i + f: row_moves(i, f) for i in "suax" for f in ".bdt"}


def crossings(initials: str, faults: str, start: int, first: bool) -> list[tuple[int, str] | None]:
    """Cheapest (cost, edits) from ``start`` before a block to each state after it; None where there is no way."""
    tree, out = Survivors(start), []
    if first:
        tree.insert()
    for code in zip(initials, faults):
        tree.step(MOVES["".join(code)])
        tree.insert()
        out += [n.piece for n in tree.settled()]
    done = "".join(out)
    return [(tree.best[s][0], done + "".join(n.piece for n in tree.rest(s))) if s in tree.best else None for s in STATES]


# ---- blocks -----------------------------------------------------------------------------------

KEY = ["none", "c"]
BLOCKS = "none boolean, c bigint, b bigint, turns array<bigint>, roles array<string>, texts array<string>"


def cut_blocks(size: int):
    """Sorted rows to one row per (conversation, ``size`` places); rows of an open block wait for the next batch."""
    def close(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        rows = rows.combine_chunks()
        none, c, b = (rows.column(k).to_numpy() for k in ("none", "c", "b"))
        new = np.flatnonzero((none[1:] != none[:-1]) | (c[1:] != c[:-1]) | (b[1:] != b[:-1])) + 1
        starts = np.concatenate([[0], new]) if len(b) else new
        stop = len(b) if last else int(starts[-1]) if len(starts) else 0
        starts = starts[starts < stop]
        if not len(starts):
            return None, rows
        offsets = pa.array(np.append(starts, stop), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(k).slice(0, stop).combine_chunks()) for k in ("turn", "role", "text")]
        return pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in (none, c, b)] + lists, ["none", "c", "b", "turns", "roles", "texts"]), rows.slice(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            out, held = close(held, False)
            if out is not None:
                yield out
        if held is not None and held.num_rows:
            yield close(held, True)[0]

    return run


def keyed(conv: DataFrame) -> DataFrame:
    """Rows under a key that is never null, a null role or text as one space."""
    rows = pick(conv, conv_id="bigint", turn="bigint", role="string", text="string")
    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    return rows.select(F.isnull("conv_id").alias("none"), F.coalesce("conv_id", F.lit(0)).alias("c"), "turn", space("role"), space("text"))


def blocks(conv: DataFrame, size: int = BLOCK) -> DataFrame:
    """Sorted blocks of every conversation, written: by turn (nulls first), then role, then text.

    Ranges are cut by all columns and by the part a row comes from, so neither a long conversation nor a row that
    repeats very often is one task's.
    """
    rows = keyed(conv).withColumn("part", F.spark_partition_id())
    spark = conv.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    order = ["none", "c", "turn", "role", "text"]
    placed = rows.repartitionByRange(parts, *order, "part").sortWithinPartitions(*order).withColumn("b", F.floor(F.monotonically_increasing_id() / size))
    path = scratch_path(spark, "blocks")
    placed.select("none", "c", "b", "turn", "role", "text").mapInArrow(cut_blocks(size), BLOCKS).write.parquet(path)
    return spark.read.parquet(path)


def coded(found: DataFrame) -> DataFrame:
    """Per block: initials (s, u, a or x) and faults (b blank, d duplicate, t truncated, else a dot) as one letter per row."""
    marks = F.transform(F.arrays_zip("roles", "texts"), lambda z: F.md5(F.concat(F.length(z["roles"]).cast("string"), F.lit(":"), z["roles"], z["texts"]).cast("binary")))
    each = found.select(*KEY, "b", F.posexplode(marks).alias("i", "m"))
    firsts = each.groupBy(*KEY, "m").agg(F.min(F.struct("b", "i")).alias("at")).groupBy(*KEY, F.col("at.b").alias("b")).agg(F.collect_set("at.i").alias("firsts"))
    initial = lambda r: F.when(r.substr(1, 1).isin("s", "u", "a"), r.substr(1, 1)).otherwise("x")
    last = lambda t: F.right(F.rtrim(t, F.lit(WHITE)), F.lit(1))
    fault = lambda t: F.when(last(t) == "", "b").when(last(t).isin(".", "!", "?"), ".").otherwise("t")
    own = found.select(*KEY, "b", F.array_join(F.transform("roles", initial), "").alias("initials"), F.transform("texts", fault).alias("f"))
    seen = own.join(firsts, [*KEY, "b"], "left")
    known = lambda f, i: F.when((f != "b") & ~F.coalesce(F.array_contains("firsts", i), F.lit(False)), "d").otherwise(f)
    return seen.select(*KEY, "b", "initials", F.array_join(F.transform("f", known), "").alias("faults"))


def crossed(codes: DataFrame) -> DataFrame:
    """Adds costs and paths of a block: 4 x 4 entries by entering, then leaving state; the first block is entered in state 0 only."""
    @F.pandas_udf("costs array<bigint>, paths array<string>")
    def run(initials: pd.Series, faults: pd.Series, first: pd.Series) -> pd.DataFrame:
        out = []
        for i, f, head in zip(initials, faults, first):
            found = [x for s in STATES for x in (crossings(i, f, s, bool(head)) if s == 0 or not head else [None] * len(STATES))]
            out.append(([None if x is None else x[0] for x in found], [None if x is None else x[1] for x in found]))
        return pd.DataFrame({"costs": pd.Series([x[0] for x in out], dtype=object), "paths": pd.Series([x[1] for x in out], dtype=object)})

    heads = codes.groupBy(*KEY).agg(F.min("b").alias("head"))
    known = codes.join(heads, KEY).select(*codes.columns, (F.col("b") == F.col("head")).alias("first"))
    return known.withColumn("x", run("initials", "faults", "first")).select(*KEY, "b", "initials", "x.costs", "x.paths")


CHAIN = "none boolean, c bigint, b bigint, start int, audit string, cost bigint, illegal bigint"


def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chosen edits of every block; blocks come sorted by conversation and place."""
    key, tree, last, out = None, None, "", []

    def put(node: Node) -> None:
        b, start, cost, illegal = node.tag
        out.append((*key, b, start, node.piece, cost, illegal))

    def close() -> None:
        (cost, node), state = min(((tree.best[s], s) for s in ENDS if s in tree.best), key=lambda x: x[0][0])
        for other in ENDS:
            if other != state and other in tree.best and tree.best[other][0] == cost and before(tree.best[other][1], "", node, ""):
                state, node = other, tree.best[other][1]
        for n in tree.rest(state):
            put(n)

    for batch in batches:
        for none, c, b, initials, costs, paths in batch.itertuples(index=False):
            if (none, c) != key:
                if key is not None:
                    close()
                key, tree, last = (none, c), Survivors(0), ""
            row = last + initials
            illegal = sum(row[i:i + 2] not in LEGAL for i in range(len(row) - 1))
            last = initials[-1:]
            crossing = [(i, s, p) for i, (s, p) in enumerate(zip(costs, paths)) if p is not None]
            tree.step([(i // 4, i % 4, int(s), p, (b, i // 4, int(s), illegal)) for i, s, p in crossing])
            for n in tree.settled():
                put(n)
        if out:
            yield pd.DataFrame(out, columns=["none", "c", "b", "start", "audit", "cost", "illegal"])
            out.clear()
    if key is not None:
        close()
        yield pd.DataFrame(out, columns=["none", "c", "b", "start", "audit", "cost", "illegal"])


STEPS = "array<struct<edit:string,i:int,role:string>>"


def edit_steps(start: Column, audit: Column, initials: Column) -> Column:
    """Each edit with the row it takes (none for an insertion) and the role it gives (none if the row keeps its own)."""
    @F.pandas_udf(STEPS)
    def run(start: pd.Series, audit: pd.Series, initials: pd.Series) -> pd.Series:
        out = []
        for state, edits, own in zip(start, audit, initials):
            at, steps = 0, []
            for e in edits:
                role = NEXT[state] if e in "IR" else None
                steps.append({"edit": e, "i": None if e == "I" else at, "role": role})
                if e != "D":
                    state = AFTER[role] if role else KEPT[state, own[at]]
                at += e != "I"
            out.append(steps)
        return pd.Series(out, dtype=object)

    return run(start, audit, initials)


def repair(conv: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: none, c (the conversation), b, faults, audit, cost, illegal, turns, edits (edit, turn, role, text).

    Rows are taken by turn, nulls first, then by role and text; a null role or text counts as one space, a null conv_id
    is a conversation of its own; rows that repeat each other are duplicates but for the first; extra columns are left
    out; an empty table gives an empty result.  Edits are the cheapest: Keep 0, Rerole to user or assistant 1, Delete 2
    (required for blank and duplicate rows), Insert an empty user or assistant row 5, a truncated row that stays 5 more;
    the roles' initials then match ``(s?(ua)+)?``, and of equal costs the least audit is taken.
    """
    held = blocks(conv, size)
    codes = coded(held)
    spark, path = conv.sparkSession, scratch_path(conv.sparkSession, "codes")
    codes.write.parquet(path)  # small: two letters a row
    codes = spark.read.parquet(path)
    ways = crossed(codes).repartition(*KEY).sortWithinPartitions(*KEY, "b")
    chosen = ways.mapInPandas(chained, CHAIN).join(codes, [*KEY, "b"]).withColumn("steps", edit_steps(F.col("start"), F.col("audit"), F.col("initials")))
    done = held.join(chosen.select(*KEY, "b", "faults", "audit", "cost", "illegal", "steps"), [*KEY, "b"])
    text = lambda s: F.when(s["i"].isNull(), "").otherwise(F.get("texts", s["i"]))
    edit = lambda s: F.struct(s["edit"].alias("edit"), F.get("turns", s["i"]).alias("turn"), F.coalesce(s["role"], F.get("roles", s["i"])).alias("role"), text(s).alias("text"))
    return done.select(*KEY, "b", "faults", "audit", "cost", "illegal", "turns", F.transform("steps", edit).alias("edits"))


def repaired(conv: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (grows along the conversation), turn (null if inserted), edit, role, text."""
    e = repair(conv).select("none", "c", "b", F.posexplode("edits").alias("k", "e")).filter("e.edit <> 'D'")
    return e.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), F.struct("b", "k").alias("place"), "e.turn", "e.edit", "e.role", "e.text")


# ---- the query --------------------------------------------------------------------------------

def damaged(conv: DataFrame) -> DataFrame:
    """The rows of the query: by the checksum of conversation and turn some are dropped, emptied, cut, repeated or given another role."""
    rows = pick(conv, conv_id="bigint", turn="bigint", role="string", text="string")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("d", F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).filter("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(word("role"))
    times = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and checksum of the repaired text of each conversation, block by block."""
    key, audit, sha, lines = None, [], None, 0
    row = lambda: pd.DataFrame([(*key, "".join(audit), sha.hexdigest())], columns=["none", "c", "audit", "repaired_sha256"])
    for batch in batches:
        for none, c, part, n, body in batch.itertuples(index=False):
            if (none, c) != key:
                if key is not None:
                    yield row()
                key, audit, sha, lines = (none, c), [], hashlib.sha256(), 0
            audit.append(part)
            if n:
                sha.update((("\n" if lines else "") + body).encode())
                lines += n
    if key is not None:
        yield row()


def digest(done: DataFrame, conv: DataFrame) -> DataFrame:
    """One row per conversation of ``conv``: faults, cost, audit and the checksum of the repaired text."""
    path = scratch_path(conv.sparkSession, "repair")
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    done.select(*KEY, "b", "faults", "audit", "cost", "illegal", "turns", F.size(kept).alias("n"),
                F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n").alias("body")).write.parquet(path)
    done = conv.sparkSession.read.parquet(path)
    times = lambda x: F.sum(F.length("faults") - F.length(F.replace(F.col("faults"), F.lit(x), F.lit("")))).cast("bigint")
    sums = done.groupBy(*KEY).agg(times("b").alias("blank"), times("d").alias("duplicate"), times("t").alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    turns = done.select(*KEY, F.explode(F.array_distinct("turns")).alias("turn")).filter("turn is not null").distinct()
    gaps = turns.groupBy(*KEY).agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    texts = done.select(*KEY, "audit", "n", "body", "b").repartition(*KEY).sortWithinPartitions(*KEY, "b").select(*KEY, "audit", "n", "body")
    texts = texts.mapInPandas(hashed, "none boolean, c bigint, audit string, repaired_sha256 string")
    ids = pick(conv, conv_id="bigint").distinct().select("conv_id", F.isnull("conv_id").alias("none"), F.coalesce("conv_id", F.lit(0)).alias("c"))
    out = ids.join(sums, KEY, "left").join(gaps, KEY, "left").join(texts, KEY, "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
