"""Conversation repair against a form that looks from the end, and against every possible audit."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import repair
from tessera.llm.common import read, text_session

WORDY = re.compile(r"[^\x20\x09-\x0D]")
TARGET = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    out, seen = "", set()
    for role, text in rows:
        last = WORDY.findall(text)
        out += "b" if not last else "d" if (role, text) in seen else "." if last[-1] in ".!?" else "t"
        seen.add((role, text))
    return out


def from_the_end(initials, faults):
    """Cheapest (cost, audit) by the least way to go on from each (row, state)."""
    n = len(initials)
    nxt = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"u": 2, "a": 3}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == n and state in (0, 3) else []
        join = lambda cost, letter, rest: (cost + rest[0], letter + rest[1])
        if inserted < 3:
            found.append(join(5, "I", best(i, to[nxt[state]], inserted + 1)))
        if i < n:
            found.append(join(2, "D", best(i + 1, state, 0)))
            if faults[i] not in "bd":
                more = 5 if faults[i] == "t" else 0
                found.append(join(1 + more, "R", best(i + 1, to[nxt[state]], 0)))
                if initials[i] == "s" and state == 0:
                    found.append(join(more, "K", best(i + 1, 1, 0)))
                if initials[i] == nxt[state]:
                    found.append(join(more, "K", best(i + 1, to[nxt[state]], 0)))
        return min(found, default=(10 ** 9, ""))

    for i in range(n, 0, -1):  # so that no call goes deep
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def of_all_audits(initials, faults):
    """The definition itself, for few rows."""
    found = []
    for n in range(len(initials) + 3):
        for audit in map("".join, itertools.product("DIKR", repeat=n)):
            if len(audit) - audit.count("I") != len(initials):
                continue
            rows, cost, open_ = iter(zip(initials, faults)), 5 * audit.count("I"), []
            for e in audit:
                i, f = ("ua", ".") if e == "I" else next(rows)
                if e != "D" and f in "bd":
                    cost += 10 ** 6
                cost += {"D": 2, "R": 1}.get(e, 0) + (5 if e in "KR" and f == "t" else 0)
                if e != "D":
                    open_.append(i if e == "K" else "ua")
            if any(TARGET.fullmatch("".join(p)) for p in itertools.product(*open_)):
                found.append((cost, audit))
    return min(found)


def want_row(conv_id, rows):
    """rows: (turn, role, text) of one conversation, before damage."""
    space = lambda x: " " if x is None else x
    after = []
    for turn, role, text in rows:
        d = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        role, text = "user" if d == 4 else space(role), "" if d == 1 else re.sub("[.!?]", "", space(text)) if d == 2 else space(text)
        after += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    initials = "".join(r[1][:1] if r[1][:1] and r[1][:1] in "sua" else "x" for r in after)
    faults = faults_of([r[1:] for r in after])
    cost, audit = from_the_end(initials, faults)
    turns = [r[0] for r in after if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    out, left, state = [], iter(after), ""
    for e in audit:
        row = (None, "", "") if e == "I" else next(left)
        if e == "D":
            continue
        fresh = "assistant" if state == "u" else "user"
        role = row[1] if e == "K" else fresh
        out.append(f"{role}:{row[2]}")
        state = role[0]
    return (conv_id, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def chain(initials, faults, size):
    """Both passes without Spark."""
    import pandas as pd
    rows = []
    for k, at in enumerate(range(0, len(initials), size)):
        i, f = initials[at:at + size], faults[at:at + size]
        x = [y for s in repair.STATES for y in (repair.crossings(i, f, s, k == 0) if s == 0 or k else [None] * 4)]
        rows.append((False, 1, k, i, [None if y is None else y[0] for y in x], [None if y is None else y[1] for y in x]))
    frames = [pd.DataFrame(rows[a:a + 2], columns=["none", "c", "b", "initials", "costs", "paths"]) for a in range(0, len(rows), 2)]
    found = pd.concat(repair.chained(iter(frames)))
    assert found["b"].tolist() == list(range(len(rows)))
    return int(found["cost"].sum()), "".join(found["audit"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([i + f for i in "suuaax" for f in "...bdt"]), min_size=1, max_size=40), st.sampled_from([1, 2, 3, 7, 50]))
def test_cheapest_least_edits(codes, size):
    initials, faults = "".join(c[0] for c in codes), "".join(c[1] for c in codes)
    assert chain(initials, faults, size) == from_the_end(initials, faults)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_every_audit_of_few_rows(n):
    kinds = [i + f for i in "suax" for f in ".bt"]
    for codes in itertools.product(kinds, repeat=n) if n < 3 else itertools.islice(itertools.product(kinds, repeat=3), 0, None, 29):
        initials, faults = "".join(c[0] for c in codes), "".join(c[1] for c in codes)
        assert from_the_end(initials, faults) == of_all_audits(initials, faults) == chain(initials, faults, 2)


def test_edits_leave_the_tree_and_memory_is_bounded():
    tree, most, out = repair.Survivors(0), 0, 0
    for code in ["s.", *["u.", "a."] * 20_000]:
        tree.step(repair.MOVES[code])
        tree.insert()
        out += len(list(tree.settled()))
        most = max(most, max(n.depth for _, n in tree.best.values()) - tree.root.depth)
    assert most < 20 and out > 39_000
    for codes in (["x."] * 3000, ["u."] * 3000, ["ut", "at"] * 1500):  # survivors that never meet, and ties all along
        i, f = "".join(c[0] for c in codes), "".join(c[1] for c in codes)
        cost, audit = chain(i, f, 128)
        assert len(audit) - audit.count("I") == 3000 and cost == chain(i, f, 500)[0] and audit == chain(i, f, 500)[1]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, b bigint, c string, part int, edits string"


def conversations():
    rows = [(i, t, r, x) for i in range(60) for t, (r, x) in enumerate([("system", "Be kind."), ("user", f"Ask {i}?"), ("assistant", "Yes."), ("user", "And then"), ("assistant", "Yes.")][i % 2:i % 4 + 3])]
    rows += [(100, None, "user", "Null turn."), (100, None, None, None), (100, 5, "tool", "Out."), (100, 2, "", "x!"), (100, 9, "u", "last ?\n "), (None, 1, "user", "No id."), (None, None, "assistant", "é!"),
             (101, 3, "user", "same."), (101, 3, "user", "same."), (101, 3, "assistant", "tie."), (101, -4, "system", "Early."), (102, None, None, None), (-5, 2 ** 40, "assistant", "Far."), (-5, 0, "user", "Near.")]
    rows += [(200, t, ("user", "assistant", "bot")[t % 3 if t % 7 else 2], f"turn {t}" + (".", "!", "")[t % 3]) for t in range(900)]
    rows += [(201, 7, "user", "again.")] * 700 + [(202, t, "user", "   ") for t in range(3)]
    dropped = next(t for t in range(1000) if zlib.crc32(f"300:{t}".encode()) % 20 == 0)
    return rows + [(300, dropped, "user", "gone.")]


def test_query_on_hard_rows(spark):
    by = defaultdict(list)
    for i, *r in conversations():
        by[i].append(tuple(r))
    want = {i: want_row(i, r) for i, r in by.items()}
    df = text_session(spark).createDataFrame([(*r, 1, "c", 2, "e") for r in conversations()], SCHEMA).repartition(5)
    found = repair.repair(repair.damaged(df), size=64)
    got = {r["conv_id"]: tuple(r) for r in repair.digest(found, df).collect()}
    assert got == want
    assert got[300][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = df.limit(0)
    assert repair.digest(repair.repair(repair.damaged(empty)), empty).collect() == []


def test_repaired_rows_follow_the_pattern(spark):
    df = text_session(spark).createDataFrame([(*r, 1, "c", 2, "e") for r in conversations()], SCHEMA)
    rows = defaultdict(list)
    for r in repair.repaired(df).collect():
        rows[r["conv_id"]].append((tuple(r["place"]), r["role"][:1], r["edit"], r["text"]))
    for r in rows.values():
        r.sort()
        assert TARGET.fullmatch("".join(x[1] for x in r)) and all(x[3] == "" for x in r if x[2] == "I")


def test_query_on_whole_table(spark):
    conv = read(spark, "/root/testdata/sf0.01", "conversations")
    by = defaultdict(list)
    for r in conv.collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r) for r in repair.digest(repair.repair(repair.damaged(conv)), conv).collect()}
    assert got == {i: want_row(i, r) for i, r in by.items()}
    assert {x for r in got.values() for x in r[7]} >= {"D", "K", "R"}  # a deletion is mostly cheaper than an insertion
