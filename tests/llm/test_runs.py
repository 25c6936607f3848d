"""Periodic runs against a slow form that looks at every start and period."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import runs
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, h string, w string, a int, p int, runs string"


def slow_runs(w, least=6, copies=4):
    """All maximal stretches with their smallest period, from the definition."""
    n, out = len(w), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, copies * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_digest(doc_id, text):
    w = brute.WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 7)), max_size=6), st.sampled_from([(6, 4), (2, 3), (9, 3), (5, 5), (30, 4)]))
def test_runs_equal_the_definition(parts, limits):
    w = [x for part, times in parts for x in part * times]
    assert runs.find_runs(np.array(w, np.int64), *limits) == slow_runs(w, *limits)


def test_random_words_equal_the_definition():
    rng = np.random.default_rng(2)
    for n, letters in ((400, 2), (300, 3), (200, 1)):
        w = rng.integers(0, letters, n).tolist()
        assert runs.find_runs(np.array(w, np.int64)) == slow_runs(w)
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), 6, 2)


def test_one_word_a_million_times_is_extended_once():
    calls = []
    real = runs.first_difference
    runs.first_difference = lambda a, b: calls.append(1) or real(a, b)
    try:
        assert runs.find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    finally:
        runs.first_difference = real
    assert len(calls) == 2  # once to each side


def test_query_on_hard_rows(spark):
    hit = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 10 == 0)
    period = " ".join(f"w{i}" for i in range(700))
    texts = [None, "", " \n\t ", "one", "a a a a a a", "a a a a a", "a b " * 4 + "a", "x " + "a b c " * 5 + "y y y y y y y", "é ü " * 9, "A a " * 9, (period + " ") * 5,
             "a\u000bb a\u000cb a\rb a\nb a b", "na me " * 40 + "na na na na na na na", "a a b " * 6, "\x00 \x00 \x00 \x00 \x00 \x00   z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, "the cat sat on the mat and the dog sat on the log " * 6) for i in range(100, 130)]
    rows += [(hit, None), (hit, ""), (hit, "only one"), (None, "b b b b b b b"), (None, None), (5, "a a a a a"), (5, "other text of the same id")]
    df = spark.createDataFrame([(*r, "h", "w", 1, 2, "r") for r in rows], SCHEMA).repartition(4)
    got = Counter(map(tuple, runs.digest(runs.periodic_runs(runs.looped(df))).collect()))
    assert got == Counter(slow_digest(*r) for r in rows)
    assert runs.digest(runs.periodic_runs(runs.looped(df.limit(0)))).collect() == []
    found = {r["doc_id"]: r for r in runs.periodic_runs(df.filter("doc_id in (7, 10)")).collect()}
    assert [tuple(r) for r in found[7]["runs"]] == [(1, 15, 3), (16, 7, 1)] and found[7]["collapsed"] == "x a b c y"
    assert [tuple(r) for r in found[10]["runs"]] == [(0, 3500, 700)] and found[10]["collapsed"] == period


def test_query_on_whole_small_table(spark):
    from tessera.llm.common import read
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    short = {r["doc_id"]: slow_digest(*r) for r in rows if len((r["text"] or "").split()) <= 400}
    got = {r["doc_id"]: tuple(r) for r in runs.digest(runs.periodic_runs(runs.looped(docs))).collect()}
    assert len(got) == len(rows) and {i: got[i] for i in short} == short
    assert sum(r[1] > 0 for r in got.values()) >= len(rows) // 20
