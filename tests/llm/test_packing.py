"""Plans of the packing operator against exact optima, perfect mixes and the definition of an undominated filling."""

import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import packing as P


def optimum(sizes, capacity):
    """Fewest bins by looking at every assignment, equal bins once."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1:])
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best[0]


def bins_of(counts, capacity=1024, **more):
    plan, used = P.plan_patterns(counts, capacity, **more), Counter()
    for times, need in plan:
        assert times > 0 and sum(s * c for s, c in need) <= capacity
        for s, c in need:
            used[s] += times * c
    assert used == Counter(counts)
    return sum(t for t, _ in plan)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 60))
def test_plan_is_optimal_on_few_pieces(sizes, capacity):
    assert bins_of(Counter(sizes), capacity) == optimum(sorted(sizes, reverse=True), capacity)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(2, 20), min_size=1, max_size=7), st.integers(2, 40), st.integers(0, 12))
def test_fillings_are_those_that_nothing_dominates(sizes, rest, spare):
    counts = Counter(sizes)
    order = sorted(counts, reverse=True)
    every = {tuple(sorted(x, reverse=True)) for n in range(len(sizes) + 1) for x in itertools.combinations(sizes, n) if sum(x) <= rest}
    got = [tuple(f) for f in P.fillings(rest, order, dict(counts), spare, 10 ** 6)]
    assert len(got) == len(set(got)) and set(got) <= every and all(rest - sum(f) <= spare for f in got)

    def dominated(f):
        free = counts - Counter(f)
        waste = rest - sum(f)
        longer = any(s <= waste for s in free)
        larger = any(x > s and x - s <= waste for s in f for x in free)
        double = any(a + b in free for i, a in enumerate(f) for b in f[i + 1:])
        return longer or larger or double

    assert set(got) == {f for f in every if rest - sum(f) <= spare and not dominated(f)}


def mixed(n, seed, low, high, k):
    rng, out = random.Random(seed), []
    while len(out) < k * n:
        x = [rng.randint(low, high) for _ in range(k - 1)]
        if low <= 1024 - sum(x) <= high:
            out += x + [1024 - sum(x)]
    return Counter(out)


@pytest.mark.parametrize("n, seed, low, high, k, most", [(400, 0, 1, 1022, 3, 400), (300, 1, 1, 1021, 4, 300), (300, 2, 150, 400, 4, 301), (400, 0, 200, 500, 3, 405), (400, 1, 256, 500, 3, 405)])
def test_perfect_mixes(n, seed, low, high, k, most):
    counts = mixed(n, seed, low, high, k)
    assert n == P.lower_bound(counts, 1024) <= bins_of(counts) <= most < P.pack_counts(counts, 1024, P.best_fit)[1] + 2


def test_branch_and_bound_beats_best_fit():
    rng = random.Random(1)
    counts = Counter(rng.randint(200, 500) for _ in range(2000))
    best_fit = P.pack_counts(counts, 1024, P.best_fit)[1]
    assert bins_of(counts) <= best_fit * 0.96
    # two of each pair belong together, which the largest pieces first do not see
    assert P.pack_counts({6: 2, 4: 2, 3: 4}, 16, P.best_fit)[1] >= bins_of({6: 2, 4: 2, 3: 4}, 16) == 2
    assert bins_of({5: 1}, 5) == 1 and P.plan_patterns({}, 5) == []
