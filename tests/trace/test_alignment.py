"""Alignment within a band: equal to the full table of costs, narrow bands, forced cuts, long runs."""

import json
import random
import time
import tracemalloc

import numpy as np
import pytest

from tracequill import schema
from tracequill.operators import differential
from tracequill.operators.banded import aligned, meeting


def brute(a, b, sa, sb, low, high):
    """The whole table of costs within the band, and the way back by the rule for ties."""
    n, m, far = len(a), len(b), 10**9
    d = [[far] * (m + 1) for _ in range(n + 1)]
    sub = lambda i, j: 0 if a[i - 1] == b[j - 1] else 1 if sa[i - 1] == sb[j - 1] else 5
    for i in range(n + 1):
        for j in range(max(0, i + low), min(m, i + high) + 1):
            ways = [0] if i == j == 0 else []
            ways += [d[i - 1][j - 1] + sub(i, j)] if i and j else []
            ways += [d[i - 1][j] + 2] if i else []
            ways += [d[i][j - 1] + 2] if j else []
            d[i][j] = min(ways)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + sub(i, j):
            i, j = i - 1, j - 1
            out.append((i, j, sub(i + 1, j + 1)))
        elif i and d[i][j] == d[i - 1][j] + 2:
            i -= 1
            out.append((i, -1, 2))
        else:
            j -= 1
            out.append((-1, j, 2))
    return out[::-1]


@pytest.mark.parametrize("band", [3, 10, 80])
def test_bands_give_the_way_of_the_full_table(band):
    rng, bound = np.random.default_rng(band), 0
    for k in range(60):
        n, m = (60, 60) if k < 30 else rng.integers(0, 60, 2)
        a, b = rng.integers(0, 40, n), rng.integers(0, 40, m)
        if k % 2 and n and m:  # the same with a stretch moved, so that a narrow band costs more
            b = np.concatenate([a[8:], a[:8]])[:m]
            m = len(b)
        sa, sb, reach = a % 5, b % 5, max(band, abs(int(n) - int(m)))
        want = brute(a, b, sa, sb, -reach, reach)
        for width in (1, 32):
            assert list(zip(*(x.tolist() for x in aligned(a, b, sa, sb, -reach, reach, width)))) == want
        bound += sum(w[2] for w in want) > sum(w[2] for w in brute(a, b, sa, sb, -200, 200))
    assert bound > 0 if band == 3 else True


def test_a_long_run_in_little_memory():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 50, 20_000)
    b = np.delete(a, np.sort(rng.choice(20_000, 10_000, replace=False)))
    tracemalloc.start()
    _, _, cost = aligned(a, b, a % 5, b % 5, -10_000, 10_000)
    assert tracemalloc.get_traced_memory()[1] < 40e6 and cost.sum() == 20_000  # deletions alone
    tracemalloc.stop()


def test_scattered_edits_of_a_long_run():
    rng = np.random.default_rng(6)
    a = np.arange(100_000)
    b = np.where(rng.random(len(a)) < 0.01, -a, a)
    start = time.time()
    _, _, cost = aligned(a, b, a % 7, a % 7, -256, 256)
    assert cost.sum() == (a != b).sum() and time.time() - start < 30


@pytest.mark.parametrize("gone, added", [(0, 0), (2, 0), (0, 2), (3, 3)])
def test_forced_cuts_change_nothing(spark, gone, added):
    rng = random.Random(gone * 7 + added)
    run = [(f"{'wxyz'[i % 4]}:q", i) for i in range(700)] + [("w:q", rng.randint(0, 3)) for _ in range(20)] + [("x:q", 1000 + i) for i in range(300)]
    other = [(c, v if i not in (5, 250, 251, 500, 650, 900) else -v) for i, (c, v) in enumerate(run)]
    for at in sorted(rng.sample(range(100, 900), gone), reverse=True):
        del other[at]
    for at in rng.sample(range(100, 900), added):
        other.insert(at, ("y:q", -at * 1000))
    rows = lambda pair, events: [(pair, i, c, "start", float(i), str(i), None, json.dumps({"v": v}), None) for i, (c, v) in enumerate(events)]
    kind = "pair long, " + schema.EVENT
    small = [("w:q", 1), ("x:q", 2)]
    a = differential.normalise(spark.createDataFrame(rows(1, run) + rows(2, small), kind), "pair")
    b = differential.normalise(spark.createDataFrame(rows(1, other) + rows(2, small[1:]) + rows(3, small), kind), "pair")
    got = sorted((r.place, r.normal_index, r.fault_index, r.cost) for r in differential.align(a, b, "pair", band=4).filter("pair = 1").collect())
    first = 5
    last = next(k for k in range(len(run)) if run[-1 - k] != other[-1 - k])
    reach = max(4, abs(len(run) - len(other)))
    x, y = run[first : len(run) - last], other[first : len(other) - last]
    code = {e: i for i, e in enumerate(dict.fromkeys(x + y))}
    lists = [np.array([code[e] for e in s]) for s in (x, y)] + [np.array([ord(e[0][0]) for e in s]) for s in (x, y)]
    pa, pb, cost = aligned(*lists, -reach, reach)
    middle = [(k + first, int(i) + first if i >= 0 else -1, int(j) + first if j >= 0 else -1, int(c)) for k, (i, j, c) in enumerate(zip(pa, pb, cost))]
    assert [g for g in got if g[0] < first] == [(k, k, k, 0) for k in range(first)]
    assert [g for g in got if first <= g[0] < first + len(middle)] == middle
    assert len(got) == first + len(middle) + last


def test_runs_are_cut_at_forced_matches(spark):
    xs = spark.range(2000).selectExpr("1L AS pair", "id AS x", "id AS f")
    ys = spark.range(2000).selectExpr("1L AS pair", "id AS x", "IF(id IN (700, 1300), -id, id) AS f")
    reach = spark.createDataFrame([(1, 4)], "pair long, reach long")
    runs = sorted(tuple(r) for r in differential.forced(xs, ys, reach).collect())
    assert len(runs) == 3 and runs[0] == (1, 1, 36, 657, 0) and all(r[4] == 0 and r[3] - r[2] > 400 for r in runs)


@pytest.mark.parametrize("gone", [0, 3])
def test_places_that_are_met_lie_on_the_cheapest_way(spark, gone):
    """Fingerprints that all occur many times, edits every few events: no block is solid, and still there are cuts that change nothing."""
    rng = np.random.default_rng(gone)
    a = rng.integers(0, 60, 6000)
    b = a.copy()
    b[::23] = 60 + a[::23]  # same kind, another value
    b = np.delete(b, rng.choice(6000, gone, replace=False))
    frame = lambda x: spark.createDataFrame([(1, i, int(f), int(f) % 10, 8) for i, f in enumerate(x)], "pair long, x long, f long, s long, reach long")
    cells = sorted((r.start, r.shift) for r in differential.met(frame(a), frame(b), 300).collect())
    pa, pb, _ = aligned(a, b, a % 10, b % 10, -8, 8)
    passed, i, j = {(0, 0)}, 0, 0
    for x, y in zip(pa.tolist(), pb.tolist()):
        i, j = i + (x >= 0), j + (y >= 0)
        passed.add((i, j - i))
    assert len(cells) >= 14 and set(cells) <= passed and all(c % 300 == 0 for c, _ in cells)


def test_nothing_is_said_to_be_met_where_ways_are_equal():
    a = np.zeros(32, np.int64)
    assert meeting(a, np.zeros(48, np.int64), a, np.zeros(48, np.int64), 8) is None


def test_scattered_edits_are_cut(spark):
    """A run of 20,000 events of 150 fingerprints with an edit every 23rd: the pieces give what one alignment gives."""
    rng = np.random.default_rng(3)
    v = rng.integers(0, 150, 20_000).tolist()
    rows = lambda f: [(1, i, f"{'vwxyz'[x % 5]}:q", "start", float(i), str(i), None, json.dumps({"v": f(i, x)}), None) for i, x in enumerate(v)]
    kind = "pair long, " + schema.EVENT
    a = differential.normalise(spark.createDataFrame(rows(lambda i, x: x), kind), "pair")
    b = differential.normalise(spark.createDataFrame([r for r in rows(lambda i, x: -1 if i % 23 == 5 else x) if r[1] != 9_000], kind), "pair")
    tried = []
    old = differential.met
    differential.met = lambda x, y, step=differential.STEP: tried.append(old(x, y, 500)) or tried[-1]
    try:
        got = sorted((r.place, r.normal_index, r.fault_index, r.cost) for r in differential.align(a, b, "pair", band=16).collect())
    finally:
        differential.met = old
    assert tried[0].count() > 20
    assert [g[1:] for g in got if g[3]] == [(i, i - (i > 9_000) if i != 9_000 else -1, 2 if i == 9_000 else 1) for i in range(20_000) if i % 23 == 5 or i == 9_000]
    assert sorted(g[1] for g in got) == list(range(20_000)) and len({g[0] for g in got}) == 20_000
