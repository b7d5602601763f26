"""Sums over subtrees, places in the flattened tree and retained sizes, against walks on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tracequill.operators import heap, jit
from tracequill.operators.ranks import percentiles
from tracequill.operators.trees import preorder, running_sum, subtree_sums


def below(kids, v):
    seen, todo = set(), [v]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += kids.get(x, [])
    return seen


@pytest.mark.parametrize("loops", [False, True])
def test_subtree_sums(spark, loops):
    rng = random.Random(4 + loops)
    up = {(s, i): rng.randint(0, i - 1) if i and rng.random() < 0.9 else (99 if i == 7 else None) for s in (1, 2) for i in range(40)}
    if loops:
        up[1, 3], up[1, 5], up[1, 0], up[2, 2] = 5, 8, 3, 2
        up[1, 8] = 0
    rows = [(s, i, u, (i * 7) % 11 if i % 6 else None) for (s, i), u in up.items()]
    got = {(r.s, r.i): r.v for r in subtree_sums(spark.createDataFrame(rows, "s int, i int, up int, v long"), ["s", "i"], "up", ["v"]).collect()}
    kids = {}
    for (s, i), u in up.items():
        kids.setdefault((s, u), []).append((s, i))
    value = {(s, i): v or 0 for s, i, _, v in rows}
    assert got == {k: sum(value[x] for x in below(kids, k)) for k in up}


def test_places_in_the_flattened_tree(spark):
    rng = random.Random(9)
    rows = [(s, f"{i:02}", f"{rng.randint(0, i - 1):02}" if i and rng.random() < 0.8 else None, rng.randint(0, 3)) for s in "ab" for i in range(30)]
    rows += [("c", "x", "y", 0), ("c", "y", "x", 0), ("c", "z", "y", 0), ("c", "r", "gone", 1)]
    got = {(r.s, r.id): (r.place, r.depth, r.size) for r in preorder(spark.createDataFrame(rows, "s string, id string, up string, t int"), ["s", "id"], "up", ["t"]).collect()}
    want = {}
    for s in "ab":
        mine = sorted((t, i, u) for x, i, u, t in rows if x == s)
        place = 0

        def walk(node, depth):
            nonlocal place
            at, place = place, place + 1
            for _, i, u in mine:
                if u == node:
                    walk(i, depth + 1)
            if node is not None:
                want[s, node] = (at - 1, depth, place - at)

        walk(None, -1)
    want["c", "r"] = (0, 0, 1)
    assert got == want


def test_running_sum_over_one_hot_group(spark):
    rows = spark.range(5000).selectExpr("IF(id % 50 = 0, 'few', 'hot') AS g", "id AS i", "id % 7 AS v")
    got = {(r.g, r.i): r.s for r in running_sum(rows, ["g"], ["i"], "v", "s").collect()}
    sums = {"few": 0, "hot": 0}
    for i in range(5000):
        g = "few" if i % 50 == 0 else "hot"
        assert got[g, i] == sums[g]
        sums[g] += i % 7


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_retained_sizes_with_sharing_and_cycles(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randint(0, i - 1), i) for i in range(1, n) if rng.random() < 0.9] + [(rng.randrange(n), rng.randrange(n)) for _ in range(seed * 4)] + [(0, 500), (600, 1)]
    edges += [(100, 101), (101, 102), (102, 100), (101, 103)]
    ids = [*range(n), 100, 101, 102, 103]
    kids = {}
    for a, b in edges:
        kids.setdefault(a, []).append(b)
    nodes = spark.createDataFrame([(i, f"n{i}", "object", i + 1) for i in ids], "id long, name string, type string, self_size long")
    got = {r.id: r.retained_size for r in heap.retained_sizes(nodes, spark.createDataFrame([(a, b, "", 0) for a, b in edges], "from_id long, to_id long, name string, seq long")).collect()}
    assert got == {i: sum(x + 1 for x in below({k: [b for b in v if b in ids] for k, v in kids.items()}, i)) for i in ids}


def test_a_long_chain_with_a_shared_end(spark):
    n = 20_000
    nodes = spark.range(n).selectExpr("id", "'x' AS name", "'object' AS type", "1L AS self_size")
    edges = spark.range(n - 1).selectExpr("id AS from_id", "id + 1 AS to_id", "'' AS name", "0L AS seq").union(spark.sql(f"SELECT 0L, {n - 1}L, '', 1L"))
    got = heap.retained_sizes(nodes, edges).selectExpr("count(*) AS n", f"count_if(retained_size = {n} - id) AS good").first()
    assert (got.n, got.good) == (n, n)


def test_ranked_percentiles_equal_the_builtin(spark):
    rows = spark.range(30_000).selectExpr("IF(id % 100 = 0, 'few', IF(id = 7, 'one', 'hot')) AS g", "CAST(hash(id) % 9000 AS DOUBLE) / 8 AS v").unionByName(spark.sql("SELECT 'none' AS g, CAST(NULL AS DOUBLE) AS v"))
    shares = {"least": 0.0, "low": 0.07, "mid": 0.5, "high": 0.95, "top": 0.99, "most": 1.0}
    want = rows.filter("v IS NOT NULL").groupBy("g").agg(*(F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY v)").alias(n) for n, p in shares.items()))
    assert sorted(percentiles(rows, ["g"], "v", shares).collect()) == sorted(want.collect())


def test_findings_in_sources(spark):
    files = spark.createDataFrame([(0, "lib/a.js"), (1, "C:\\src\\A.js"), (2, "b.js")], "file_id long, name string")
    functions = spark.createDataFrame(
        [(0, "outer", 1, 900, 0), (0, "inner", 300, 310, 1), (0, "twin", 1, 900, 2), (0, None, 950, 960, 3), (2, "run", 5, 6, 0), (2, "run", 8, 9, 1)],
        "file_id long, name string, start_line long, end_line long, seq long",
    )
    targets = ["a.js:305:1", "x/A.JS:900", "a.js:901", "a.js:955", "run", "a.js", "b.js:x", "", None, "c.js:1", ":4", "inner"]
    got = {r.target: (r.file, r.function, r.scope) for r in jit.in_sources(spark.createDataFrame([(t,) for t in targets], "target string"), files, functions).collect()}
    a, none = "lib/a.js", (None, None, "none")
    assert got == {
        "a.js:305:1": (a, "outer", "function"), "x/A.JS:900": (a, "outer", "function"), "a.js:901": (a, None, "file"), "a.js:955": (a, None, "function"), "run": ("b.js", "run", "function"), "a.js": (a, None, "file"),
        "b.js:x": ("b.js", None, "file"), "": none, None: none, "c.js:1": none, ":4": none, "inner": (a, "inner", "function"),
    }
