"""Whitening against numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from tracequill.llm import queries, whitening
from tracequill.llm.whitening import whiten_vectors


def brute(rows, k=4):
    """{(row number, component): (n, deviation, |whitened|, explained)} of [(id, vector)]."""
    kept = [(j, v) for j, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {j: tuple(math.floor(256 * float(c)) for c in v) for j, v in kept}
    fit = np.array(sorted(set(x.values())), object)
    n, s = len(fit), fit.sum(0)
    centre = ((fit * n - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for j, v in x.items():
        d = np.array(v, object) * n - s
        white = (d / n).astype(float) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        for c in range(min(k, int((values > 1e-9 * values[0]).sum()))):
            out[j, c + 1] = (n, int((d * d).sum()), white[c], values[c] / values.sum())
    return out


def agrees(frame, rows):
    want = brute(rows)
    got = frame.collect()
    assert len(got) == len(want)
    number = {i: j for j, (i, _) in enumerate(rows)}
    sign = {}
    for r in got:
        n, deviation, white, share = want[number[r.vec_id], r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(share, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(white), rel=1e-6, abs=1e-7)
        assert r.identity_error <= 1e-9
        if abs(white) > 1e-3:
            assert sign.setdefault(r.component, r.whitened * white > 0) == (r.whitened * white > 0)


def test_op11_equals_numpy(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    agrees(queries.op11_embedding_whitening(spark, tables), rows)


def test_op11_many_partitions_merge_in_a_tree(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5] + 40).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[3][1]) for i in range(700)]  # a third of all rows is one vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        agrees(whiten_vectors(frame), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op11_odd_rows(spark):
    rows = [
        (1, [0.5, -0.001, 2.0]), (2, [0.25, -0.0, 1.0]), (3, None), (4, [0.5, None, 1.0]), (5, [float("nan"), 0.0, 1.0]), (6, [float("inf"), 0.0, 1.0]),
        (7, [-3.0, 0.001, 0.3]), (8, [0.5, -0.001, 2.0]), (10, []), (11, [9.0, 9.0, -1.5]), (12, [12.0, -7.5, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, 1.5, 3) for r in rows], "vec_id long, embedding array<double>, x double, n int")
    got = whiten_vectors(frame)
    assert {r.vec_id for r in got.collect()} == {1, 2, 7, 8, 11, 12}
    agrees(got, rows)
    other = spark.createDataFrame([*rows, (13, [1.0]), (13, [1.0, 2.0]), (None, [0.0, 1.0, 7.0])], "vec_id long, embedding array<double>")
    ids = [r.vec_id for r in whiten_vectors(other).select("vec_id").distinct().collect()]
    assert 13 not in ids and None in ids


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_op11_without_variance(spark, rows):
    assert whiten_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_op11_low_rank_gives_fewer_components(spark):
    rows = [(i, [float(i), float(2 * i), 5.0, float(i % 3)]) for i in range(40)]
    got = whiten_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.component for r in got.collect()} == {1, 2}
    agrees(got, rows)


def test_scaled_deviation_is_exact_beyond_64_bits():
    x = np.array([[1 << 60, -5], [7, 9]], np.int64)
    n, sums = 1 << 20, (3, 4)
    assert whitening.scaled_deviation(x, n, sums).tolist() == [[(1 << 80) - 3, -5 * n - 4], [7 * n - 3, 9 * n - 4]]


def test_op11_deviation_beyond_63_bits_is_null(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5.0, 3.0]), (4, [0.0, -8.0])]
    got = whiten_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()
    want = brute(rows, 1)
    assert {r.vec_id: r.deviation for r in got} == {i: d if (d := want[i - 1, 1][1]) < 1 << 63 else None for i in (1, 2, 3, 4)}
    assert {r.vec_id for r in got if r.deviation is None} == {1, 2}


def test_op11_too_large_entries_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^54"):
        whiten_vectors(frame).count()
