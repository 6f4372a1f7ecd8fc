"""Whitening against the eigenvectors of the whole covariance."""

from __future__ import annotations

import numpy as np
import pytest

from loregrain.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, __label string"


def brute(rows: list[tuple], k: int = 4):
    """Per usable row: id, deviation and the whitened coordinates up to sign; eigenvalues as shares of the trace."""
    usable = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in usable), default=0)
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (dims - len(v)) for _, v in usable]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, sums = len(fit), [sum(c) for c in zip(*set(map(tuple, x)), strict=True)]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(dims, dims))
    order = np.argsort(values)[::-1][:k]
    order = [o for o in order if values[o] > 1e-9 * values.max()]
    w = (np.array(x) - fit.mean(axis=0)) @ vectors[:, order] / np.sqrt(values[order])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, {(i, c + 1): (d, w[j, c], values[order[c]] / values.sum()) for j, ((i, _), d) in enumerate(zip(usable, deviation, strict=True)) for c in range(len(order))}


def check(spark, rows: list[tuple], k: int = 4):
    n, want = brute(rows, k)
    got = whitening.whitening_report(spark.createDataFrame(rows, VECTORS), k).collect()
    assert len(got) == len(want) and {(r["vec_id"], r["component"]) for r in got} == set(want)
    for c in {r["component"] for r in got}:
        own = [r for r in got if r["component"] == c]
        most = max(own, key=lambda r: abs(r["whitened"]))
        sign = np.sign(most["whitened"] * want[most["vec_id"], c][1])
        for r in own:
            d, w, share = want[r["vec_id"], c]
            assert (r["n"], r["deviation"]) == (n, d)
            assert abs(sign * r["whitened"] - w) < 1e-7 * (1 + abs(w)) and abs(r["explained"] / share - 1) < 1e-9 and r["identity_error"] < 1e-9


def some(n: int, dims: int, seed: int) -> list[tuple]:
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, dims)) * np.linspace(2, 0.5, dims)
    return [(i, [float(c) for c in v], 0, "l") for i, v in enumerate(x)]


def test_nulls_copies_and_odd_entries(spark):
    rows = some(150, 6, 1)
    rows += [(200 + i, rows[0][1], None, None) for i in range(400)]  # copies don't weigh
    rows += [(900, None, 1, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, None), (902, [float("nan")] * 6, 1, None), (903, [float("-inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1, None), (904, [1.0, 2.0], 1, None), (905, [], 1, None), (906, [-0.0] * 6, 1, None)]
    check(spark, rows)


@pytest.mark.parametrize(("n", "dims"), [(60, 1), (40, 3), (300, 40), (20, 40)])
def test_shapes(spark, n, dims):
    check(spark, some(n, dims, dims))


def test_many_dimensions_take_several_passes_and_new_starts(spark):
    rows = some(400, 60, 7)
    _, want = brute(rows)
    vectors = spark.createDataFrame(rows, VECTORS)
    for block, basis in ((4, 512), (4, 12)):
        model = whitening.fit(vectors, 4, block=block, basis=basis)
        assert model.passes > 1 and (model.residuals <= 1e-12 * model.values[0]).all()
        assert np.allclose(model.values / model.trace, [want[0, c][2] for c in (1, 2, 3, 4)], rtol=1e-11)
        assert np.allclose(model.components.T @ model.components, np.eye(4), atol=1e-13)
    with pytest.raises(ArithmeticError, match="not certified"):
        whitening.fit(vectors, 4, block=4, basis=12, most_passes=2)


def test_no_variance_and_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whitening_report(empty).collect() == []
    assert whitening.whitening_report(spark.createDataFrame([(1, [1.0, 2.0], 0, None), (2, [1.0, 2.0], 0, None)], VECTORS)).collect() == []
    assert whitening.whitening_report(spark.createDataFrame([(1, [], 0, None)], VECTORS)).columns == empty.sparkSession.createDataFrame([], whitening.REPORT).columns


def test_exact_beyond_64_bits(spark):
    rows = [(1, [1e15, 0.0], 0, None), (2, [-1e15, 1.0], 0, None), (3, [3.0, 2.0], 0, None)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitening_report(spark.createDataFrame(rows, VECTORS)).collect()}
    n, want = brute(rows, 1)
    assert got == {i: d if d < 1 << 63 else None for (i, _), (d, *_) in want.items()} and None in got.values()


def test_coordinates_keep_columns(spark):
    vectors = spark.createDataFrame(some(50, 5, 3), VECTORS)
    model = whitening.fit(vectors, 2)
    rows = whitening.whitened(vectors, model)
    assert rows.columns == [*vectors.columns, "whitened"]
    w = np.array([r["whitened"] for r in rows.collect()])
    assert np.allclose(w.T @ w / 50 - np.outer(w.mean(0), w.mean(0)), np.eye(2), atol=1e-9)


def test_sums_of_tasks_come_in_one_job(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def never(*_, **__):
        raise AssertionError("a job for each partition")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    rows = spark.createDataFrame([([i, 2 * i],) for i in range(10)], "x array<long>").repartition(5)
    got = whitening._added_up(rows, 2, lambda batch: whitening._matrix(batch, "x", 2).sum(axis=0))
    assert got.tolist() == [45, 90]
