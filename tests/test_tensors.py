"""Tensor operators against NumPy on small tensors with repeats, stored zeros, NaN and empty lines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave import xp
from gridweave.frame import DenseFrame, SparseFrame, dense
from gridweave.functions import expr
from gridweave.operators import elementwise, linalg, manipulation, reductions, searching
from gridweave.plans import algorithms, qr
from gridweave.sources import creation, matrix_market, tiles

A = np.array([[1.0, 0, 2], [0, 3, 0]])


def csr(spark, x):
    at = np.nonzero(x)
    indptr = np.concatenate([[0], np.cumsum((x != 0).sum(1))])
    return creation.from_csr(spark, indptr, at[1], x[at], x.shape)


def sparse(spark, x, fmt):
    if fmt == "csr":
        return csr(spark, x)
    if fmt == "csc":
        at = np.nonzero(x.T)
        return creation.from_csc(spark, np.concatenate([[0], np.cumsum((x != 0).sum(0))]), at[1], x.T[at], x.shape)
    at = np.nonzero(x)
    return creation.from_coo(spark, *at, x[at], x.shape) if fmt == "coo" else creation.from_coond(spark, x.shape, np.stack(at, 1), x[at])


@pytest.fixture(scope="module")
def pair():
    pick = np.random.default_rng(3)
    a = np.where(pick.random((5, 7)) < 0.4, pick.integers(-4, 5, (5, 7)), 0).astype(float)
    b = np.where(pick.random((5, 7)) < 0.5, pick.integers(-3, 4, (5, 7)), 0).astype(float)
    a[2] = 0
    return a, b


@pytest.mark.parametrize("fmt", ["csr", "csc", "coo"])
def test_products(spark, fmt):
    a = sparse(spark, A, fmt)
    assert (a @ dense(spark, [10.0, 20, 30])).toarray().tolist() == [70, 60]
    assert (a @ dense(spark, [[1.0, 2], [3, 4], [5, 6]])).toarray().tolist() == [[11, 14], [9, 12]]
    b = np.arange(24.0).reshape(4, 3, 2)
    assert np.allclose((a @ dense(spark, b)).toarray(), A @ b)
    assert linalg.vecdot(a, dense(spark, [2.0, 5]), 0).toarray().tolist() == [2, 15, 4]
    assert np.array_equal(a.T.toarray(), A.T) and a.T.fmt == fmt
    for bad in (dense(spark, [1.0, 2]), dense(spark, np.ones((2, 2)))):
        with pytest.raises(ValueError):
            a @ bad
    with pytest.raises(NotImplementedError):
        xp.matmul(a, a)


def test_more_dimensions(spark):
    x = np.zeros((2, 3, 2))
    x[0, 0, 0], x[0, 2, 1], x[1, 1, 0] = 1, 2, 3
    t = sparse(spark, x, "coond")
    assert xp.sum(t).item() == 6 and xp.mean(t).item() == pytest.approx(0.5)
    assert np.array_equal(reductions.reduce_sum_axes(t, (0, 2)).toarray(), x.sum((0, 2)))
    assert np.allclose(reductions.reduce_mean_axes(t, [1]).toarray(), x.mean(1))
    assert np.array_equal(t.permute_axes([2, 0, 1]).toarray(), x.transpose(2, 0, 1))
    assert np.array_equal(t.reshape((3, 4)).toarray(), x.reshape(3, 4))
    assert t.mode_unfold_to_csc(1).shape == (3, 4)
    assert np.array_equal(t.mode_unfold_to_csr(1).toarray(), x.transpose(1, 0, 2).reshape(3, 4))
    assert np.array_equal(t.axes_unfold_to_csc([2, 0]).toarray(), x.transpose(2, 0, 1).reshape(4, 3))
    other = creation.from_coond(spark, (1, 3, 1), [0, 0, 0, 0, 1, 0, 0, 2, 0], [10.0, 20, 30])
    assert xp.sum(xp.multiply(t, other)).item() == 130
    w = np.array([[1.0, 2], [3, 4], [5, 6]])
    assert np.array_equal(linalg.tensordot(t, dense(spark, w), ([1], [0])).toarray(), np.tensordot(x, w, ([1], [0])))
    assert np.array_equal(linalg.vecdot(t, dense(spark, [2.0, 3]), -1).toarray(), x @ [2, 3])
    assert xp.sum(t, axis=(0, 2), keepdims=True).shape == (1, 3, 1)
    assert xp.sum(t, axis=(0, 1, 2)).item() == 6
    with pytest.raises(NotImplementedError):
        xp.sum(t, axis=())
    with pytest.raises(ValueError):
        t.reshape((5, 5))
    with pytest.raises(TypeError):
        t.hadamard_broadcast(3)


@pytest.mark.parametrize("fmt", ["csr", "csc", "coond"])
def test_pairs(spark, pair, fmt):
    a, b = pair
    x, y = sparse(spark, a, fmt), sparse(spark, b, fmt)
    both = (a != 0) & (b != 0)
    safe = np.where(b == 0, 1, b)
    assert np.array_equal(elementwise.pairwise("add", x, y).toarray(), a + b)
    assert np.array_equal(elementwise.pairwise("subtract", x, y).toarray(), a - b)
    assert np.array_equal(x.multiply(y).toarray(), a * b)
    assert np.allclose(x.divide(y).toarray(), np.where(both, a / safe, 0))
    assert np.array_equal(x.floor_divide(y).toarray(), np.where(both, a // safe, 0))
    assert np.array_equal(x.remainder(y).toarray(), np.where(both, a % safe, 0))
    powers = np.where(both, np.power(a, b, where=both, out=np.zeros_like(a)), 0)
    assert np.allclose(x.power(y).toarray(), powers)
    assert elementwise.pairwise("subtract", x, x).nnz == 0 and x.remainder(x).nnz == 0
    assert np.array_equal(elementwise.union_support("maximum", x, y).toarray(), np.maximum(a, b))


def test_pairs_that_do_not_fit(spark, pair):
    a = csr(spark, pair[0])
    with pytest.raises(NotImplementedError):
        xp.add(a, a.to_csc())
    with pytest.raises(ValueError):
        a + a.T
    with pytest.raises(TypeError):
        a + a.to_coo()


def test_repeats_add_up(spark):
    a = creation.from_csr(spark, [0, 3], [0, 0, 2], [1.0, 3, 2], (1, 3), check=False)
    assert (a + a).toarray().tolist() == [[8, 0, 4]]
    c = creation.from_coo(spark, [0, 0], [1, 1], [2.0, 3], (1, 2))
    assert c.toarray().tolist() == [[0, 5]] and c.nnz == 2
    assert (c**2).toarray().tolist() == [[0, 13]]
    assert xp.count_nonzero(c).item() == 2
    assert xp.var(c).item() == pytest.approx((13 - 25 / 2) / 2)
    assert c.to_csr().nnz == 1
    with pytest.raises(ValueError):
        creation.from_csr(spark, [0, 2], [0, 0], [1.0, 2], (1, 2))
    with pytest.raises(ValueError):
        creation.from_coo(spark, [5], [0], [1.0], (2, 2))


def test_numbers(spark, pair):
    a = pair[0]
    x = csr(spark, a)
    assert np.array_equal((x * 2.5).toarray(), a * 2.5) and np.array_equal((3 * x).toarray(), a * 3)
    assert np.allclose((x / 4).toarray(), a / 4)
    assert np.array_equal((x // -3).toarray(), np.where(a != 0, a // -3, 0))
    assert np.array_equal((x % -3).toarray(), np.where(a != 0, a % -3, 0))
    assert np.array_equal((x**2).toarray(), a**2)
    assert np.array_equal((-x).toarray(), -a) and np.array_equal(abs(x).toarray(), abs(a))
    for bad in (lambda: x / 0, lambda: x // 0, lambda: x % 0):
        with pytest.raises(ZeroDivisionError):
            bad()
    with pytest.raises(NotImplementedError):
        xp.divide(2.0, x)


def test_prune_and_zeros(spark):
    c = creation.from_coo(spark, [0, 0, 0], [0, 1, 2], [1.0, 0.0, 1e-9], (1, 3))
    assert c.prune(1e-6).nnz == 1 and c.eliminate_zeros().nnz == 2 and c.prune(-1).nnz == 3
    n = creation.from_csr(spark, [0, 2], [0, 1], [np.nan, 2.0], (1, 2))
    assert n.eliminate_zeros().nnz == 2 and n.prune(0.0).nnz == 1


@pytest.mark.parametrize("axis", [None, 0, 1, -1, (0, 1)])
@pytest.mark.parametrize("fmt", ["csr", "csc", "coo"])
def test_reductions(spark, pair, fmt, axis):
    a = pair[0]
    x = sparse(spark, a, fmt)
    for name in ("sum", "mean", "min", "max"):
        assert np.allclose(getattr(xp, name)(x, axis).toarray(), getattr(np, name)(a, axis)), name


@pytest.mark.parametrize("axis", [None, 0, 1])
def test_more_reductions(spark, pair, axis):
    a = np.abs(pair[0]) + np.eye(5, 7)
    a[:, 3] = 2.0
    x = csr(spark, a)
    for name in ("prod", "all", "any"):
        assert np.allclose(getattr(xp, name)(x, axis).toarray(), getattr(np, name)(a, axis)), name
    for correction in (0, 1):
        assert np.allclose(xp.var(x, axis, correction).toarray(), np.var(a, axis, ddof=correction))
        assert np.allclose(xp.std(x, axis, correction, keepdims=True).toarray(), np.std(a, axis, ddof=correction, keepdims=True))
    assert np.array_equal(xp.count_nonzero(x, axis).toarray(), np.count_nonzero(a, axis))


def test_empty_shapes(spark):
    e = creation.zeros(spark, (0, 3))
    assert xp.sum(e).item() == 0 and xp.min(e).item() == 0 and xp.prod(e).item() == 1
    assert xp.all(e).item() is True and xp.any(e).item() is False
    assert xp.all(e, axis=0).toarray().tolist() == [True] * 3
    assert xp.sum(creation.zeros(spark, (3, 0)), axis=1).toarray().tolist() == [0, 0, 0]
    assert creation.zeros(spark, (3, 0)).T.shape == (0, 3)


def test_nan(spark):
    x = creation.from_csr(spark, [0, 2, 4], [0, 2, 0, 1], [1.0, -2.0, 0.0, np.nan], (2, 3))
    full = x.toarray()
    assert np.array_equal(x.sign().toarray(), np.sign(full), equal_nan=True)
    for name in expr.COMPARE:
        assert np.array_equal(getattr(xp, name)(x, 0.0).toarray(), getattr(np, name)(full, 0.0)), name
        assert np.array_equal(getattr(xp, name)(x, x).toarray(), getattr(np, name)(full, full)), name
    assert xp.all(x).item() is False and xp.any(x, axis=1).toarray().tolist() == [True, True]
    assert xp.min(x).item() == -2


@pytest.mark.parametrize("chunk", [65_536, 2])
def test_running(spark, pair, chunk, monkeypatch):
    monkeypatch.setattr(reductions, "CHUNK", chunk)
    a = pair[0]
    x = csr(spark, a)
    full = csr(spark, np.abs(a) + 1)
    for axis in (0, 1):
        assert np.array_equal(xp.cumulative_sum(x, axis).toarray(), np.cumsum(a, axis))
        assert np.allclose(xp.cumulative_prod(full, axis).toarray(), np.cumprod(np.abs(a) + 1, axis))
        assert np.array_equal(xp.cumulative_prod(x, axis).toarray(), np.cumprod(a, axis))
        for n in (0, 1, 2, 5, 9):
            assert np.array_equal(xp.diff(x, n=n, axis=axis).toarray(), np.diff(a, n, axis)), (n, axis)
    with pytest.raises(NotImplementedError):
        xp.cumulative_sum(x)


def test_indexing(spark):
    a = csr(spark, A)
    assert a[0, 2] == 2 and a[1, 0] == 0
    assert a[0, :].toarray().tolist() == [1, 0, 2] and a[:, 1].toarray().tolist() == [0, 3]
    for bad in ((-1, 0), (0, 3)):
        with pytest.raises(IndexError):
            a[bad]
    with pytest.raises(NotImplementedError):
        a[0:1, 0]


def test_formats(spark, pair):
    a = pair[0]
    x = sparse(spark, a, "coo")
    assert np.array_equal(x.to_csc().toarray(), a)
    got = [r["ptr"] for r in x.to_csr().row_pointers().orderBy("line").collect()]
    assert got == [0, *np.cumsum((a != 0).sum(1)).tolist()]
    with pytest.raises(NotImplementedError):
        csr(spark, a).astype(np.int64)


def test_shapes(spark, pair):
    a, b = pair
    x, y = csr(spark, a), csr(spark, b)
    assert np.array_equal(xp.concat([x, y], axis=1).toarray(), np.concatenate([a, b], 1))
    assert np.array_equal(xp.stack([x, y], axis=1).toarray(), np.stack([a, b], 1))
    assert np.array_equal(xp.unstack(x)[3].toarray(), a[3])
    assert np.array_equal(xp.flip(x).toarray(), np.flip(a)) and np.array_equal(xp.roll(x, 2, 1).toarray(), np.roll(a, 2, 1))
    assert np.array_equal(xp.roll(x, -3).toarray(), np.roll(a, -3))
    assert np.array_equal(xp.tile(x, (2, 1)).toarray(), np.tile(a, (2, 1))) and np.array_equal(xp.repeat(x, 3, 0).toarray(), a.repeat(3, 0))
    assert np.array_equal(xp.squeeze(xp.expand_dims(x, 1)).toarray(), a)
    assert np.array_equal(xp.broadcast_to(x, (2, 5, 7)).toarray(), np.broadcast_to(a, (2, 5, 7)))
    assert np.array_equal(xp.moveaxis(xp.expand_dims(x, 0), 0, 2).toarray(), np.moveaxis(a[None], 0, 2))
    assert np.array_equal(xp.tril(x).toarray(), np.tril(a)) and np.array_equal(xp.triu(x.todense(), 1).toarray(), np.triu(a, 1))
    assert np.array_equal(xp.take(x, [3, 0], axis=1).toarray(), a[:, [3, 0]])


def test_searching(spark, pair):
    a = pair[0]
    d = dense(spark, a)
    for axis in (None, 0, 1):
        assert np.array_equal(xp.argmax(d, axis).toarray(), np.argmax(a, axis)) and np.array_equal(xp.argmin(d, axis).toarray(), np.argmin(a, axis))
    for axis in (0, 1):
        assert np.array_equal(xp.sort(d, axis).toarray(), np.sort(a, axis))
        assert np.array_equal(xp.argsort(d, axis).toarray(), np.argsort(a, axis, kind="stable"))
        order = xp.argsort(d, axis)
        assert np.array_equal(xp.take_along_axis(d, order, axis).toarray(), np.sort(a, axis))
    assert {tuple(r) for r in xp.nonzero(csr(spark, a)).collect()} == set(zip(*map(list, np.nonzero(a)), strict=True))
    line = dense(spark, a.ravel())
    assert np.array_equal(xp.sort(line).toarray(), np.sort(a.ravel()))
    assert np.array_equal(xp.argsort(line).toarray(), np.argsort(a.ravel(), kind="stable"))
    inverse = {(r["row"], r["col"]): r["inverse"] for r in xp.unique_inverse(d).collect()}
    assert [inverse[i, j] for i in range(5) for j in range(7)] == np.unique(a, return_inverse=True)[1].ravel().tolist()
    values, v = [0.0, 1, 1, 2, 5], [1.0, -3, 9, 1.5]
    for side in ("left", "right"):
        assert xp.searchsorted(dense(spark, values), dense(spark, v), side=side).toarray().tolist() == np.searchsorted(values, v, side).tolist()
    counts = {r["val"]: r["count"] for r in xp.unique_counts(d).collect()}
    assert counts == dict(zip(*[x.tolist() for x in np.unique(a, return_counts=True)], strict=True))
    assert np.array_equal(xp.where(xp.greater(d, 0.0), d, xp.negative(d)).toarray(), np.abs(a))


def test_functions_of_one_value(spark):
    v = np.array([-2.5, -1.0, -0.5, -0.0, 0.0, 0.5, 1.5, 2.5, np.inf, -np.inf, np.nan])
    d = dense(spark, v)
    with np.errstate(all="ignore"):
        for name in ("floor", "ceil", "trunc", "round", "exp", "expm1", "log", "log1p", "log2", "log10", "sqrt", "square", "sin", "cos", "asin", "atan", "sinh", "tanh", "asinh", "isnan", "isinf", "isfinite", "signbit", "logical_not"):
            want = getattr(np, name)(v)
            assert np.allclose(getattr(xp, name)(d).toarray(), want, equal_nan=True), name
        w = np.array([2.0, -2, 0, 1, np.nan, 3, 0.5, -1, 1, 1, 1])
        for name, own in (("atan2", "arctan2"), ("copysign", "copysign"), ("maximum", "maximum"), ("minimum", "minimum"), ("divide", "divide"), ("logical_xor", "logical_xor"), ("pow", "power")):
            got, want = getattr(xp, name)(d, dense(spark, w)).toarray(), getattr(np, own)(v, w)
            assert np.allclose(got, want, equal_nan=True), name
    assert np.array_equal(xp.nextafter(d, 9.0).toarray(), np.nextafter(v, 9.0), equal_nan=True)
    assert np.allclose(xp.exp(csr(spark, A)).toarray(), np.exp(A))


def test_creation(spark):
    assert np.array_equal(xp.eye(3, 4, 1).toarray(), np.eye(3, 4, 1)) and np.array_equal(xp.eye(3, 2, -1).toarray(), np.eye(3, 2, -1))
    assert np.array_equal(creation.diag(spark, [1.0, 2]).toarray(), np.diag([1.0, 2]))
    assert np.array_equal(xp.arange(2, 11, 3).toarray(), np.arange(2, 11, 3)) and np.allclose(xp.linspace(0, 1, 5).toarray(), np.linspace(0, 1, 5))
    assert np.array_equal(xp.full((2, 3), 7.0).toarray(), np.full((2, 3), 7.0))
    for got, want in zip(xp.meshgrid(dense(spark, [1.0, 2]), dense(spark, [3.0, 4, 5])), np.meshgrid([1.0, 2], [3.0, 4, 5]), strict=True):
        assert np.array_equal(got.toarray(), want)
    with pytest.raises(ValueError):
        xp.zeros((2, 2), device="gpu")
    with pytest.raises(NotImplementedError):
        xp.zeros((2, 2), dtype=np.float32)


def test_namespace(spark):
    assert csr(spark, A).__array_namespace__() is xp
    assert "vecdot" in xp.__array_namespace_info__()["capabilities"]["linalg"]
    assert xp.promote_dtypes("float32", "int64") == "float64"
    with pytest.raises(TypeError):
        xp.promote_dtypes("bool", "int64")
    with pytest.raises(NotImplementedError):
        xp.fft
    before = xp.get_num_threads(spark)
    xp.set_num_threads(3, spark)
    assert xp.get_num_threads(spark) == 3
    xp.set_num_threads(before, spark)


def test_parquet(spark, tmp_path, pair):
    x = csr(spark, pair[0])
    creation.write_parquet(x, str(tmp_path / "x"))
    y = creation.read_parquet(spark, str(tmp_path / "x"))
    assert y.fmt == "csr" and y.shape == x.shape and np.array_equal(y.toarray(), pair[0])


def test_iterations(spark):
    pick = np.random.default_rng(5)
    a = np.where(pick.random((6, 6)) < 0.4, pick.random((6, 6)), 0)
    s = algorithms.spd(csr(spark, a))
    full = s.toarray()
    x, _, residual = algorithms.cg_solve(s, creation.ones(spark, (6,)), 1e-10, 20)
    assert residual <= 1e-10 and np.allclose(full @ x.toarray(), 1)
    p = algorithms.row_stochastic(csr(spark, a))
    assert np.allclose(p.toarray().sum(1), 1)
    ranks = algorithms.block_pagerank(p.T.to_csr(), creation.full(spark, (6, 1), 1 / 6), 0.85, 1e-9, 8)[0].toarray()
    want = np.full(6, 1 / 6)
    for _ in range(8):
        want = 0.85 * p.toarray().T @ want + 0.15 / 6
        want /= want.sum()
    assert np.allclose(ranks[:, 0], want, atol=1e-8)
    start = pick.random((6, 3))
    got, values = algorithms.block_power(s, dense(spark, start), 6)
    for _ in range(6):
        start = np.linalg.qr(full @ start)[0]
    got = got.toarray()
    assert np.allclose(got.T @ got, np.eye(3)) and np.allclose(got @ got.T, start @ start.T)
    assert np.allclose(values, np.linalg.eigvalsh(start.T @ full @ start)[::-1])
    none = algorithms.block_power(s, dense(spark, np.eye(6)[:, :2]), 0)[1]
    assert np.allclose(none, np.linalg.eigvalsh(full[:2, :2])[::-1])


def test_windowed_stream(spark, tmp_path):
    from gridweave.streaming.incremental import windowed_sums

    rows = [(f"2024-01-01 0{h}:10:00", k, float(h + k)) for h in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "t string, row long, val double").selectExpr("to_timestamp(t) AS ts", "row", "val")
    cells.write.parquet(str(tmp_path / "in"))
    table = windowed_sums(cells, "ts", ["row"])
    stream = windowed_sums(spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in")), "ts", ["row"])
    running = stream.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, table.collect()))


def test_dense_item(spark):
    with pytest.raises(ValueError):
        dense(spark, [1.0, 2]).item()
    assert isinstance(csr(spark, A).todense(), DenseFrame) and isinstance(csr(spark, A), SparseFrame)
    assert searching.unique_all(dense(spark, [2.0, 1, 2])).count() == 2
    assert manipulation.permute_axes(csr(spark, A), (1, 0)).shape == (3, 2)


def test_namespace_as_numpy(spark):
    x, y = np.array([[1.0, -2, 3], [0, 5, -6]]), np.array([2.0, 0, -1])
    a, b = dense(spark, x), dense(spark, y)
    assert np.array_equal(xp.add(a, b).toarray(), x + y) and np.array_equal(xp.greater(a, b).toarray(), x > y)
    assert np.array_equal(xp.matmul(a, b).toarray(), x @ y) and np.array_equal(xp.matmul(a, dense(spark, x.T)).toarray(), x @ x.T)
    assert np.array_equal(xp.matmul(b, dense(spark, x.T)).toarray(), y @ x.T) and xp.matmul(b, b).item() == y @ y
    assert np.array_equal(xp.cumulative_sum(b).toarray(), np.cumsum(y)) and np.array_equal(xp.cumulative_prod(b).toarray(), np.cumprod(y))
    assert np.array_equal(xp.diff(b).toarray(), np.diff(y)) and np.array_equal(xp.diff(a, n=2, axis=1).toarray(), np.diff(x, 2))
    nan = dense(spark, [3.0, np.nan, 1])
    assert xp.argmin(nan, axis=0).item() == 1 and xp.argmax(nan, axis=0).item() == 1
    assert xp.argmax(a, axis=1, keepdims=True).toarray().tolist() == np.argmax(x, 1, keepdims=True).tolist()
    assert xp.argmin(a, keepdims=True).toarray().tolist() == [[5]]
    assert np.array_equal(xp.repeat(a, 2).toarray(), np.repeat(x, 2)) and np.array_equal(xp.roll(a, (1, -1), (0, 1)).toarray(), np.roll(x, (1, -1), (0, 1)))
    assert np.array_equal(xp.sort(a, axis=1, descending=True).toarray(), -np.sort(-x, 1)) and xp.argsort(b, descending=True).toarray().tolist() == [0, 1, 2]
    ends = [np.inf, -np.inf, 1.0]
    assert np.array_equal(xp.logaddexp(dense(spark, ends), dense(spark, ends)).toarray(), np.logaddexp(ends, ends))
    close = np.array([[1e8 + 1, 1e8 + 2, 1e8 + 3, 1e8 + 4]])
    assert xp.var(dense(spark, close)).item() == pytest.approx(1.25) and xp.std(csr(spark, close), axis=1).toarray()[0] == pytest.approx(1.25**0.5)
    signs = xp.signbit(csr(spark, x))
    assert isinstance(signs, DenseFrame) and signs.toarray().dtype == bool and np.array_equal(signs.toarray(), x < 0)
    assert not xp.isnan(csr(spark, x)).toarray().any()
    parts = xp.__array_namespace_info__()["capabilities"]
    assert {"matmul", "vecdot"} <= set(parts["linalg"]) and {"sort", "unique_all"} <= set(parts["searching"]) and {"sum", "diff", "var"} <= set(parts["reductions"])


# ---- iterations in depth

@pytest.mark.parametrize(("rows", "columns", "block"), [(40, 3, 100), (200, 4, 7), (333, 5, 5), (64, 8, 8)])
def test_orthonormal_is_numpys_up_to_signs(spark, monkeypatch, rows, columns, block):
    monkeypatch.setattr(qr, "BRANCH", 3)
    rng = np.random.default_rng(rows)
    for spread in (0, 12):
        x = rng.normal(size=(rows, columns)) * 10.0 ** np.linspace(0, -spread, columns)
        records = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{j}" for j in range(columns)]).assign(row=range(rows)))
        got = qr.orthonormal(records, rows, columns, block).toPandas().sort_values("row")[[f"x{j}" for j in range(columns)]].to_numpy()
        want, r = np.linalg.qr(x)
        np.testing.assert_allclose(got, want * np.sign(np.diag(r)), atol=1e-10)
        np.testing.assert_allclose(got.T @ got, np.eye(columns), atol=1e-12)


def test_orthonormal_completes_dependent_columns(spark, monkeypatch):
    monkeypatch.setattr(qr, "BRANCH", 2)
    rng = np.random.default_rng(3)
    x = np.outer(rng.normal(size=90), [1.0, 2.0, 0.0, -1.0])
    records = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{j}" for j in range(4)]).assign(row=range(90)))
    got = qr.orthonormal(records, 90, 4, 10).toPandas().sort_values("row")[[f"x{j}" for j in range(4)]].to_numpy()
    np.testing.assert_allclose(got.T @ got, np.eye(4), atol=1e-12)
    np.testing.assert_allclose(np.abs(got[:, 0]), np.abs(x[:, 0]) / np.linalg.norm(x[:, 0]), atol=1e-12)
    with pytest.raises(ValueError):
        qr.orthonormal(records, 3, 4)


def test_block_power_of_a_matrix_of_rank_one(spark):
    u = np.array([1.0, 2.0, -1.0, 0.5])
    a = csr(spark, np.outer(u, u))
    q, values = algorithms.block_power(a, dense(spark, np.eye(4)[:, :2] + 0.1), 4)
    np.testing.assert_allclose(values, [u @ u, 0.0], atol=1e-12)
    found = q.toarray()
    np.testing.assert_allclose(found.T @ found, np.eye(2), atol=1e-12)


def test_conjugate_gradients_end_over_tables_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "PART_CELLS", 50)
    rng = np.random.default_rng(8)
    m = np.where(rng.random((60, 60)) < 0.05, rng.normal(size=(60, 60)), 0.0)
    m = m + m.T
    np.fill_diagonal(m, np.abs(m).sum(axis=1) + 0.1)
    b = rng.normal(size=60)
    for most in (1_000_000, 0):  # vectors sent to all tasks, and shuffled
        monkeypatch.setattr(algorithms, "BROADCAST_CELLS", most)
        x, rounds, residual = algorithms.cg_solve(csr(spark, m), dense(spark, b), 1e-10, 200, scaled=not most)
        assert residual <= 1e-10 and 5 < rounds < 100
        np.testing.assert_allclose(m @ x.toarray(), b, atol=1e-8)


# ---- stretched and filled tensors, dense input

def dense_of(spark, x):
    return dense(spark, np.asarray(x, dtype=float))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_broadcasting_makes_no_cells_before_they_are_needed(spark):
    rng = np.random.default_rng(4)
    x, y, z, w = rng.normal(size=(4, 5)), rng.normal(size=5), rng.normal(size=(4, 1)), rng.normal(size=(3, 1, 5))
    got = xp.add(dense_of(spark, x), dense_of(spark, y))
    assert "Generate" not in plan_of(got.df) and plan_of(got.df).count("Join") == 1
    np.testing.assert_allclose(got.toarray(), x + y)
    for a, b in ((x, z), (z, y), (w, x), (w, z), (x, np.array(2.5)), (np.array([[3.0]]), w)):
        got = xp.multiply(dense_of(spark, a), dense_of(spark, b))
        assert "Generate" not in plan_of(got.df)
        np.testing.assert_allclose(got.toarray(), a * b)
    stretched = xp.broadcast_to(dense_of(spark, y), (3, 4, 5))
    np.testing.assert_allclose(stretched.toarray(), np.broadcast_to(y, (3, 4, 5)))
    both = xp.subtract(xp.exp(stretched), xp.broadcast_to(dense_of(spark, z), (3, 4, 5)))
    assert "Generate" not in plan_of(both.df) and both.shape == (4, 5) or both.shape == (3, 4, 5)
    np.testing.assert_allclose(both.toarray(), np.broadcast_to(np.exp(y) - z, (3, 4, 5)))
    assert xp.add(dense_of(spark, np.zeros((0, 3))), dense_of(spark, np.ones(3))).toarray().shape == (0, 3)
    with pytest.raises(ValueError):
        xp.add(dense_of(spark, x), dense_of(spark, z[:3]))


def in_tasks(df):
    """The most rows that a task makes, and how many tasks make some."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts), len(counts)


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr("gridweave.frame.TASK_CELLS", 1_000, raising=False)


def test_meshgrid_joins_no_grid(spark, small_tasks):
    x, y, z = np.arange(40.0), np.arange(90.0) / 7, np.array([5.0, -1.0])
    for indexing in ("xy", "ij"):
        for vectors in ((x, y), (z, x, y), (x,), (x, np.zeros(0))):
            got = xp.meshgrid(*[dense_of(spark, v) for v in vectors], indexing=indexing)
            for one, want in zip(got, np.meshgrid(*vectors, indexing=indexing), strict=True):
                assert "Join Inner" not in plan_of(one.df) and one.shape == want.shape
                np.testing.assert_array_equal(one.toarray(), want)
    most, tasks = in_tasks(xp.meshgrid(dense_of(spark, x), dense_of(spark, y))[1].df)
    assert most <= 1_100 and tasks >= 4


def test_a_sum_of_a_column_and_a_row_is_dealt_out(spark, small_tasks):
    x, y = np.arange(120.0), np.arange(100.0) / 3
    got = xp.add(xp.expand_dims(dense_of(spark, x), 1), dense_of(spark, y))
    most, tasks = in_tasks(got.df)
    assert most <= 1_200 and tasks >= 10
    np.testing.assert_array_equal(got.toarray(), x[:, None] + y)


def test_stretched_cells_are_dealt_out(spark, small_tasks):
    x, y, one = np.arange(120.0), np.arange(100.0) / 3, np.array([[7.0]])
    for a, b in ((x[:, None], y), (one, np.zeros((120, 100))), (x[:3, None], np.zeros(4_000))):
        got, want = xp.broadcast_arrays(dense_of(spark, a), dense_of(spark, b))[0], np.broadcast_arrays(a, b)[0]
        most, tasks = in_tasks(got.df)
        assert most <= 1_400 and tasks >= 9
        np.testing.assert_array_equal(got.toarray(), want)


def test_a_product_of_a_column_and_a_row_is_dealt_out(spark, small_tasks):
    x, y = np.arange(120.0), np.arange(100.0) / 3
    for a, b in ((x[:, None], y), (np.arange(1.0, 21).reshape(2, 10, 1), np.arange(3_000.0)), (np.arange(2_000.0).reshape(20, 100, 1), np.arange(3_000.0).reshape(100, 30))):
        got = xp.multiply(dense_of(spark, a), dense_of(spark, b))
        most, tasks = in_tasks(got.df)
        assert most <= 2_000 and tasks >= 5
        np.testing.assert_array_equal(got.toarray(), a * b)


def test_equal_sums_rank_by_place_however_their_rows_are_dealt_out(spark, tmp_path):
    from gridweave.format_queries import SHIFT
    from gridweave.queries import QUERIES

    pick = np.random.default_rng(1)
    triple = next(x for x in (pick.integers(1, 9_999, 3) / 100 for _ in range(1_000)) if ((y := x - SHIFT)[0] + y[1]) + y[2] > y[0] + (y[1] + y[2]))
    rows = [(3 * user + n, user, float(v)) for user in (0, 1) for n, v in enumerate(triple)]
    split = [[r for r in rows if r[0] in (0, 1, 3)], [r for r in rows if r[0] in (2, 4, 5)]]
    for part in split:
        df = spark.createDataFrame(part, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp'2024-01-01 00:00:00' as ts", "user_id", "'click' as event_type", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["argsort_missing"](spark, str(tmp_path)).where("col = 0").orderBy("row")
    assert [r["val"] for r in got.collect()] == [0, 1]


def test_results_are_rounded_as_the_sql_rounds_them(spark):
    v = np.concatenate([np.arange(-3000.0, 3000) / 102400, np.arange(1.0, 2000) / 1e5, [1e300, -1e-300, 0.0, np.inf, -np.inf, np.nan, 2.0**53 + 2]])
    scaled = v * 1e4
    with np.errstate(all="ignore"):
        whole = np.trunc(scaled)
        want = (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 1e4
    want = np.where(np.isfinite(want), want, v)
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in zip(v, want, strict=True)], "v double, want double")
    assert rows.where(~expr.rounded(F.col("v"), 4).eqNullSafe(F.col("want"))).count() == 0


def test_where_takes_numbers_and_shapes_that_broadcast(spark, pair):
    a = pair[0]
    x = dense_of(spark, a)
    cond = xp.greater(x, 0.0)
    np.testing.assert_array_equal(xp.where(cond, x, 0.0).toarray(), np.where(a > 0, a, 0.0))
    np.testing.assert_array_equal(xp.where(cond, 1.0, -1.0).toarray(), np.where(a > 0, 1.0, -1.0))
    row, col = np.arange(7.0), np.arange(5.0)[:, None]
    np.testing.assert_array_equal(xp.where(cond, dense_of(spark, row), dense_of(spark, col)).toarray(), np.where(a > 0, row, col))
    np.testing.assert_array_equal(xp.where(csr(spark, a), x, dense_of(spark, col)).toarray(), np.where(a != 0, a, col))


def test_filled_tensors_hold_stored_cells_alone(spark, pair):
    a, b = pair
    with np.errstate(all="ignore"):
        for name in ("exp", "cos", "log", "acosh", "log2", "isnan", "isfinite", "logical_not"):
            got, want = getattr(xp, name)(csr(spark, a)), getattr(np, {"acosh": "arccosh"}.get(name, name))(a)
            assert got.nnz == np.count_nonzero(a)
            np.testing.assert_allclose(got.toarray(), want)
    equal = xp.equal(csr(spark, a), 0.0)
    assert equal.nnz == np.count_nonzero(a) and "Range" not in plan_of(equal.stored)
    np.testing.assert_array_equal(equal.toarray(), a == 0)
    np.testing.assert_array_equal(equal.df.count(), a.size)
    less = xp.less(csr(spark, a), csr(spark, b))
    assert less.nnz == np.count_nonzero((a != 0) | (b != 0))
    np.testing.assert_array_equal(less.toarray(), a < b)
    np.testing.assert_allclose(xp.add(xp.exp(csr(spark, a)), xp.cos(csr(spark, b))).toarray(), np.exp(a) + np.cos(b))
    mixed = xp.multiply(xp.exp(csr(spark, a)), dense_of(spark, b))
    assert "Range" not in plan_of(mixed.df)
    np.testing.assert_allclose(mixed.toarray(), np.exp(a) * b)
    np.testing.assert_allclose(xp.sum(xp.exp(csr(spark, a)), axis=1).toarray(), np.exp(a).sum(1))


def test_reductions_of_filled_tensors_count_missing_cells(spark, pair):
    a = pair[0]
    hole = np.where(a == a.max(), np.nan, a)
    with np.errstate(all="ignore"):
        for x, want in ((xp.exp(csr(spark, a)), np.exp(a)), (xp.cos(csr(spark, hole)), np.cos(hole)), (xp.log(csr(spark, a)), np.log(a))):
            assert isinstance(x.nnz, int)
            for name in ("sum", "mean", "prod", "min", "max"):
                for axis in (None, 0, 1):
                    got = getattr(xp, name)(x, axis=axis)
                    np.testing.assert_allclose(got.toarray(), getattr(np, name)(want, axis=axis), err_msg=f"{name} {axis}")
    for x, want in ((xp.equal(csr(spark, a), 0.0), a == 0), (xp.not_equal(csr(spark, a), 0.0), a != 0), (xp.less(csr(spark, a), 9.0), a < 9)):
        for name in ("all", "any"):
            for axis in (None, 0, 1):
                np.testing.assert_array_equal(getattr(xp, name)(x, axis=axis, keepdims=True).toarray(), getattr(np, name)(want, axis=axis, keepdims=True))
    assert "Range" not in plan_of(xp.sum(xp.exp(csr(spark, a))).df)


def test_dense_input_is_taken_as_numpy_takes_it(spark):
    rng = np.random.default_rng(9)
    x, y, w = rng.normal(size=(3, 4)), rng.normal(size=(3, 4)), rng.normal(size=(2, 3, 4))
    dx, dy, dw = (dense_of(spark, v) for v in (x, y, w))
    np.testing.assert_allclose(xp.vecdot(dx, dy).toarray(), (x * y).sum(-1))
    np.testing.assert_allclose(xp.vecdot(dw, dy).toarray(), (w * y).sum(-1))
    np.testing.assert_allclose(xp.vecdot(dw, dy, axis=-2).toarray(), (w * y).sum(-2))
    np.testing.assert_allclose(xp.tensordot(dx, dy).toarray(), np.tensordot(x, y))
    np.testing.assert_allclose(xp.tensordot(dw, dense_of(spark, x.T), axes=1).toarray(), np.tensordot(w, x.T, 1))
    np.testing.assert_allclose(xp.tensordot(dw, dy, axes=([1, 2], [0, 1])).toarray(), np.tensordot(w, y, ([1, 2], [0, 1])))
    np.testing.assert_allclose(xp.tensordot(dx, dense_of(spark, [1.0, 2.0]), axes=0).toarray(), np.tensordot(x, [1.0, 2.0], 0))
    np.testing.assert_allclose(xp.matrix_transpose(dw).toarray(), np.swapaxes(w, -1, -2))
    assert xp.astype(dx, np.int64).toarray().dtype == np.int64 and xp.astype(dx, bool).toarray().all()
    np.testing.assert_array_equal(xp.astype(dx, np.int64).toarray(), x.astype(np.int64))
    for k in (-1, 0, 2):
        np.testing.assert_array_equal(xp.tril(dw, k=k).toarray(), np.tril(w, k))
        np.testing.assert_array_equal(xp.triu(dx, k=k).toarray(), np.triu(x, k))
    np.testing.assert_array_equal(xp.tile(dx, (2, 1, 3)).toarray(), np.tile(x, (2, 1, 3)))
    np.testing.assert_array_equal(xp.concat([dx, dw], axis=None).toarray(), np.concatenate([x, w], axis=None))
    np.testing.assert_array_equal(xp.reshape(dw, (-1, 6)).toarray(), w.reshape(-1, 6))
    np.testing.assert_array_equal(xp.reshape(dw, (2, -1)).toarray(), w.reshape(2, -1))
    np.testing.assert_array_equal(xp.nextafter(dx, dy).toarray(), np.nextafter(x, y))
    np.testing.assert_array_equal(xp.nextafter(dx, 1.0).toarray(), np.nextafter(x, 1.0))
    for axis in (0, 1, 2, -1):
        np.testing.assert_allclose(xp.cumulative_sum(dw, axis=axis).toarray(), np.cumsum(w, axis))
        np.testing.assert_allclose(xp.cumulative_prod(dw, axis=axis).toarray(), np.cumprod(w, axis))
        np.testing.assert_allclose(xp.diff(dw, axis=axis).toarray(), np.diff(w, axis=axis))
    hole = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]])
    for axis in (None, 0, 1):
        np.testing.assert_array_equal(xp.max(dense_of(spark, hole), axis=axis).toarray(), hole.max(axis))
        np.testing.assert_array_equal(xp.min(dense_of(spark, hole), axis=axis).toarray(), hole.min(axis))
    with pytest.raises(ValueError):
        xp.reshape(dw, (-1, 7))


@pytest.mark.parametrize("chunk", [3, 65_536])
def test_running_sums_of_sparse_tensors_join_no_grid(spark, monkeypatch, chunk):
    monkeypatch.setattr(reductions, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    a = np.where(rng.random((3, 8, 4)) < 0.4, rng.normal(size=(3, 8, 4)), 0.0)
    a[0, :, 1], a[1] = rng.normal(size=8), 0
    x = sparse(spark, a, "coond")
    for axis in (0, 1, 2):
        np.testing.assert_allclose(xp.cumulative_sum(x, axis=axis).toarray(), np.cumsum(a, axis), atol=1e-12)
        got = xp.cumulative_prod(x, axis=axis)
        assert "Range" not in plan_of(got.stored)
        np.testing.assert_allclose(got.toarray(), np.cumprod(a, axis), atol=1e-12)
    plan = plan_of(xp.cumulative_sum(x, axis=1).df)
    assert "LeftOuter" not in plan and "Join" not in plan or chunk == 3


@pytest.mark.parametrize("line", [2, 1_000_000])
def test_sorting_of_long_lines_by_ranges(spark, monkeypatch, line):
    monkeypatch.setattr(searching, "LONG_LINE", line)
    rng = np.random.default_rng(6)
    a = rng.integers(-3, 4, (4, 30)).astype(float)
    a[1, ::7] = np.nan
    x = dense_of(spark, a)
    for axis in (0, 1):
        np.testing.assert_array_equal(xp.sort(x, axis=axis).toarray(), np.sort(a, axis))
        np.testing.assert_array_equal(xp.sort(x, axis=axis, descending=True).toarray(), np.flip(np.sort(a, axis), axis))
        np.testing.assert_array_equal(xp.argsort(x, axis=axis).toarray(), np.argsort(a, axis, kind="stable"))
    v = np.array([2.0, np.nan, -1.0, 2.0])
    np.testing.assert_array_equal(xp.sort(dense_of(spark, v), descending=True).toarray(), [np.nan, 2, 2, -1])


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_products_by_blocks_of_columns_and_batches(spark, monkeypatch, sent, pair):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", sent)
    monkeypatch.setattr(linalg, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(linalg, "HOT_CELLS", 2)
    a, rng = pair[0], np.random.default_rng(2)
    for shape in ((7, 1), (7, 2), (7, 8), (2, 7, 4), (2, 3, 7, 5), (7,)):
        b = rng.normal(size=shape)
        for fmt in ("csr", "csc", "coo"):
            np.testing.assert_allclose((sparse(spark, a, fmt) @ dense_of(spark, b)).toarray(), a @ b, atol=1e-12)


def test_a_batch_is_one_row_of_blocks_joined_in_few_tasks(spark, monkeypatch, pair):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    a, rng = pair[0], np.random.default_rng(12)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for shape in ((8, 7, 16), (3, 2, 7, 11), (7, 64), (7, 65), (2, 7, 1)):
            b = rng.normal(size=shape)
            got = csr(spark, a) @ dense_of(spark, b)
            blocks = -(-b.size // 7 // 64)
            plan = got.df._jdf.queryExecution().executedPlan().toString()
            assert f"Range (0, {5 * blocks}, " in plan and plan.count(f", {spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM") == 2
            np.testing.assert_allclose(got.toarray(), a @ b, atol=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_a_hot_column_is_dealt_to_many_tasks(spark):
    n = 20_000
    cells = spark.range(2 * n).selectExpr("id % 20000 as row", "if(id < 20000, 5, id % 4000) as col", "cast(1 as double) as val")
    right = spark.range(4000).selectExpr("id as _k", "cast(id as double) as _w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = linalg.met(cells.withColumnRenamed("col", "_k"), right, "_k", sent=False, hot_cells=1_000)
        sizes = [r["count"] for r in both.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2 * n and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert both.agg(F.sum("_w")).first()[0] == n * 5 + sum(i % 4000 for i in range(n, 2 * n))


def test_tiles_are_blocks_of_rows_in_order(spark, tmp_path, pair):
    a = pair[0]
    for x in (csr(spark, a), dense_of(spark, a), xp.exp(csr(spark, a))):
        want = np.exp(a) if isinstance(x, DenseFrame) and hasattr(x, "stored") else a
        parts = list(x.tiles(15))
        assert [first for first, _ in parts] == [0, 2, 4] and all(p.size <= 15 for _, p in parts)
        np.testing.assert_allclose(np.concatenate([p for _, p in parts]), want)
    cube = np.arange(24.0).reshape(4, 3, 2)
    np.testing.assert_array_equal(np.concatenate([p for _, p in dense_of(spark, cube).tiles(1)]), cube)
    rows = tiles.write(csr(spark, a), str(tmp_path / "tiles"), 15)
    np.testing.assert_array_equal(np.concatenate([p for _, p in tiles.read(spark, str(tmp_path / "tiles"), a.shape, rows)]), a)


def test_matrix_market_files(spark, tmp_path, pair):
    a = pair[0]
    folder = str(tmp_path / "whole")
    matrix_market.write(csr(spark, a), folder)
    for split in (7, 1 << 20):
        back = matrix_market.read(spark, folder, "csr", split)
        assert back.shape == a.shape
        np.testing.assert_array_equal(back.toarray(), a)
    head = "%%MatrixMarket matrix coordinate {} {}\n% a remark\n%\n{}\n"
    cells = [(i + 1, j + 1, round(0.25 * (i - j) + i, 3)) for i in range(60) for j in range(i + 1) if (i * j) % 3 != 1]
    low = np.zeros((60, 60))
    for i, j, v in cells:
        low[i - 1, j - 1] = v
    off = np.tril(low, -1)
    texts = {
        ("real", "symmetric"): ("".join(f"{i} {j} {v}\n" for i, j, v in cells), low + off.T),
        ("real", "skew-symmetric"): ("".join(f"{i} {j} {v}\n" for i, j, v in cells if i != j), off - off.T),
        ("integer", "general"): ("\n".join(f"{i}   {j} {int(v)}" for i, j, v in cells) + "\n\n", np.trunc(low)),
        ("pattern", "symmetric"): ("\r\n".join(f"{i} {j}" for i, j, _ in cells), None),
    }
    ones = np.zeros((60, 60))
    for i, j, _ in cells:
        ones[i - 1, j - 1] = ones[j - 1, i - 1] = 1
    for (field, symmetry), (body, want) in texts.items():
        path = tmp_path / f"{field}-{symmetry}.mtx"
        path.write_text(head.format(field, symmetry, f"60 60 {len(cells)}") + body)
        for split in (1, 50, 1 << 20) if field == "pattern" else (37, 1 << 20):
            if split == 1:
                continue
            got = matrix_market.read(spark, str(path), split_bytes=split)
            np.testing.assert_allclose(got.toarray(), ones if want is None else want)
    with pytest.raises(ValueError):
        (tmp_path / "array.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n1\n")
        matrix_market.read_header(str(tmp_path / "array.mtx"))
    empty = csr(spark, np.zeros((3, 4)))
    matrix_market.write(empty, str(tmp_path / "empty"))
    np.testing.assert_array_equal(matrix_market.read(spark, str(tmp_path / "empty")).toarray(), np.zeros((3, 4)))
