"""Indexing, manipulation, reductions, scans, search, groups and contractions against NumPy."""

import numpy as np
import pytest
from helpers import M, N, T3, make, same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import lattix as xp


@pytest.fixture(scope="module")
def m(spark):
    return make(M, (3, 2))


@pytest.fixture(scope="module")
def t3(spark):
    return make(T3, (2, 3, 4))


@pytest.fixture(scope="module")
def nn(spark):
    return make(N, (3, 2))


KEYS = [np.s_[2], np.s_[-1], np.s_[1:6:2], np.s_[::-1], np.s_[6:0:-3], np.s_[:, 1], np.s_[..., 2], np.s_[None, 1:3], np.s_[3, None, ::2], np.s_[0:0], (np.array([3, 0, 0, -1]),), (slice(None), np.array([1, 1])), np.s_[2, 3]]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_index(m, key):
    same(m[key], M[key])


def test_index_errors(m):
    for bad, error in ((np.s_[9], IndexError), (np.s_[0, 0, 0], IndexError), ((np.array([0]), np.array([1])), NotImplementedError), (M > 0, NotImplementedError), (np.s_[..., ...], IndexError)):
        with pytest.raises(error):
            m[bad]


def test_blocks_and_take(m, t3):
    same(m.blocks[1, 0], M[3:6, :2])
    same(m.blocks[[0, 2]], M[[0, 1, 2, 6]])
    same(m.blocks[:, -1], M[:, 4:])
    assert m.blocks.shape == (3, 3)
    same(xp.take(t3, np.array([2, 0]), axis=1), T3.take([2, 0], 1))
    same(xp.take(t3, np.array([5, 7])), T3.take([5, 7]))
    same(m[xp.asarray(np.array([1, 2]))], M[[1, 2]])


def test_manipulation(m, t3):
    same(xp.permute_dims(t3, (2, 0, 1)), T3.transpose(2, 0, 1))
    same(t3.mT, T3.swapaxes(1, 2))
    same(xp.moveaxis(t3, 0, -1), np.moveaxis(T3, 0, -1))
    same(xp.reshape(t3, (8, -1)), T3.reshape(8, -1))
    same(xp.flip(t3, axis=(0, 2)), np.flip(T3, (0, 2)))
    same(xp.roll(m, 2), np.roll(M, 2))
    same(xp.roll(m, (1, -2), axis=(0, 1)), np.roll(M, (1, -2), (0, 1)))
    same(xp.concat([m, m], axis=1), np.concatenate([M, M], 1))
    same(xp.concat([m, t3.astype("float64")], axis=None), np.concatenate([M, T3], None))
    same(xp.stack([m, m], axis=1), np.stack([M, M], 1))
    same(xp.unstack(m, axis=1)[2], M[:, 2])
    same(xp.expand_dims(m, (0, -1)), np.expand_dims(M, (0, -1)))
    same(xp.squeeze(m[:1], 0), M[0])
    same(xp.repeat(m, 3, axis=1), M.repeat(3, 1))
    same(xp.tile(m, (2, 1, 3)), np.tile(M, (2, 1, 3)))
    same(xp.pad(m, ((1, 2), (0, 3)), constant_values=9.0), np.pad(M, ((1, 2), (0, 3)), constant_values=9))
    same(xp.pad(m, ((1, 0), (0, 0)), "symmetric"), np.pad(M, ((1, 0), (0, 0)), "symmetric"))
    same(xp.broadcast_to(m[0], (3, 5)), np.broadcast_to(M[0], (3, 5)))
    with pytest.raises(ValueError):
        xp.stack([m, m[:2]])
    with pytest.raises(ValueError):
        xp.reshape(m, (4, 4))


def test_creation():
    same(xp.eye(4, 5, k=1), np.eye(4, 5, 1))
    same(xp.linspace(1, 2, 7), np.linspace(1, 2, 7))
    same(xp.linspace(1, 2, 0), np.linspace(1, 2, 0))
    same(xp.arange(1.0, 4.0, 0.3), np.arange(1.0, 4.0, 0.3))
    same(xp.arange(9, 0, -2), np.arange(9, 0, -2))
    same(xp.full((2, 2), 7), np.full((2, 2), 7))
    same(xp.tril(make(M, (3, 2)), k=-1), np.tril(M, -1))
    same(xp.triu(make(M, (3, 2)), k=1), np.triu(M, 1))
    for how in ("xy", "ij"):
        for got, want in zip(xp.meshgrid(xp.arange(3), xp.arange(4), indexing=how), np.meshgrid(np.arange(3), np.arange(4), indexing=how), strict=True):
            same(got, want)
    with pytest.raises(ValueError):
        xp.asarray(np.zeros(200_000))
    big = np.arange(300_000.0).reshape(300, 1000)
    same(xp.from_array(big, chunks=(100, 400))[::7, ::9], big[::7, ::9])


@pytest.mark.parametrize("axis", [None, 0, 1, (0, 1)])
def test_reductions(m, nn, axis):
    for name in "sum mean max min prod var std".split():
        same(getattr(xp, name)(m, axis=axis, keepdims=axis == 0), getattr(np, name)(M, axis=axis, keepdims=axis == 0))
    for name in "nansum nanmean nanmax nanmin nanprod nanvar nanstd max min".split():
        same(getattr(xp, name)(nn, axis=axis), getattr(np, name)(N, axis=axis))


@pytest.mark.parametrize("axis", [None, 0, 1])
def test_arg_reductions_and_scans(m, nn, t3, axis):
    for name in ("argmax", "argmin"):
        same(getattr(xp, name)(t3, axis=axis), getattr(np, name)(T3, axis=axis))
        same(getattr(xp, name)(nn, axis=axis), getattr(np, name)(N, axis=axis))
        same(getattr(xp, "nan" + name)(nn, axis=axis), getattr(np, "nan" + name)(N, axis=axis))
    same(xp.cumulative_sum(m, axis=axis), M.cumsum(axis))
    same(xp.cumulative_prod(m, axis=axis), M.cumprod(axis))
    same(xp.nancumsum(nn, axis=axis), np.nancumsum(N, axis))
    same(xp.nancumprod(nn, axis=axis), np.nancumprod(N, axis))


def test_more_reductions(m, nn, t3):
    same(xp.nanmedian(nn, axis=1), np.nanmedian(N, 1))
    same(xp.var(m, axis=0, correction=1.0), M.var(0, ddof=1))
    same(xp.all(m > -1, axis=0), (M > -1).all(0))
    same(xp.any(m > 1, axis=1), (M > 1).any(1))
    same(xp.count_nonzero(t3, axis=1), np.count_nonzero(T3, 1))
    same(xp.sum(xp.zeros((0, 3)), axis=0), np.zeros(3))
    same(xp.all(xp.zeros((0,), dtype=bool)), np.array(True))
    same(xp.var(make([4 + 1e9, 7 + 1e9, 13 + 1e9, 16 + 1e9], 2)), np.float64(22.5))
    with pytest.raises(ValueError):
        xp.max(xp.zeros((0,)))
    with pytest.raises(Exception, match="All-NaN"):
        xp.nanargmax(make([[np.nan, np.nan], [1.0, 2.0]], 2), axis=1).compute()


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 5, 23])
def test_scan_any_number_of_blocks(chunk):
    same(xp.cumulative_sum(make(np.arange(23), chunk)), np.arange(23).cumsum())


def test_scan_others(m):
    a = np.array([3, 1, 4, 1, 5, 9, 2, 6])
    same(xp.scan(make(a, 3), "max", axis=0), np.maximum.accumulate(a))
    same(xp.cumulative_sum(m, axis=1, include_initial=True), np.concatenate([np.zeros((7, 1)), M.cumsum(1)], 1))


def test_diff(m, t3):
    for n in (0, 1, 2, 3):
        same(xp.diff(t3, n=n, axis=1), np.diff(T3, n=n, axis=1))
    same(xp.diff(m, axis=0, prepend=m[:1], append=m[:1]), np.diff(M, axis=0, prepend=M[:1], append=M[:1]))


def test_search(t3, monkeypatch):
    s = np.sort(np.random.default_rng(1).integers(0, 30, 20))
    for side in ("left", "right"):
        same(xp.searchsorted(make(s, 7), t3, side=side), np.searchsorted(s, T3, side))
    same(xp.isin(t3, make(s, 7)), np.isin(T3, s))
    same(xp.isin(t3, make(s, 7), invert=True), np.isin(T3, s, invert=True))
    monkeypatch.setattr("lattix.operators.searching.MAX_SENT_BYTES", 64)
    same(xp.searchsorted(make(s, 7), t3), np.searchsorted(s, T3))


def test_groupby(m):
    labels = np.array([0, 1, 0, 3, 1, 1, 3])
    by = make(labels, 3)
    same(xp.groupby_reduction(m, by, "sum", axis=0, num_groups=5), np.stack([M[labels == g].sum(0) for g in range(5)]))
    same(xp.groupby_reduction(m, by, "mean", axis=0, num_groups=4)[0], M[labels == 0].mean(0))
    same(xp.groupby_blockwise(m, xp.arange(7) // 3, "max", axis=0), np.stack([M[:3].max(0), M[3:6].max(0), M[6]]))
    mean = xp.Aggregation(lambda v: (len(v), v.sum()), lambda parts: parts.sum(0), lambda r: r[1] / r[0], 2)
    same(xp.groupby_reduction(m, by, mean, axis=0, num_groups=4)[1], M[labels == 1].mean(0))


def test_contractions(m, t3, monkeypatch):
    same(m.T @ m, M.T @ M)
    same(m @ m[0], M @ M[0])
    same(xp.matmul(t3, xp.permute_dims(t3, (0, 2, 1))), T3 @ T3.transpose(0, 2, 1))
    same(xp.tensordot(t3, t3, axes=((0, 2), (0, 2))), np.tensordot(T3, T3, ((0, 2), (0, 2))))
    same(xp.vecdot(m, m), (M * M).sum(1))
    same(xp.linalg.outer(m[0], m[1]), np.outer(M[0], M[1]))
    monkeypatch.setattr("lattix.operators.linalg.PRODUCT_BLOCK", 2)
    same(m.T @ m, M.T @ M)
    with pytest.raises(ValueError):
        m @ m


def test_qr_svd(monkeypatch):
    monkeypatch.setattr("lattix.operators.linalg.STACK_ROWS", 6)  # several levels
    w = np.random.default_rng(5).normal(size=(37, 3))
    x = make(w, (5, 3))
    q, r = xp.linalg.qr(x)
    same(q.compute() @ r.compute(), w, 1e-8)
    np.testing.assert_allclose(q.compute().T @ q.compute(), np.eye(3), atol=1e-8)
    u, s, vt = xp.linalg.svd(x, full_matrices=False)
    same((u.compute() * s.compute()) @ vt.compute(), w, 1e-8)
    same(xp.linalg.svdvals(x.T.rechunk((3, 5))), np.linalg.svd(w)[1], 1e-8)
    with pytest.raises(TypeError):
        xp.linalg.qr(xp.ones((4, 2), dtype="int64"))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 7), min_size=2, max_size=2), st.integers(0, 2))
def test_results_do_not_depend_on_chunks(chunks, n):
    x = make(M, tuple(chunks))
    same(xp.diff(xp.cumulative_sum(x, axis=0), n=n, axis=0), np.diff(M.cumsum(0), n=n, axis=0), 1e-7)
    same(xp.map_blocks(lambda b: b + 1, x), M + 1)


def test_outer_is_dealt_over_tasks(spark):
    """rows of one file that a product multiplies aren't multiplied by one task."""
    n = 1200
    v = xp.from_table(spark.range(n, numPartitions=1).selectExpr("id", "id * 0.5D AS v"), ["id"], "v", (n,))
    product = xp.linalg.outer(v, v)
    assert product.cells().rdd.getNumPartitions() > 1
    same(product, np.outer(np.arange(n) * 0.5, np.arange(n) * 0.5))


def test_rounding_by_arithmetic(spark):
    """the rounding of many results is that of F.round and of SQL."""
    import duckdb
    from pyspark.sql import functions as F

    from lattix.plans.queries import _round

    values = [0.0, -0.0, 0.5, -0.5, 2.5e-6, -2.5e-6, 1.0000005, 0.4999999, 1 / 3, -1 / 3, 1e15 + 0.5, -1e300, 4e9 + 1e-7, 123.456789, float("nan"), float("inf"), -float("inf"), None]
    values += [a * b / 100 for a, b in zip(range(-99999, 99999, 1111), range(31, 9999), strict=False)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", _round(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    con = duckdb.connect()
    for x, a, b in df.collect():
        assert a == b or a != a and b != b
        if x is not None and abs(x) < 1e300:
            assert a == con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0]


def test_compute_sends_few_bytes(spark, monkeypatch):
    """an array comes to the driver without a coordinate for each element and axis."""
    from lattix.plans import runtime

    shape = (500, 400)
    monkeypatch.setattr(runtime, "PACKED_ELEMENTS", 1000, raising=False)
    want = np.random.default_rng(1).integers(0, 1 << 40, shape)
    x = xp.from_array(want, chunks=(120, 400))
    before = max(s.stageId() for s in runtime._stages()) if runtime._stages() else -1
    same(x, want)
    sent = sum(s.resultSize() for s in runtime._stages() if s.stageId() > before)
    assert want.nbytes <= sent < 1.5 * want.nbytes
    mixed = xp.permute_dims(xp.from_array(want, chunks=(70, 90)), (1, 0))
    for dtype in ("float32", "uint64", "complex128", "bool"):
        same(mixed.astype(dtype), want.T.astype(dtype))
    one = xp.from_table(spark.range(5000).selectExpr("(id * 3001) % 5000 AS i", "id AS v").repartition(3), ["i"], "v", (5000,))
    same(one, np.argsort(np.arange(5000) * 3001 % 5000))
    short = xp.from_table(spark.range(4999).selectExpr("id AS i", "id AS v"), ["i"], "v", (5000,))
    with pytest.raises(RuntimeError, match="4999 elements"):
        short.compute()
