"""All elementwise functions against NumPy, over grids of special values."""

import numpy as np
import pytest
from helpers import C, M, make, same

import lattix as xp
from lattix.operators.elementwise import NAMES

NUMPY = {"acos": "arccos", "acosh": "arccosh", "asin": "arcsin", "asinh": "arcsinh", "atan": "arctan", "atanh": "arctanh", "atan2": "arctan2", "pow": "power", "bitwise_left_shift": "left_shift", "bitwise_right_shift": "right_shift", "bitwise_invert": "invert"}
SPECIAL = np.array([0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 3.5, 0.5, np.inf, -np.inf, np.nan, 1e300, -7.3, 2.0])
ONE = "abs acos acosh asin asinh atan atanh ceil cos cosh exp expm1 floor isfinite isinf isnan log log1p log2 log10 negative positive reciprocal round sign signbit sin sinh sqrt square tan tanh trunc".split()
TWO = "add atan2 copysign divide equal floor_divide greater greater_equal hypot less less_equal logaddexp maximum minimum multiply nextafter not_equal pow remainder subtract".split()
INTS = "add subtract multiply floor_divide remainder bitwise_and bitwise_or bitwise_xor minimum maximum less equal".split()


def as_table(results, base):
    """Many results over one table, computed in one job."""
    df = base.select("d0", *[x.column.alias(k) for k, x in results.items()]).toPandas().sort_values("d0")
    return {k: df[k].to_numpy() for k in results}


def test_there_are_67_functions():
    assert len(NAMES) == 67
    assert all(hasattr(xp, n) for n in NAMES)


@pytest.mark.filterwarnings("ignore")
def test_floats():
    a, b = (v.ravel() for v in np.meshgrid(SPECIAL, SPECIAL))
    x, y = make(a, 50), make(b, 50)
    for name in ONE + TWO:
        args, values = ((x,), (a,)) if name in ONE else ((x, y), (a, b))
        with np.errstate(all="ignore"):
            same(getattr(xp, name)(*args), getattr(np, NUMPY.get(name, name))(*values))


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("dtype", ["int8", "int32", "int64", "uint8", "uint64"])
def test_integers_wrap(dtype):
    info = np.iinfo(dtype)
    values = sorted({min(max(v, int(info.min)), int(info.max)) for v in (int(info.min), int(info.min) + 1, -127, -7, -1, 0, 1, 3, 7, 127, int(info.max) - 1, int(info.max))})
    v = np.array(values, dtype)
    a, b = (z.ravel() for z in np.meshgrid(v, v))
    x, y, shifts = make(a, 50), make(b, 50), (np.abs(b.astype(object)) % (8 * a.dtype.itemsize)).astype(dtype)
    results = {n: getattr(xp, n)(x, y) for n in INTS} | {n: getattr(xp, n)(x, make(shifts, 50)) for n in ("bitwise_left_shift", "bitwise_right_shift")}
    with np.errstate(all="ignore"):
        for name, got in results.items():
            same(got, getattr(np, NUMPY.get(name, name))(a, shifts if "shift" in name else b))
        same(abs(x), abs(a))
        same(~x, ~a)
        same(xp.square(x), a * a)
        same(xp.sum(x), a.sum())
        same(xp.prod(make(v, 4)), v.prod())
        same(xp.cumulative_sum(make(v, 4)), v.cumsum())
        same(xp.cumulative_prod(make(v, 4)), v.cumprod())
        for other in ("int8", "uint16", "float32", "bool"):
            same(x.astype(other), a.astype(other))


def test_complex():
    c = make(C, (2, 2))
    same(c * c, C * C)
    same(c / c, C / C)
    same(xp.exp(c), np.exp(C))
    same(xp.conj(c), C.conj())
    same(xp.real(c), C.real)
    same(abs(c), abs(C))
    same(c == c, C == C)
    same(xp.sum(c, axis=0), C.sum(0))
    same(xp.mean(c), C.mean())
    same(xp.prod(c, axis=1), C.prod(1))


def test_broadcasting_and_scalars():
    m = make(M, (3, 2))
    same(m + make(M[0], 2), M + M[0])
    same(m[:, :1] * m[:1], M[:, :1] * M[:1])
    same(2 * m - 1, 2 * M - 1)
    same(1 / m, 1 / M)
    same(m * xp.ones((7, 5)), M)
    same(xp.arange(7)[:, None] + xp.arange(5), np.arange(7)[:, None] + np.arange(5))
    same(m + xp.reshape(xp.arange(7.0), (7, 1)), M + np.arange(7.0)[:, None])
    same(xp.where(m > 0, m, 0.0), np.where(M > 0, M, 0))
    same(xp.clip(m, -0.5, 0.5), M.clip(-0.5, 0.5))


def test_arrays_over_one_table_need_no_join():
    m = make(M, (3, 2))
    plan = xp.visualize(2 * m * m + xp.sqrt(abs(m)) - xp.ones((7, 5)))
    assert "Join" not in plan


def test_dtype_gates():
    i, f, b = xp.arange(3), xp.arange(3.0), xp.asarray([True, False, True])
    for bad in (lambda: i / i, lambda: b + b, lambda: xp.sqrt(i), lambda: ~f, lambda: xp.logical_and(i, i), lambda: i + 1.5, lambda: b + 1, lambda: xp.conj(f)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(OverflowError):
        xp.asarray(np.array([1], np.int8)) + 1000
    with pytest.raises(TypeError):
        xp.add(1, 2)
