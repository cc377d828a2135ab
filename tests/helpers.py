import numpy as np

import lattix as xp

rng = np.random.default_rng(0)
M = rng.normal(size=(7, 5))
T3 = rng.integers(0, 50, (4, 5, 6))
N = M.copy()
N[rng.random(M.shape) < 0.3] = np.nan
N[:, 0], N[0] = 1, 2
C = M[:3] + 1j * M[3:6]


def make(a, chunks):
    return xp.from_array(np.asarray(a), chunks=chunks)


def same(got, want, tol=1e-9):
    """Equal shape, dtype and values; floats within a relative tolerance."""
    got = got.compute() if isinstance(got, xp.Array) else got
    want = np.asarray(want)
    assert got.shape == want.shape
    assert got.dtype == want.dtype
    if want.dtype.kind in "fc":
        np.testing.assert_allclose(got, want, rtol=tol, atol=1e-12)
    else:
        np.testing.assert_array_equal(got, want)
