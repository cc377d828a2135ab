"""Random arrays."""

from __future__ import annotations

import random as _random
from numbers import Integral

import numpy as np
from pyspark.sql import functions as F

from ..array import Array
from ..functions import ieee
from .blocks import block_source


def random(size, *, dtype=np.float64, chunks=None, spec=None, seed: int | None = None) -> Array:
    """Uniform in [0, 1): a Philox stream for each block, keyed by the seed plus the block's number."""
    shape = (size,) if isinstance(size, Integral) else tuple(size)
    root = _random.getrandbits(128) if seed is None else seed
    dtype = np.dtype(dtype)
    from .. import meta

    counts = [len(c) for c in meta.normalize_chunks(chunks or "auto", shape, dtype)]

    def make(block, slices):
        number = int(np.ravel_multi_index(block, counts)) if block else 0
        generator = np.random.Generator(np.random.Philox(key=(root + number) % (1 << 128)))
        return generator.random([s.stop - s.start for s in slices], dtype=dtype)

    return block_source(make, shape, dtype, chunks or "auto", spec)


def integers(shape, *, dtype=np.int32, chunks=None, spec=None) -> Array:
    """A 32-bit hash of the flat index, whatever the chunks.

    Wang's integer hash, a fixed published formula: xor with 61 and a shift by 16, times 9, xor with a shift by 4,
    times 0x27D4EB2D, xor with a shift by 15, all modulo 2^32; the bits are read as a signed number.
    """
    shape = (shape,) if isinstance(shape, Integral) else tuple(shape)
    low = F.lit(0xFFFFFFFF)

    def value(c):
        from .manipulation import _linear

        x = _linear(c, shape).bitwiseAND(low)
        right = lambda v, n: F.call_function("shiftright", v, F.lit(n))
        x = x.bitwiseXOR(F.lit(61)).bitwiseXOR(right(x, 16))
        x = (x * 9).bitwiseAND(low)
        x = x.bitwiseXOR(right(x, 4))
        x = (x * 0x27D4EB2D).bitwiseAND(low)
        x = x.bitwiseXOR(right(x, 15))
        return ieee.cast(ieee.wrap(x, np.int32), np.int32, dtype)

    return Array(None, value, shape, dtype, chunks or "auto", spec)
