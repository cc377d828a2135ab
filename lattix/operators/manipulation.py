"""Changes of shape and order: maps of coordinates, without a shuffle."""

from __future__ import annotations

import math
from numbers import Integral

import numpy as np
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, combine, from_cells, moved, new_name
from .elementwise import astype


def _div(c, n):
    return F.call_function("div", c, F.lit(max(1, n)).cast("long"))


def broadcast_to(x: Array, /, shape, *, chunks=None) -> Array:
    shape = tuple(shape)
    if np.broadcast_shapes(x.shape, shape) != shape:
        raise ValueError(f"{x.shape} doesn't broadcast to {shape}")
    if shape == x.shape:
        return x
    skip = len(shape) - x.ndim
    default = tuple(x.chunksize[i - skip] if i >= skip and x.shape[i - skip] == n else 1 for i, n in enumerate(shape))
    return combine(lambda a: a, [x], x.dtype, shape, meta.normalize_chunks(chunks or default, shape, x.dtype))


def broadcast_arrays(*arrays: Array) -> list[Array]:
    shape = np.broadcast_shapes(*(a.shape for a in arrays))
    return [broadcast_to(a, shape) for a in arrays]


def unify_chunks(*arrays: Array) -> list[Array]:
    """The arrays (of one shape, or broadcastable) on the smallest of their chunkings."""
    ndim = max(a.ndim for a in arrays)
    best: dict[int, int] = {}
    for a in arrays:
        for i, (c, n) in enumerate(zip(a.chunksize, a.shape, strict=True)):
            k = i + ndim - a.ndim
            if n != 1:
                best[k] = min(best.get(k, c), c)
    np.broadcast_shapes(*(a.shape for a in arrays))
    return [a.with_chunks(tuple(best.get(i + ndim - a.ndim, 1) if a.shape[i] != 1 else 1 for i in range(a.ndim))) for a in arrays]


def _remap(x: Array, shape, chunks, forward, backward) -> Array:
    """forward: old coordinates to new, for tables; backward: new to old, for arrays without one."""
    if x.table is None:
        return Array(None, lambda c: x.value(backward(c)), shape, x.dtype, chunks, x.spec)
    return moved(x, forward(x.coordinates), shape, None, chunks)


def permute_dims(x: Array, /, axes) -> Array:
    axes = tuple(axes) or tuple(reversed(range(x.ndim)))
    axes = meta.normalize_axis(axes, x.ndim)
    if len(axes) != x.ndim:
        raise ValueError("axes must name all dimensions")
    back = [axes.index(i) for i in range(x.ndim)]
    return _remap(x, tuple(x.shape[a] for a in axes), tuple(x.chunks[a] for a in axes), lambda c: [c[a] for a in axes], lambda c: [c[b] for b in back])


def matrix_transpose(x: Array, /) -> Array:
    return x.mT


def moveaxis(x: Array, source, destination, /) -> Array:
    source, destination = meta.normalize_axis(source, x.ndim), meta.normalize_axis(destination, x.ndim)
    if len(source) != len(destination):
        raise ValueError("source and destination differ in length")
    order = [i for i in range(x.ndim) if i not in source]
    for d, s in sorted(zip(destination, source, strict=True)):
        order.insert(d, s)
    return permute_dims(x, tuple(order))


def expand_dims(x: Array, /, axis=0) -> Array:
    axes = meta.normalize_axis(axis, x.ndim + (1 if isinstance(axis, Integral) else len(axis)))
    old = [i for i in range(x.ndim + len(axes)) if i not in axes]
    place = {k: j for j, k in enumerate(old)}
    n = x.ndim + len(axes)
    return _remap(x, tuple(x.shape[place[i]] if i in place else 1 for i in range(n)), tuple(x.chunks[place[i]] if i in place else (1,) for i in range(n)), lambda c: [c[place[i]] if i in place else F.lit(0) for i in range(n)], lambda c: [c[k] for k in old])


def squeeze(x: Array, /, axis) -> Array:
    axes = meta.normalize_axis(axis, x.ndim)
    if any(x.shape[a] != 1 for a in axes):
        raise ValueError("only axes of size 1 can be squeezed")
    kept = [i for i in range(x.ndim) if i not in axes]
    place = {k: j for j, k in enumerate(kept)}
    return _remap(x, tuple(x.shape[k] for k in kept), tuple(x.chunks[k] for k in kept), lambda c: [c[k] for k in kept], lambda c: [c[place[i]] if i in place else F.lit(0).cast("long") for i in range(x.ndim)])


def _linear(c, shape):
    out = F.lit(0).cast("long")
    for a, n in zip(c, shape, strict=True):
        out = out * max(1, n) + a
    return out


def _unlinear(at, shape):
    out = []
    for i in range(len(shape)):
        below = math.prod(max(1, n) for n in shape[i + 1 :])
        c = _div(at, below) if below > 1 else at
        out.append(c % max(1, shape[i]) if i else c)
    return out


def reshape(x: Array, /, shape, *, copy=None, chunks="auto") -> Array:
    """C order; one size may be -1."""
    shape = (shape,) if isinstance(shape, Integral) else tuple(shape)
    if -1 in shape:
        rest = math.prod(n for n in shape if n != -1)
        if shape.count(-1) > 1 or rest and x.size % rest or not rest:
            raise ValueError(f"can't reshape {x.shape} to {shape}")
        shape = tuple(x.size // rest if n == -1 else n for n in shape)
    if math.prod(shape) != x.size:
        raise ValueError(f"can't reshape {x.shape} to {shape}")
    if shape == x.shape:
        return x
    return _remap(x, shape, chunks, lambda c: _unlinear(_linear(c, x.shape), shape), lambda c: _unlinear(_linear(c, shape), x.shape))


def reshape_chunks(x: Array, shape, chunks) -> Array:
    out = reshape(x, shape, chunks=chunks)
    if out.nchunks != x.nchunks:
        raise ValueError("the number of blocks must stay")
    return out


def flatten(x: Array) -> Array:
    return reshape(x, (-1,) if x.size else (0,))


def flip(x: Array, /, *, axis=None) -> Array:
    axes = meta.normalize_axis(axis, x.ndim)
    turn = lambda c: [x.shape[i] - 1 - a if i in axes else a for i, a in enumerate(c)]
    return _remap(x, x.shape, x.chunks, turn, turn)


def roll(x: Array, /, shift, *, axis=None) -> Array:
    if axis is None:
        return reshape(roll(flatten(x), shift, axis=0), x.shape)
    axes = (axis,) if isinstance(axis, Integral) else tuple(axis)
    shifts = (shift,) * len(axes) if isinstance(shift, Integral) else tuple(shift)
    if len(shifts) != len(axes):
        raise ValueError("shift and axis differ in length")
    by = [0] * x.ndim
    for a, s in zip(axes, shifts, strict=True):
        by[meta.normalize_axis(a, x.ndim)[0]] += s
    turn = lambda sign: lambda c: [F.pmod(a + sign * s, F.lit(max(1, n)).cast("long")) if s else a for a, s, n in zip(c, by, x.shape, strict=True)]
    return _remap(x, x.shape, x.chunks, turn(1), turn(-1))


def _union(parts: list[tuple[Array, list]], shape, dtype, chunks, spec) -> Array:
    name, table = new_name(), None
    for x, coordinates in parts:
        piece = x.base().select(*[c.cast("long").alias(f"d{i}") for i, c in enumerate(coordinates)], x.column.alias(name))
        table = piece if table is None else table.unionByName(piece)
    return Array(table, lambda _: F.col(name), shape, dtype, chunks, spec)


def concat(arrays, /, *, axis=0, chunks=None) -> Array:
    arrays = list(arrays)
    if not arrays:
        raise ValueError("nothing to concatenate")
    if axis is None:
        arrays, axis = [flatten(a) for a in arrays], 0
    axis = meta.normalize_axis(axis, arrays[0].ndim)[0]
    dtype = meta.result_type(*arrays)
    if len({a.shape[:axis] + a.shape[axis + 1 :] for a in arrays}) > 1 or len({a.ndim for a in arrays}) > 1:
        raise ValueError("shapes must agree except along the axis")
    parts, at = [], 0
    for a in arrays:
        parts.append((astype(a, dtype), [c + at if i == axis else c for i, c in enumerate(a.coordinates)]))
        at += a.shape[axis]
    shape = (*arrays[0].shape[:axis], at, *arrays[0].shape[axis + 1 :])
    return _union(parts, shape, dtype, chunks or meta.normalize_chunks(arrays[0].chunksize, shape, dtype), arrays[0].spec)


def stack(arrays, /, *, axis=0) -> Array:
    arrays = list(arrays)
    if not arrays or len({a.shape for a in arrays}) > 1:
        raise ValueError("stack takes arrays of one shape")
    axis = meta.normalize_axis(axis, arrays[0].ndim + 1)[0]
    dtype = meta.result_type(*arrays)
    parts = [(astype(a, dtype), [*a.coordinates[:axis], F.lit(k), *a.coordinates[axis:]]) for k, a in enumerate(arrays)]
    first = arrays[0]
    return _union(parts, (*first.shape[:axis], len(arrays), *first.shape[axis:]), dtype, (*first.chunks[:axis], (1,) * len(arrays), *first.chunks[axis:]), first.spec)


def unstack(x: Array, /, *, axis=0) -> tuple[Array, ...]:
    axis = meta.normalize_axis(axis, x.ndim)[0]
    return tuple(x[(*[slice(None)] * axis, i)] for i in range(x.shape[axis]))


def repeat(x: Array, repeats: int, /, *, axis=0) -> Array:
    if axis is None:
        x, axis = flatten(x), 0
    axis = meta.normalize_axis(axis, x.ndim)[0]
    return _copies(x, axis, repeats, lambda c, k, n: c * repeats + k, lambda c, n: _div(c, repeats))


def _copies(x: Array, axis: int, times: int, to, back) -> Array:
    n = x.shape[axis]
    shape = (*x.shape[:axis], n * times, *x.shape[axis + 1 :])
    chunks = meta.normalize_chunks(x.chunksize, shape, x.dtype)
    if x.table is None and times:
        return Array(None, lambda c: x.value([back(a, n) if i == axis else a for i, a in enumerate(c)]), shape, x.dtype, chunks, x.spec)
    name = new_name()
    numbers = F.explode(F.sequence(F.lit(0), F.lit(times - 1))) if times else F.explode(F.array().cast("array<int>"))
    table = x.base().select(*x.coordinates, x.column.alias(name), numbers.alias("_k"))
    table = table.select(*[(to(F.col(f"d{i}"), F.col("_k"), n) if i == axis else F.col(f"d{i}")).cast("long").alias(f"d{i}") for i in range(x.ndim)], name)
    return Array(table, lambda _: F.col(name), shape, x.dtype, chunks, x.spec)


def tile(x: Array, repetitions, /) -> Array:
    repetitions = tuple(repetitions)
    x = expand_dims(x, tuple(range(len(repetitions) - x.ndim))) if len(repetitions) > x.ndim else x
    repetitions = (1,) * (x.ndim - len(repetitions)) + repetitions
    for axis, times in enumerate(repetitions):
        if times != 1:
            x = _copies(x, axis, times, lambda c, k, n: c + k * n, lambda c, n: c % max(1, n))
    return x


def pad(x: Array, pad_width, mode: str = "constant", constant_values=0, chunks=None) -> Array:
    """`constant` on any side; `symmetric` by one element or more, up to the size of an axis."""
    widths = _pairs(pad_width, x.ndim)
    if mode == "symmetric":
        for axis, (lo, hi) in enumerate(widths):
            if max(lo, hi) > x.shape[axis]:
                raise NotImplementedError("symmetric padding beyond the size of an axis")
            before, after = [slice(None)] * x.ndim, [slice(None)] * x.ndim
            before[axis], after[axis] = slice(0, lo), slice(x.shape[axis] - hi, x.shape[axis])
            parts = [flip(x[tuple(before)], axis=axis)] * bool(lo) + [x] + [flip(x[tuple(after)], axis=axis)] * bool(hi)
            x = concat(parts, axis=axis) if len(parts) > 1 else x
        return x.with_chunks(chunks) if chunks else x
    if mode != "constant":
        raise NotImplementedError(f"mode {mode!r}")
    from .creation import full

    values = _pairs(constant_values, x.ndim)
    size = x.chunksize
    for axis, ((lo, hi), (a, b)) in enumerate(zip(widths, values, strict=True)):
        side = lambda n, v, axis=axis: full((*x.shape[:axis], n, *x.shape[axis + 1 :]), np.dtype(x.dtype).type(v).item(), dtype=x.dtype, spec=x.spec)
        parts = ([side(lo, a)] if lo else []) + [x] + ([side(hi, b)] if hi else [])
        x = concat(parts, axis=axis) if len(parts) > 1 else x
    return x.with_chunks(chunks or size)


def _pairs(value, ndim: int) -> list[tuple]:
    if not isinstance(value, tuple | list):
        return [(value, value)] * ndim
    value = list(value)
    if value and not isinstance(value[0], tuple | list):
        return [(value[0], value[-1])] * ndim
    pairs = [(v[0], v[-1]) for v in value]
    return pairs * ndim if len(pairs) == 1 else pairs


def as_cells(x: Array) -> Array:
    """The same elements over a table of their own."""
    return from_cells(x.cells(), x.shape, x.dtype, x.chunks, spec=x.spec)


def merge_chunks(x: Array, chunks) -> Array:
    if len(chunks) != x.ndim or any(c % o for c, o, n in zip(chunks, x.chunksize, x.shape, strict=True) if c < n):
        raise ValueError("merged chunks must be multiples of the old ones")
    return x.with_chunks(tuple(chunks))
