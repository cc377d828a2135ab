"""Positional selection: filters on coordinates, which reach the scan, and arithmetic on them."""

from __future__ import annotations

import numbers

import numpy as np
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, is_array, moved, new_name, session


def _expand(key, ndim: int) -> list:
    key = list(key) if isinstance(key, tuple) else [key]
    key = [np.asarray(k) if isinstance(k, list | np.ndarray) else k for k in key]
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("only one ellipsis is allowed")
    used = sum(k is not None and k is not Ellipsis for k in key)
    if used > ndim:
        raise IndexError(f"{used} indices for {ndim} dimensions")
    at = next((i for i, k in enumerate(key) if k is Ellipsis), len(key))
    return key[:at] + [slice(None)] * (ndim - used) + key[at + 1 :]


def index(x: Array, key) -> Array:
    """Integers, slices of any step, None, an ellipsis, and at most one array of integers."""
    if is_array(key) or isinstance(key, tuple) and any(is_array(k) for k in key):
        key = tuple(k.compute() if is_array(k) else k for k in (key if isinstance(key, tuple) else (key,)))
    parts = _expand(key, x.ndim)
    arrays = [k for k in parts if isinstance(k, np.ndarray) and k.ndim]
    if len(arrays) > 1:
        raise NotImplementedError("only one array of integers is allowed")
    parts = [int(k) if isinstance(k, np.ndarray) and not k.ndim and k.dtype.kind in "iu" else k for k in parts]
    coordinates, where, shape, chunks, lookup = [], [], [], [], None
    axis = 0
    for k in parts:
        if k is None:
            coordinates.append(None)
            shape.append(1)
            chunks.append((1,))
            continue
        n = x.shape[axis]
        if isinstance(k, bool | np.bool_) or isinstance(k, np.ndarray) and k.dtype.kind == "b":
            raise NotImplementedError("boolean masks have shapes that depend on data")
        if isinstance(k, numbers.Integral):
            if not -n <= k < n:
                raise IndexError(f"index {k} is out of bounds for size {n}")
            where.append((axis, "=", int(k) % n))
        elif isinstance(k, slice):
            start, stop, step = k.indices(n)
            size = len(range(start, stop, step))
            low, high = (start, start + (size - 1) * step) if step > 0 else (start + (size - 1) * step, start)
            if size < n or step != 1:
                where.append((axis, "in", (low, high, step, size)))
            coordinates.append((axis, start, step))
            shape.append(size)
            chunks.append(max(1, x.chunksize[axis] // abs(step)) if size else 1)
        elif isinstance(k, np.ndarray):
            if k.ndim != 1 or k.dtype.kind not in "iu" and k.size:
                raise IndexError("an array index must be of integers and have 1 dimension")
            k = k.astype(np.int64)
            if k.size and (k.min() < -n or k.max() >= n):
                raise IndexError("an array index is out of bounds")
            lookup = (axis, np.where(k < 0, k + n, k), len(coordinates))
            coordinates.append("lookup")
            shape.append(len(k))
            chunks.append(x.chunksize[axis])
        else:
            raise IndexError(f"index {k!r}")
        axis += 1
    chunks = meta.normalize_chunks(tuple(c[0] if isinstance(c, tuple) else c for c in chunks), tuple(shape), x.dtype)
    if x.table is None:  # a function of coordinates stays one
        return _compose(x, parts, shape, chunks)
    keep, stored = F.lit(True), getattr(x.table, "lattix_blocks", {})
    for a, kind, v in where:
        c = F.col(f"d{a}")
        if a in stored:  # the folders of other blocks aren't read
            block, per = stored[a]
            low, high = (v, v) if kind == "=" else v[:2]
            keep &= (F.col(block) >= low // per) & (F.col(block) <= high // per)
        if kind == "=":
            keep &= c == v
        else:
            low, high, step, size = v
            keep &= (c >= low) & (c <= high) if size else F.lit(False)
            if abs(step) > 1:
                keep &= (c - low) % abs(step) == 0
    out = []
    for item in coordinates:
        if item is None:
            out.append(F.lit(0))
        elif item == "lookup":
            out.append(F.col("_to"))
        else:
            a, start, step = item
            moved_by = F.col(f"d{a}") - start
            out.append(moved_by if step == 1 else -moved_by if step == -1 else F.call_function("div", moved_by, F.lit(step).cast("long")))
    if lookup is None:
        return moved(x, out, shape, keep, chunks)
    a, wanted, _ = lookup
    pairs = session().createDataFrame([(int(v), i) for i, v in enumerate(wanted)], "_from long, _to long")
    if len(wanted) <= 100_000:
        pairs = F.broadcast(pairs)
    name = new_name()
    table = x.base().where(keep).withColumn(name, x.column).join(pairs, F.col(f"d{a}") == F.col("_from"))
    table = table.select(*[c.cast("long").alias(f"d{i}") for i, c in enumerate(out)], name)
    return Array(table, lambda _: F.col(name), shape, x.dtype, chunks, x.spec)


def _compose(x: Array, parts: list, shape, chunks) -> Array:
    """Selection from an array that has no table: its coordinates as functions of the new ones."""

    def value(c):
        own, at = [], 0
        for k in parts:
            if k is None:
                at += 1
            elif isinstance(k, slice):
                start, _, step = k.indices(x.shape[len(own)])
                own.append(c[at] * step + start)
                at += 1
            elif isinstance(k, np.ndarray):
                n = x.shape[len(own)]
                own.append(F.element_at(F.lit([int(v) % n for v in k]).cast("array<long>"), (c[at] + 1).cast("int")))
                at += 1
            else:
                own.append(F.lit(int(k) % x.shape[len(own)]).cast("long"))
        return x.value(own)

    return Array(None, value, shape, x.dtype, chunks, x.spec)


def take(x: Array, indices, /, *, axis=None) -> Array:
    from .manipulation import flatten

    if axis is None:
        x, axis = (x, 0) if x.ndim == 1 else (flatten(x), 0)
    axis = meta.normalize_axis(axis, x.ndim)[0]
    return index(x, (*[slice(None)] * axis, indices if is_array(indices) else np.asarray(indices)))


class BlockView:
    """Selection of whole blocks by their place in the grid of blocks."""

    def __init__(self, array: Array):
        self._array = array

    shape = property(lambda self: self._array.numblocks)
    ndim = property(lambda self: self._array.ndim)
    size = property(lambda self: self._array.nchunks)

    def ravel(self) -> list[Array]:
        return [self[i] for i in np.ndindex(*self.shape)]

    def __getitem__(self, key) -> Array:
        x = self._array
        key = key if isinstance(key, tuple) else (key,)
        if any(k is None for k in key):
            raise IndexError("blocks take no new axes")
        parts = _expand(key, x.ndim)
        if sum(isinstance(k, np.ndarray) and k.ndim > 0 for k in parts) > 1:
            raise IndexError("only one array of integers is allowed")
        out = []
        for k, size, count, n in zip(parts, x.chunksize, x.numblocks, x.shape, strict=True):
            if isinstance(k, slice) and k.step in (None, 1):
                lo, hi, _ = k.indices(count)
                out.append(slice(lo * size, min(hi * size, n)))
                continue
            if isinstance(k, numbers.Integral) and not -count <= k < count:
                raise IndexError(f"block {k} is out of bounds for {count}")
            wanted = range(count)[k] if isinstance(k, slice) else [int(k) % count] if isinstance(k, numbers.Integral) else [int(v) % count for v in k]
            if len(wanted) == 1:
                out.append(slice(wanted[0] * size, min((wanted[0] + 1) * size, n)))
            else:
                out.append(np.concatenate([np.arange(b * size, min((b + 1) * size, n)) for b in wanted]) if len(wanted) else np.zeros(0, np.int64))
        for i, k in enumerate(out):  # several axes may need a list of positions: one at a time
            if isinstance(k, np.ndarray):
                x = index(x, (*[slice(None)] * i, k)).with_chunks({**dict(enumerate(x.chunksize)), i: self._array.chunksize[i]})
        return index(x, tuple(k if isinstance(k, slice) else slice(None) for k in out)).with_chunks(dict(enumerate(self._array.chunksize)))
