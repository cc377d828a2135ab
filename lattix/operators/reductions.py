"""Reductions over axes: one aggregation each, with partial results before the shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, full, new_name
from ..functions import ieee
from .elementwise import astype


def reduce_cells(x: Array, axis, aggregate, dtype, keepdims=False, empty=None, finish=None, of_table=None) -> Array:
    """aggregate(value, coordinates) over ``axis``; ``empty``: what no elements give (None: an error).

    of_table(table, keys, name): in place of ``aggregate``, the table with a row for each value of the keys.
    """
    axes = meta.normalize_axis(axis, x.ndim)
    kept = [i for i in range(x.ndim) if i not in axes]
    shape = tuple(1 if i in axes else n for i, n in enumerate(x.shape)) if keepdims else tuple(x.shape[i] for i in kept)
    chunks = tuple((1,) if i in axes else c for i, c in enumerate(x.chunks)) if keepdims else tuple(x.chunks[i] for i in kept)
    if math.prod(x.shape[a] for a in axes) == 0:
        if empty is None:
            raise ValueError("no elements to reduce, and no identity")
        return full(shape, empty, dtype, chunks, x.spec)
    name = new_name()
    if x.table is None and not axes:
        axes = ()
    table = x.base().select(*x.coordinates, x.column.alias(name))
    if of_table:
        table = of_table(table.select(*[F.col(f"d{i}").alias(f"k{i}") for i in kept], name), [f"k{i}" for i in kept], name)
    else:
        out = aggregate(F.col(name), x.coordinates)
        table = table.groupBy(*[F.col(f"d{i}").alias(f"k{i}") for i in kept]).agg(out.alias(name)) if kept else table.agg(out.alias(name))
    result = finish(F.col(name)) if finish else F.col(name)
    if keepdims:
        dims = [F.lit(0).cast("long").alias(f"d{i}") if i in axes else F.col(f"k{i}").alias(f"d{i}") for i in range(x.ndim)]
    else:
        dims = [F.col(f"k{i}").alias(f"d{j}") for j, i in enumerate(kept)]
    return Array(table.select(*dims, result.alias(name)), lambda _: F.col(name), shape, dtype, chunks, x.spec)


def _accumulator(x: Array, dtype):
    if dtype is not None:
        return np.dtype(dtype)
    return np.dtype({"b": np.int64, "i": np.int64, "u": np.uint64}.get(x.dtype.kind, x.dtype))


def wrapping_sum(v: Column, dtype) -> Column:
    dtype = np.dtype(dtype)
    if dtype == np.int64:
        # Halves can't overflow before 2^31 rows of a group; the checked sum serves all others.
        low, high = F.sum(v.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.call_function("shiftright", v, F.lit(32)))
        return F.coalesce(F.try_sum(v), ieee.wrap(low.cast("decimal(38,0)") + high.cast("decimal(28,0)") * F.lit(str(1 << 32)).cast("decimal(10,0)"), dtype))
    if dtype == np.uint64:
        return ieee.wrap(F.sum(v.cast("decimal(28,0)")), dtype)
    if dtype.kind in "iu":
        return ieee.wrap(F.sum(v.cast("long")), dtype)
    return ieee.as_type(F.sum(v.cast("double") if dtype.kind == "f" else v), dtype)


def sum(x: Array, /, *, axis=None, dtype=None, keepdims=False, split_every=None, device=None) -> Array:
    d = _accumulator(x, dtype)
    x = astype(x, d)
    if d.kind == "c":
        part = "float" if d.itemsize == 8 else "double"
        return reduce_cells(x, axis, lambda v, _: F.struct(F.sum(v["re"]).cast(part).alias("re"), F.sum(v["im"]).cast(part).alias("im")), d, keepdims, 0)
    return reduce_cells(x, axis, lambda v, _: wrapping_sum(v, d), d, keepdims, 0)


def to_signed(v: Column, dtype) -> Column:
    """Integers as 64-bit signed ones: the same modulo 2^64."""
    if np.dtype(dtype) != np.uint64:
        return v.cast("long")
    return F.when(v >= F.lit(str(1 << 63)).cast("decimal(20,0)"), v - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(v).cast("long")


def from_signed(v: Column, dtype) -> Column:
    dtype = np.dtype(dtype)
    if dtype == np.uint64:
        return F.when(v < 0, v.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(v.cast("decimal(20,0)")).cast("decimal(20,0)")
    return v if dtype == np.int64 else ieee.wrap(v, dtype)


#: Keys whose partial products a task holds at a time.
HELD_PRODUCTS = 100_000


def wrapped_products(table: DataFrame, keys: list[str], name: str, dtype) -> DataFrame:
    """keys and the product of the integers ``name`` modulo their range.

    Tasks multiply what they hold before the shuffle, so that a group sends about one number a task.
    """

    def some(products: dict):
        columns = [pa.array([k[i] for k in products], pa.int64()) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(products.values()), pa.int64())], names=[*keys, "_p"])

    def partial(batches):
        held: dict[tuple, int] = {}
        for batch in batches:
            v, at = batch.column("_p").to_numpy(), [batch.column(k).to_numpy() for k in keys]
            if not len(v):
                continue
            order = np.lexsort(at[::-1]) if keys else np.arange(len(v))
            new = np.zeros(len(v), bool)
            new[0] = True
            for k in at:
                new[1:] |= k[order][1:] != k[order][:-1]
            starts = np.flatnonzero(new)
            with np.errstate(over="ignore"):
                products = np.multiply.reduceat(v[order], starts)
            names = zip(*(k[order][starts].tolist() for k in at), strict=True) if keys else [()]
            for key, p in zip(names, products, strict=True):
                with np.errstate(over="ignore"):
                    held[key] = p * held.get(key, np.int64(1))
            if len(held) > HELD_PRODUCTS:
                yield some(held)
                held = {}
        if held:
            yield some(held)

    schema = ", ".join([*(f"{k} long" for k in keys), "_p long"])
    parts = table.select(*keys, to_signed(F.col(name), dtype).alias("_p")).mapInArrow(partial, schema)
    whole = F.aggregate(F.collect_list("_p"), F.lit(1).cast("long"), lambda a, b: ieee.multiply(a, b, np.dtype(np.int64)))
    return parts.groupBy(*keys).agg(from_signed(whole, dtype).alias(name))


def prod(x: Array, /, *, axis=None, dtype=None, keepdims=False, split_every=None, device=None) -> Array:
    d = _accumulator(x, dtype)
    x = astype(x, d)
    if d.kind == "f":
        return reduce_cells(x, axis, lambda v, _: ieee.as_type(F.product(v.cast("double")), d), d, keepdims, 1)
    if d.kind == "c":
        from .blocks import reduce_blocks

        return reduce_blocks(x, axis, np.prod, np.prod, d, keepdims)
    return reduce_cells(x, axis, None, d, keepdims, 1, of_table=lambda table, keys, name: wrapped_products(table, keys, name, d))


def mean(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    """Integers and bools give float64."""
    d = x.dtype if x.dtype.kind in "fc" else np.dtype(np.float64)
    if d.kind == "c":
        part = "float" if d.itemsize == 8 else "double"
        return reduce_cells(x, axis, lambda v, _: F.struct(F.avg(v["re"]).cast(part).alias("re"), F.avg(v["im"]).cast(part).alias("im")), d, keepdims, complex(np.nan))
    x = astype(x, d)
    return reduce_cells(x, axis, lambda v, _: ieee.as_type(F.avg(v), d), d, keepdims, np.nan)


def max(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    meta.check_kind("max", "real numeric", x.dtype)
    return reduce_cells(x, axis, lambda v, _: F.max(v), x.dtype, keepdims)


def min(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    meta.check_kind("min", "real numeric", x.dtype)
    if x.dtype.kind != "f":
        return reduce_cells(x, axis, lambda v, _: F.min(v), x.dtype, keepdims)
    return reduce_cells(x, axis, lambda v, _: F.when(F.max(F.isnan(v)), ieee.literal(np.nan, x.dtype)).otherwise(F.min(v)), x.dtype, keepdims)


def variance(v: Column, dtype, correction: float) -> Column:
    n = F.count(v)
    by = F.greatest(n.cast("double") - F.lit(float(correction)), F.lit(0.0))
    return F.coalesce(ieee.divide(F.var_pop(v) * n, by, np.float64), F.lit(np.nan)).cast(meta.spark_type(dtype))


def var(x: Array, /, *, axis=None, correction=0.0, keepdims=False, split_every=None) -> Array:
    meta.check_kind("var", "real numeric", x.dtype)
    d = x.dtype if x.dtype.kind == "f" else np.dtype(np.float64)
    return reduce_cells(astype(x, np.float64), axis, lambda v, _: variance(v, d, correction), d, keepdims, np.nan)


def std(x: Array, /, *, axis=None, correction=0.0, keepdims=False, split_every=None) -> Array:
    from .elementwise import sqrt

    return sqrt(var(x, axis=axis, correction=correction, keepdims=keepdims))


def all(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    return reduce_cells(astype(x, bool) if x.dtype.kind != "c" else _nonzero(x), axis, lambda v, _: F.bool_and(v), bool, keepdims, True)


def any(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    return reduce_cells(astype(x, bool) if x.dtype.kind != "c" else _nonzero(x), axis, lambda v, _: F.bool_or(v), bool, keepdims, False)


def _nonzero(x: Array) -> Array:
    from ..array import combine

    return combine(lambda v: (v["re"] != 0) | (v["im"] != 0), [x], bool)


def count_nonzero(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    truth = _nonzero(x) if x.dtype.kind == "c" else astype(x, bool)
    return reduce_cells(truth, axis, lambda v, _: F.count_if(v), np.int64, keepdims, 0)


def _place(x: Array, axis):
    """The flat index, or that along one axis."""
    if axis is None:
        from .manipulation import _linear

        return lambda c: _linear(c, x.shape)
    k = meta.normalize_axis(axis, x.ndim)[0]
    return lambda c: c[k]


def _arg(x: Array, axis, keepdims, largest: bool, skip_nan: bool, name: str) -> Array:
    meta.check_kind(name, "real numeric", x.dtype)
    place, floats = _place(x, axis), x.dtype.kind == "f"

    def aggregate(v, c):
        at = place(c)
        # Structs compare field by field; ties go to the first place, and NaN counts as the extreme.
        entry = F.struct(v.alias("v"), (-at).alias("i")) if largest else F.struct((~F.isnan(v) if floats else F.lit(True)).alias("n"), v.alias("v"), at.alias("i"))
        if skip_nan and floats:
            entry = F.when(~F.isnan(v), entry)
        best = (F.max if largest else F.min)(entry)["i"]
        best = -best if largest else best
        return F.coalesce(best, F.raise_error(F.lit("All-NaN slice encountered")).cast("long")) if skip_nan else best

    return reduce_cells(x, axis, aggregate, np.int64, keepdims)


def argmax(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(x, axis, keepdims, True, False, "argmax")


def argmin(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(x, axis, keepdims, False, False, "argmin")


# ---------------------------------------------------------------- NaN-aware

def _without_nan(v: Column, dtype) -> Column:
    return F.when(~F.isnan(v), v) if np.dtype(dtype).kind == "f" else v


def nansum(x: Array, /, *, axis=None, dtype=None, keepdims=False, split_every=None, device=None) -> Array:
    d = _accumulator(x, dtype)
    x = astype(x, d)
    return reduce_cells(x, axis, lambda v, _: F.coalesce(wrapping_sum(_without_nan(v, d), d), ieee.literal(0, d)), d, keepdims, 0)


def nanprod(x: Array, /, *, axis=None, dtype=None, keepdims=False, split_every=None, device=None) -> Array:
    d = _accumulator(x, dtype)
    if d.kind != "f":
        return prod(x, axis=axis, dtype=dtype, keepdims=keepdims)
    x = astype(x, d)
    return reduce_cells(x, axis, lambda v, _: F.coalesce(ieee.as_type(F.product(_without_nan(v, d).cast("double")), d), ieee.literal(1, d)), d, keepdims, 1)


def nanmean(x: Array, /, *, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    if x.dtype.kind != "f":
        return mean(x, axis=axis, keepdims=keepdims)
    return reduce_cells(x, axis, lambda v, _: F.coalesce(ieee.as_type(F.avg(_without_nan(v, x.dtype)), x.dtype), ieee.literal(np.nan, x.dtype)), dtype or x.dtype, keepdims, np.nan)


def nanmax(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    if x.dtype.kind != "f":
        return max(x, axis=axis, keepdims=keepdims)
    return reduce_cells(x, axis, lambda v, _: F.coalesce(F.max(_without_nan(v, x.dtype)), ieee.literal(np.nan, x.dtype)), x.dtype, keepdims)


def nanmin(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    if x.dtype.kind != "f":
        return min(x, axis=axis, keepdims=keepdims)
    return reduce_cells(x, axis, lambda v, _: F.coalesce(F.min(_without_nan(v, x.dtype)), ieee.literal(np.nan, x.dtype)), x.dtype, keepdims)


def nanvar(x: Array, /, *, axis=None, correction=0.0, keepdims=False, split_every=None) -> Array:
    d = x.dtype if x.dtype.kind == "f" else np.dtype(np.float64)
    return reduce_cells(astype(x, np.float64), axis, lambda v, _: variance(_without_nan(v, np.float64), d, correction), d, keepdims, np.nan)


def nanstd(x: Array, /, *, axis=None, correction=0.0, keepdims=False, split_every=None) -> Array:
    from .elementwise import sqrt

    return sqrt(nanvar(x, axis=axis, correction=correction, keepdims=keepdims))


def nanmedian(x: Array, axis=None, keepdims=False) -> Array:
    if axis is None:
        raise NotImplementedError("nanmedian takes an axis")
    d = x.dtype if x.dtype.kind == "f" else np.dtype(np.float64)
    return reduce_cells(astype(x, d), axis, lambda v, _: F.coalesce(ieee.as_type(F.median(_without_nan(v, d)), d), ieee.literal(np.nan, d)), d, keepdims, np.nan)


def nanargmax(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(x, axis, keepdims, True, True, "nanargmax")


def nanargmin(x: Array, /, *, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(x, axis, keepdims, False, True, "nanargmin")
