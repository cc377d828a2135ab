"""Arrays made from nothing: functions of their coordinates, without a table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, from_cells, full as constant, is_array, session
from ..functions import ieee
from .elementwise import astype

#: Literals are part of the plan; they must not be larger than this.
MAX_LITERAL_BYTES = 1_000_000


def arange(start, /, stop=None, step=1, *, dtype=None, device=None, chunks="auto", spec=None) -> Array:
    if stop is None:
        start, stop = 0, start
    dtype = np.dtype(dtype or np.asarray([start, stop, step]).dtype)
    n = max(math.ceil((stop - start) / step), 0)
    if dtype.kind in "iu":
        return Array(None, lambda c: ieee.as_type(F.lit(int(start)) + c[0] * F.lit(int(step)), dtype), (n,), dtype, chunks, spec)
    return Array(None, lambda c: ieee.as_type(F.lit(float(start)) + c[0] * F.lit(float(step)), dtype), (n,), dtype, chunks, spec)


def linspace(start, stop, /, num, *, dtype=None, device=None, endpoint=True, chunks="auto", spec=None) -> Array:
    dtype = np.dtype(dtype or np.float64)
    parts = num - 1 if endpoint else num
    step = (stop - start) / parts if parts > 0 else 0.0

    def value(c):
        v = F.lit(float(start)) + c[0] * F.lit(float(step))
        return ieee.cast(F.when(c[0] == num - 1, F.lit(float(stop))).otherwise(v) if endpoint and num > 1 else v, np.float64, dtype)

    return Array(None, value, (num,), dtype, chunks, spec)


def full(shape, fill_value, *, dtype=None, device=None, chunks="auto", spec=None) -> Array:
    if dtype is None:
        kinds = {bool: "bool", int: "int64", float: "float64", complex: "complex128"}
        dtype = next((d for k, d in kinds.items() if isinstance(fill_value, k)), None)
        if dtype is None:
            raise TypeError(f"no dtype for {fill_value!r}")
    return constant(shape, fill_value, dtype, chunks, spec)


def zeros(shape, *, dtype=np.float64, device=None, chunks="auto", spec=None) -> Array:
    return constant(shape, 0, dtype or np.float64, chunks, spec)


def ones(shape, *, dtype=np.float64, device=None, chunks="auto", spec=None) -> Array:
    return constant(shape, 1, dtype or np.float64, chunks, spec)


def empty(shape, *, dtype=np.float64, device=None, chunks="auto", spec=None) -> Array:
    return zeros(shape, dtype=dtype, chunks=chunks, spec=spec)


empty_virtual_array = empty


def full_like(x: Array, /, fill_value, *, dtype=None, device=None, chunks=None, spec=None) -> Array:
    return constant(x.shape, fill_value, dtype or x.dtype, chunks or x.chunks, spec or x.spec)


def zeros_like(x: Array, /, **how) -> Array:
    return full_like(x, 0, **how)


def ones_like(x: Array, /, **how) -> Array:
    return full_like(x, 1, **how)


def empty_like(x: Array, /, **how) -> Array:
    return full_like(x, 0, **how)


def eye(n_rows, n_cols=None, /, *, k=0, dtype=np.float64, device=None, chunks="auto", spec=None) -> Array:
    one, zero = ieee.literal(1, dtype or np.float64), ieee.literal(0, dtype or np.float64)
    return Array(None, lambda c: F.when(c[1] - c[0] == k, one).otherwise(zero), (n_rows, n_cols if n_cols is not None else n_rows), dtype or np.float64, chunks, spec)


def _triangle(x: Array, keep) -> Array:
    if x.ndim < 2:
        raise ValueError("x must have 2 dimensions at least")
    return Array(x.table, lambda c: F.when(keep(c[-2], c[-1]), x.value(c)).otherwise(ieee.literal(0, x.dtype)), x.shape, x.dtype, x.chunks, x.spec)


def tril(x: Array, /, *, k=0) -> Array:
    return _triangle(x, lambda i, j: j <= i + k)


def triu(x: Array, /, *, k=0) -> Array:
    return _triangle(x, lambda i, j: j >= i + k)


def meshgrid(*arrays: Array, indexing: str = "xy") -> list[Array]:
    if indexing not in ("xy", "ij"):
        raise ValueError(f"indexing {indexing!r}")
    if len({a.dtype for a in arrays}) > 1:
        raise ValueError("meshgrid takes arrays of one dtype")
    if any(a.ndim != 1 for a in arrays):
        raise ValueError("meshgrid takes 1-d arrays")
    place = list(range(len(arrays)))
    if indexing == "xy" and len(arrays) > 1:
        place[0], place[1] = 1, 0
    shape = [0] * len(arrays)
    for k, a in zip(place, arrays, strict=True):
        shape[k] = a.shape[0]
    from .manipulation import broadcast_to, reshape

    return [broadcast_to(reshape(a, tuple(-1 if i == k else 1 for i in range(len(shape)))), tuple(shape)) for k, a in zip(place, arrays, strict=True)]


def asarray(obj, /, *, dtype=None, device=None, copy=None, chunks="auto", spec=None) -> Array:
    """An array of a literal, an ndarray of at most 1 MB, or an array as it is."""
    if is_array(obj):
        return obj if dtype is None else astype(obj, dtype)
    values = np.asarray(obj, dtype=dtype)
    if values.dtype.name not in meta.DTYPES:
        raise TypeError(f"dtype {values.dtype} isn't supported")
    if values.nbytes > MAX_LITERAL_BYTES:
        raise ValueError(f"{values.nbytes} bytes are too many for a literal; use from_array")
    return from_array(values, chunks=chunks, spec=spec)


def from_array(x, chunks="auto", asarray=None, spec=None) -> Array:
    """An array of anything with shape, dtype and slicing; large sources are sliced by the tasks that need them."""
    if is_array(x):
        raise ValueError("x is an array already")
    shape, dtype = tuple(x.shape), np.dtype(x.dtype)
    chunks = meta.normalize_chunks(chunks, shape, dtype)
    if not shape:
        return constant((), np.asarray(x[()] if not isinstance(x, np.ndarray) else x).item(), dtype, spec=spec)
    if math.prod(shape) * dtype.itemsize <= MAX_LITERAL_BYTES:
        values = np.asarray(x[...])
        at = np.indices(shape).reshape(len(shape), -1)
        data = {f"d{i}": at[i].astype(np.int64) for i in range(len(shape))}
        return from_cells(_local(data, values.ravel(), dtype), shape, dtype, chunks, spec=spec)
    from .blocks import block_source

    return block_source(lambda block, slices: np.asarray(x[slices]), shape, dtype, chunks, spec)


def _local(coordinates: dict, values: np.ndarray, dtype):
    from pyspark.sql import types as T

    schema = T.StructType([*(T.StructField(n, T.LongType(), False) for n in coordinates), T.StructField("v", meta.spark_type(dtype))])
    if dtype.kind == "c":
        rows = [(*map(int, at), (float(v.real), float(v.imag))) for *at, v in zip(*coordinates.values(), values, strict=True)]
    elif dtype.name == "uint64":
        from decimal import Decimal

        rows = [(*map(int, at), Decimal(int(v))) for *at, v in zip(*coordinates.values(), values, strict=True)]
    else:
        rows = [(*at, v) for *at, v in zip(*(c.tolist() for c in coordinates.values()), values.tolist(), strict=True)]
    return session().createDataFrame(rows, schema)


def from_table(df, coordinates: list[str], value: str, shape=None, dtype=None, chunks="auto", spec=None) -> Array:
    """An array view of a table with a row for each element; shape, if not given, is counted."""
    if shape is None:
        top = df.agg(*[F.max(c).alias(f"m{i}") for i, c in enumerate(coordinates)]).first()
        shape = tuple((m if m is not None else -1) + 1 for m in top)
    if dtype is None:
        back = {meta.spark_type(d).simpleString(): d for d in ("bool", "int8", "int16", "int32", "int64", "float32", "float64")}
        dtype = back[df.schema[value].dataType.simpleString()]
    cells = df.select(*[F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(coordinates)], F.col(value).alias("v"))
    return from_cells(cells, shape, dtype, chunks, spec=spec)


def block_ids(shape, chunks, spec=None) -> Array:
    """The linear number of the block that each element lies in."""
    chunks = meta.normalize_chunks(chunks, tuple(shape), np.int64)
    sizes, counts = meta.chunk_sizes(chunks), [len(c) for c in chunks]

    def value(c):
        number = F.lit(0).cast("long")
        for i in range(len(shape)):
            number = number * counts[i] + F.floor(c[i] / sizes[i])
        return number

    return Array(None, value, shape, np.int64, chunks, spec)


offsets_virtual_array = block_ids

