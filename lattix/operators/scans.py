"""Prefix scans and differences along an axis, in two levels: within blocks, then over block totals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, from_cells, full, new_name
from ..functions import ieee
from .elementwise import astype, subtract
from .manipulation import concat, flatten
from .reductions import _accumulator, from_signed, to_signed, wrapped_products, wrapping_sum


def _scan(x: Array, axis: int, total, join, exact=None, finish=lambda v: v, total_of=None) -> Array:
    """total: an aggregate, and ``finish`` what follows it; join: how a block's offset meets its running values.

    exact: a running value as a function of column and window, where no aggregate gives it.
    """
    axis = meta.normalize_axis(axis, x.ndim)[0]
    if not x.size:
        return x
    rest = [f"d{i}" for i in range(x.ndim) if i != axis]
    name, size = new_name(), max(x.chunksize[axis], -(-x.shape[axis] // 4096))
    cells = x.base().select(*x.coordinates, x.column.alias(name), F.floor(F.col(f"d{axis}") / size).cast("long").alias("_b"))
    within = Window.partitionBy(*rest, "_b").orderBy(f"d{axis}").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.withColumn("_r", finish(total(F.col(name)).over(within)) if exact is None else exact(F.col(name), within))
    if size < x.shape[axis]:
        sums = cells.groupBy(*rest, "_b").agg(finish(total(F.col(name))).alias("_t") if exact is None else total_of(F.col(name)).alias("_t"))
        # At most 4096 block totals for each line along the axis: a window over them is small.
        before = Window.partitionBy(*rest).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*rest, "_b", (finish(total(F.col("_t")).over(before)) if exact is None else exact(F.col("_t"), before)).alias("_o"))
        running = running.join(offsets, [*rest, "_b"]).withColumn("_r", F.when(F.col("_o").isNull(), F.col("_r")).otherwise(join(F.col("_o"), F.col("_r"))))
    return from_cells(running.select(*x.coordinates, F.col("_r").cast(meta.spark_type(x.dtype)).alias("v")), x.shape, x.dtype, x.chunks, spec=x.spec)


def _prepared(x: Array, axis, dtype, include_initial) -> tuple[Array, int]:
    if axis is None:
        x, axis = (x, 0) if x.ndim == 1 else (flatten(x), 0)
    return astype(x, _accumulator(x, dtype)), meta.normalize_axis(axis, x.ndim)[0]


def _initial(out: Array, axis: int, value, include: bool) -> Array:
    if not include:
        return out
    first = full((*out.shape[:axis], 1, *out.shape[axis + 1 :]), value, out.dtype, spec=out.spec)
    return concat([first, out], axis=axis)


def cumulative_sum(x: Array, /, *, axis=None, dtype=None, include_initial=False, device=None) -> Array:
    x, axis = _prepared(x, axis, dtype, include_initial)
    if x.dtype.kind == "c":
        raise TypeError("cumulative_sum takes real arrays")
    join = lambda o, r: ieee.add(o, r, x.dtype)
    if x.dtype == np.int64:
        out = _scan(x, axis, None, join, _running_sum, total_of=lambda v: wrapping_sum(v, x.dtype))
    elif x.dtype.kind == "f":
        out = _scan(x, axis, lambda v: F.sum(v.cast("double")), join, finish=lambda v: ieee.as_type(v, x.dtype))
    else:
        out = _scan(x, axis, lambda v: F.sum(v.cast("decimal(28,0)")), join, finish=lambda v: ieee.wrap(v, x.dtype))
    return _initial(out, axis, 0, include_initial)


def _running_sum(v, window):
    """Halves of 64-bit numbers summed apart, which can't overflow before 2^31 rows."""
    low = F.sum(v.bitwiseAND(F.lit(0xFFFFFFFF))).over(window)
    high = F.sum(F.call_function("shiftright", v, F.lit(32))).over(window)
    whole = low.cast("decimal(38,0)") + high.cast("decimal(28,0)") * F.lit(str(1 << 32)).cast("decimal(10,0)")
    return F.when((F.abs(high) < 1 << 30) & (low < 1 << 61), F.call_function("shiftleft", high, F.lit(32)) + low).otherwise(ieee.wrap(whole, np.int64))


def cumulative_prod(x: Array, /, *, axis=None, dtype=None, include_initial=False, device=None) -> Array:
    x, axis = _prepared(x, axis, dtype, include_initial)
    if x.dtype.kind == "f":
        out = _scan(x, axis, lambda v: F.product(v.cast("double")), lambda o, r: o * r, finish=lambda v: ieee.as_type(v, x.dtype))
    elif x.dtype.kind == "c":
        raise TypeError("cumulative_prod takes real arrays")
    else:
        out = _scan_products(x, axis)
    return _initial(out, axis, 1, include_initial)


def _running_products(table, keys: list[str], order: str, name: str):
    """``table`` with _r, the running product of ``name`` modulo 2^64 by ``order`` within the keys: one pass over sorted rows."""

    def run(batches):
        last, carry = None, np.int64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, v = [batch.column(k).to_numpy() for k in keys], batch.column(name).to_numpy()
            new = np.zeros(len(v), bool)
            for k in at:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(v)]
            running = np.empty(len(v), np.int64)
            with np.errstate(over="ignore"):
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    key = tuple(k[lo].item() for k in at)
                    running[lo:hi] = np.multiply.accumulate(v[lo:hi]) * (carry if key == last else np.int64(1))
                    last, carry = key, running[hi - 1]
            yield batch.append_column("_r", pa.array(running))

    rows = (table.repartition(*keys) if keys else table.repartition(1)).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(run, table.withColumn("_r", F.lit(0).cast("long")).schema)


def _scan_products(x: Array, axis: int) -> Array:
    """Running products of integers, as _scan: within blocks, and over at most 4096 block products of a line."""
    axis = meta.normalize_axis(axis, x.ndim)[0]
    if not x.size:
        return x
    rest = [f"d{i}" for i in range(x.ndim) if i != axis]
    size = max(x.chunksize[axis], -(-x.shape[axis] // 4096))
    cells = x.base().select(*x.coordinates, to_signed(x.column, x.dtype).alias("_v"), F.floor(F.col(f"d{axis}") / size).cast("long").alias("_b"))
    running = _running_products(cells, [*rest, "_b"], f"d{axis}", "_v")
    value = F.col("_r")
    if size < x.shape[axis]:
        totals = wrapped_products(cells, [*rest, "_b"], "_v", np.int64)
        before = _running_products(totals, rest, "_b", "_v").select(*rest, (F.col("_b") + 1).alias("_b"), F.col("_r").alias("_o"))
        running = running.join(before, [*rest, "_b"], "left")
        value = ieee.multiply(F.coalesce("_o", F.lit(1).cast("long")), value, np.dtype(np.int64))
    return from_cells(running.select(*x.coordinates, from_signed(value, x.dtype).cast(meta.spark_type(x.dtype)).alias("v")), x.shape, x.dtype, x.chunks, spec=x.spec)


def nancumsum(x: Array, /, *, axis=None, dtype=None) -> Array:
    return cumulative_sum(_nan_as(x, 0), axis=axis, dtype=dtype)


def nancumprod(x: Array, /, *, axis=None, dtype=None) -> Array:
    return cumulative_prod(_nan_as(x, 1), axis=axis, dtype=dtype)


def _nan_as(x: Array, value) -> Array:
    if x.dtype.kind != "f":
        return x
    from ..array import combine

    return combine(lambda v: F.when(F.isnan(v), ieee.literal(value, x.dtype)).otherwise(v), [x], x.dtype)


def scan(x: Array, op: str = "sum", *, axis: int, include_initial: bool = False, dtype=None) -> Array:
    """Generic prefix scan with an associative operation: sum, prod, max or min."""
    if op in ("sum", "prod"):
        return {"sum": cumulative_sum, "prod": cumulative_prod}[op](x, axis=axis, dtype=dtype, include_initial=include_initial)
    how, both = {"max": (F.max, F.greatest), "min": (F.min, F.least)}[op]
    return _scan(x, axis, how, both)


def diff(x: Array, /, *, axis=-1, n=1, prepend=None, append=None) -> Array:
    if n < 0:
        raise ValueError("n must not be negative")
    axis = meta.normalize_axis(axis, x.ndim)[0]
    if prepend is not None or append is not None:
        x = concat([a for a in (prepend, x, append) if a is not None], axis=axis)
    for _ in range(min(n, x.shape[axis])):
        x = _diff(x, axis)
    return x


def _diff(x: Array, axis: int) -> Array:
    n = x.shape[axis]
    cut = lambda s: (*[slice(None)] * axis, s)
    if x.table is None or x.dtype.kind == "b":
        return subtract(x[cut(slice(1, n))], x[cut(slice(0, n - 1))])
    # Each element goes to two places; an aggregation that shuffles halves of blocks would need more.
    name = new_name()
    cells = x.base().select(*x.coordinates, x.column.alias(name))
    rest = [f"d{i}" for i in range(x.ndim) if i != axis]
    c, size = F.col(f"d{axis}"), max(2, x.chunksize[axis])
    # The first element of a block also goes to the block before, so that no window spans blocks.
    first = (c % size == 0) & (c > 0)
    spread = cells.withColumn("_b", F.explode(F.when(first, F.array(F.call_function("div", c, F.lit(size).cast("long")) - 1, F.call_function("div", c, F.lit(size).cast("long")))).otherwise(F.array(F.call_function("div", c, F.lit(size).cast("long"))))))
    after = F.lead(name).over(Window.partitionBy(*rest, "_b").orderBy(f"d{axis}"))
    out = spread.select(*x.coordinates, "_b", F.col(name).alias("_v"), after.alias("_n")).where("_n IS NOT NULL")
    shape = (*x.shape[:axis], n - 1, *x.shape[axis + 1 :])
    return from_cells(out.select(*x.coordinates, ieee.subtract(F.col("_n"), F.col("_v"), x.dtype).alias("v")), shape, x.dtype, meta.normalize_chunks(x.chunksize, shape, x.dtype), spec=x.spec)
