"""Grouped reductions along one axis by integer labels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import meta
from ..array import BROADCAST_ELEMENTS, Array, from_cells, new_name, session
from ..functions import ieee
from .elementwise import astype
from .reductions import _accumulator, variance, wrapped_products, wrapping_sum

#: Of each named reduction: dtype of the result, aggregate, and what an empty group has.
NAMED = {
    "sum": (lambda d: _dtype(d), lambda v, d: wrapping_sum(v, d), 0),
    "prod": (lambda d: _dtype(d), lambda v, d: F.product(v.cast("double")).cast(meta.spark_type(d)), 1),
    "mean": (lambda d: d if d.kind == "f" else np.dtype(np.float64), lambda v, d: F.avg(v), np.nan),
    "var": (lambda d: d if d.kind == "f" else np.dtype(np.float64), lambda v, d: variance(v, d, 0.0), np.nan),
    "max": (lambda d: d, lambda v, d: F.max(v), None),
    "min": (lambda d: d, lambda v, d: F.when(F.max(F.isnan(v)), ieee.literal(np.nan, d)).otherwise(F.min(v)) if np.dtype(d).kind == "f" else F.min(v), None),
    "count": (lambda d: np.dtype(np.int64), lambda v, d: F.count(v), 0),
    "all": (lambda d: np.dtype(bool), lambda v, d: F.bool_and(v.cast("boolean")), True),
    "any": (lambda d: np.dtype(bool), lambda v, d: F.bool_or(v.cast("boolean")), False),
}


def _dtype(d):
    return _accumulator(type("", (), {"dtype": np.dtype(d)}), None)


@dataclass(frozen=True)
class Aggregation:
    """A user's reduction in NumPy: ``func`` of a group's values in one block gives a partial result (a tuple
    of numbers), ``combine`` reduces several (an array of a row each) to one, ``finish`` gives the value."""

    func: Callable
    combine: Callable
    finish: Callable
    width: int = 1
    dtype: str = "float64"
    empty: float = 0


def groupby_reduction(x: Array, by: Array, op="sum", *, axis: int, num_groups: int | None = None, keepdims: bool = True) -> Array:
    """Reduce ``x`` along ``axis`` by labels; the axis has ``num_groups`` places after, empty groups included.

    op: the name of a reduction, or an Aggregation.
    """
    axis = meta.normalize_axis(axis, x.ndim)[0]
    if by.ndim != 1 or by.shape[0] != x.shape[axis]:
        raise ValueError("labels must have 1 dimension, as long as the axis")
    meta.check_kind("groupby_reduction", "integer", by.dtype)
    if num_groups is None:
        from .reductions import max as largest

        num_groups = int(largest(by)) + 1
    rest = [i for i in range(x.ndim) if i != axis]
    name = new_name()
    labels = by.base().select(F.col("d0").alias(f"d{axis}"), by.column.cast("long").alias("_g"))
    cells = x.base().select(*x.coordinates, x.column.alias(name))
    if x.table is not None and x.table is by.table and x.ndim == 1:  # one table: no join
        cells = x.base().select(*x.coordinates, x.column.alias(name), by.column.cast("long").alias("_g"))
    else:
        cells = cells.join(F.broadcast(labels) if by.size <= BROADCAST_ELEMENTS else labels, f"d{axis}")
    cells = cells.where((F.col("_g") >= 0) & (F.col("_g") < num_groups))
    keys = [F.col(f"d{i}") for i in rest]
    if isinstance(op, Aggregation):
        dtype, empty = np.dtype(op.dtype), op.empty
        out = _by_user(cells, [f"d{i}" for i in rest], name, op, x.chunksize[axis], axis)
    else:
        kind, aggregate, empty = NAMED[op]
        dtype = np.dtype(kind(x.dtype))
        value = ieee.cast(F.col(name), x.dtype, dtype) if op in ("sum", "prod", "mean", "var") else F.col(name)
        if op == "prod" and dtype.kind in "iu":
            out = wrapped_products(cells.select("_g", *keys, value.alias("_r")), ["_g", *(f"d{i}" for i in rest)], "_r", dtype)
        else:
            out = cells.groupBy("_g", *keys).agg(aggregate(value, dtype).alias("_r"))
    shape = tuple(num_groups if i == axis else n for i, n in enumerate(x.shape))
    # All places of the result from one range: no side of a join is made or sent for them.
    number, steps = F.col("id"), []
    for i in reversed(rest):
        steps.append((number % F.lit(max(1, x.shape[i])).cast("long")).alias(f"d{i}"))
        number = F.call_function("div", number, F.lit(max(1, x.shape[i])).cast("long"))
    places = session().range(num_groups * math.prod(x.shape[i] for i in rest)).select(number.alias("_g"), *steps)
    if empty is None:
        filler = F.raise_error(F.lit(f"an empty group has no {op}")).cast(meta.spark_type(dtype))
    else:
        filler = ieee.literal(empty, dtype)
    full = places.join(out, ["_g", *[f"d{i}" for i in rest]], "left").select(*[F.col("_g" if i == axis else f"d{i}").alias(f"d{i}") for i in range(x.ndim)], F.coalesce(F.col("_r").cast(meta.spark_type(dtype)), filler).alias("v"))
    chunks = tuple(num_groups if i == axis else c for i, c in enumerate(x.chunksize))
    return from_cells(full, shape, dtype, meta.normalize_chunks(chunks, shape, dtype), spec=x.spec)


def _by_user(cells, rest: list[str], name: str, op: Aggregation, chunk: int, axis: int):
    """The user's reduction: each task takes runs of rows of one group and block, and calls it once for each run."""
    keys = ["_g", *rest]
    partials = [f"p{k}" for k in range(op.width)]

    def runs(batches, columns: list[str]):
        """(key, its rows as a matrix of ``values``) of rows sorted by the key columns."""
        held, last = [], None
        for batch in batches:
            table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= table[c][1:] != table[c][:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            values = np.stack([table[c] for c in batch.schema.names if c not in columns], 1)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(table[c][lo].item() for c in columns)
                if held and key != last:
                    yield last, np.concatenate(held)
                    held = []
                last = key
                held.append(values[lo:hi])
        if held:
            yield last, np.concatenate(held)

    def out(rows: list[tuple], names: list[str]):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in keys else pa.float64()) for n, c in zip(names, columns, strict=True)], names=names)

    def partial(batches):
        rows = []
        for key, values in runs(batches, [*keys, "_b"]):
            rows.append((*key[:-1], *np.atleast_1d(op.func(values[:, 0])).astype(float).tolist()))
            if len(rows) == 10_000:
                yield out(rows, [*keys, *partials])
                rows = []
        yield out(rows, [*keys, *partials])

    def finish(batches):
        rows = []
        for key, values in runs(batches, keys):
            rows.append((*key, float(op.finish(np.atleast_1d(op.combine(values))))))
            if len(rows) == 10_000:
                yield out(rows, [*keys, "_r"])
                rows = []
        yield out(rows, [*keys, "_r"])

    at = ", ".join(f"{k} long" for k in keys)
    blocks = cells.select(*keys, F.floor(F.col(f"d{axis}") / chunk).cast("long").alias("_b"), F.col(f"d{axis}").alias("_at"), name)
    sorted_blocks = blocks.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", "_at").drop("_at")
    some = sorted_blocks.mapInArrow(partial, at + ", " + ", ".join(f"{p} double" for p in partials))
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, at + ", _r double")


def groupby_blockwise(x: Array, by: Array, op="sum", *, axis: int, num_groups: int | None = None) -> Array:
    """As groupby_reduction, for sorted labels. Spark's aggregation needs no order, so results are the same."""
    return groupby_reduction(x, by, op, axis=axis, num_groups=num_groups)


def labels_from(values: Array, edges) -> Array:
    """The number of the bin that each element lies in."""
    from .searching import searchsorted
    from .creation import asarray

    return astype(searchsorted(asarray(np.asarray(edges, float)), astype(values, np.float64), side="right"), np.int64)
