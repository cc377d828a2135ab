"""Membership and sorted search."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .. import meta
from ..array import BROADCAST_ELEMENTS, Array, combine, from_cells, new_name, session
from ..functions import ieee
from .blocks import _values, cell_schema
from .elementwise import astype

#: Sorted arrays up to this size are sent to every task; longer ones are searched by their blocks.
MAX_SENT_BYTES = 8_000_000


def isin(x1: Array, x2: Array, /, *, invert: bool = False) -> Array:
    d = meta.result_type(x1, x2)
    x1, x2 = astype(x1, d), astype(x2, d)
    values = x2.base().select(x2.column.alias("_k"))
    if d.kind == "f":  # NaN is no member; 0.0 and -0.0 join as equals
        values = values.where(~F.isnan("_k"))
    values = values.distinct().withColumn("_in", F.lit(True))
    if x2.size <= BROADCAST_ELEMENTS:
        values = F.broadcast(values)
    name = new_name()
    table = x1.base().select(*x1.coordinates, x1.column.alias(name))
    table = table.join(values, F.col(name) == F.col("_k"), "left")
    found = F.col("_in").isNotNull()
    return from_cells(table.select(*x1.coordinates, (~found if invert else found).alias("v")), x1.shape, bool, x1.chunks, spec=x1.spec)


def searchsorted(x1: Array, x2: Array, /, *, side: str = "left", sorter=None) -> Array:
    if sorter is not None:
        raise NotImplementedError("sorter")
    if side not in ("left", "right"):
        raise ValueError(f"side {side!r}")
    if x1.ndim != 1:
        raise ValueError("x1 must have 1 dimension")
    d = meta.result_type(x1, x2)
    if x1.size * d.itemsize <= MAX_SENT_BYTES:
        held = session().sparkContext.broadcast(x1.compute().astype(d))

        def find(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(held.value, v.to_numpy().astype(held.value.dtype), side))

        udf = F.pandas_udf(find, "long")
        query = astype(x2, d)
        return combine(lambda v: udf(v), [query], np.int64)
    return _search_blocks(astype(x1, d), astype(x2, d), side)


#: Queries that one copy of a block of the sorted array answers.
QUERIES_A_COPY = 10_000_000


def _search_blocks(x1: Array, x2: Array, side: str) -> Array:
    """Queries go to the block of x1 that their place lies in, and are searched there batch by batch.

    Each block has as many copies as there may be queries for it, so that no task has to take all of a popular one.
    """
    size = max(1, min(x1.chunksize[0], MAX_SENT_BYTES // (4 * x1.itemsize)))
    size = max(size, -(-x1.size // (MAX_SENT_BYTES // x1.itemsize)))
    from .creation import asarray

    firsts = asarray(x1[:: size].compute()) if x1.size // size * x1.itemsize < 1_000_000 else x1[::size]
    block = searchsorted(firsts, x2, side=side)  # blocks that begin before the place
    name, d, ndim = new_name(), x1.dtype, x2.ndim
    copies = int(min(64, max(1, -(-x2.size // QUERIES_A_COPY))))
    cells = x1.base().select(F.floor(F.col("d0") / size).cast("long").alias("_b"), x1.column.cast(meta.spark_type(d)).alias(name), F.col("d0").alias("_i"))
    arrays = cells.groupBy("_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", name))), lambda s: s[name]).alias("_a"))
    queries = combine(lambda b, v: F.struct(F.greatest(b - 1, F.lit(0)).alias("b"), v.alias("v")), [block, x2], np.float64)
    rows = queries.base().select(*queries.coordinates, queries.column.alias("_q"))
    none = [F.lit(None).cast("long").alias(f"d{i}") for i in range(ndim)]
    value = meta.spark_type(d).simpleString()
    copy = F.pmod(F.xxhash64(*x2.coordinates) if ndim else F.lit(0).cast("long"), F.lit(copies)).cast("int")
    asked = rows.select(F.col("_q.b").cast("long").alias("_b"), copy.alias("_c"), F.lit(1).alias("_side"), F.lit(None).cast(f"array<{value}>").alias("_a"), F.col("_q.v").cast(value).alias("_v"), *x2.coordinates)
    held = arrays.select("_b", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_c"), F.lit(0).alias("_side"), "_a", F.lit(None).cast(value).alias("_v"), *none)

    def run(batches):
        sorted_block = np.zeros(0, d)
        for batch in batches:
            sides, b = batch.column("_side").to_numpy(), batch.column("_b").to_numpy()
            for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(b * 2 + sides)) + 1).tolist(), len(b)]):
                if hi == lo:
                    continue
                if sides[lo] == 0:
                    sorted_block = _values(batch.column("_a"), hi - 1, d)
                    continue
                v = _values(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("_v").slice(lo, hi - lo)), 0, d)
                found = b[lo:hi] * size + np.searchsorted(sorted_block, v, side)
                yield pa.RecordBatch.from_arrays([*(batch.column(f"d{i}").slice(lo, hi - lo) for i in range(ndim)), pa.array(found)], names=[*(f"d{i}" for i in range(ndim)), "v"])

    both = held.unionByName(asked).repartition("_b", "_c").sortWithinPartitions("_b", "_c", "_side")
    return from_cells(both.mapInArrow(run, cell_schema(ndim, np.dtype(np.int64))), x2.shape, np.int64, x2.chunks, spec=x2.spec)
