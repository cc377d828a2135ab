"""Contractions by joins of blocks, and tall-skinny QR and SVD."""

from __future__ import annotations

import math
from numbers import Integral

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, from_cells, session
from .blocks import _values, block_shape, cell_schema, cells_batch, check_memory, to_blocks
from .elementwise import astype, multiply
from .manipulation import broadcast_to, expand_dims, moveaxis, permute_dims, reshape, squeeze
from .reductions import sum as sum_
from .reductions import wrapping_sum

#: Side of the square blocks in which products are computed: 8 MB of float64.
PRODUCT_BLOCK = 1000
#: Elements of the common axis up to which a product is made from panels of whole rows and columns.
PANEL_DEPTH = 10_000


def matmul(x1: Array, x2: Array, /, split_every=None) -> Array:
    """Blocks meet on their common block number; partial products are summed by position."""
    meta.check_kind("matmul", "numeric", x1.dtype, x2.dtype)
    if not x1.ndim or not x2.ndim:
        raise ValueError("matmul takes no 0-d arrays")
    first, second = x1.ndim == 1, x2.ndim == 1
    x1 = expand_dims(x1, 0) if first else x1
    x2 = expand_dims(x2, 1) if second else x2
    if x1.shape[-1] != x2.shape[-2]:
        raise ValueError(f"shapes {x1.shape} and {x2.shape} don't fit")
    d = meta.result_type(x1, x2)
    loops = np.broadcast_shapes(x1.shape[:-2], x2.shape[:-2])
    x1 = broadcast_to(astype(x1, d), (*loops, *x1.shape[-2:]))
    x2 = broadcast_to(astype(x2, d), (*loops, *x2.shape[-2:]))
    out = _product(x1, x2, loops, d)
    if first:
        out = squeeze(out, out.ndim - 2)
    return squeeze(out, out.ndim - 1) if second else out


def _product(x1: Array, x2: Array, loops, d) -> Array:
    """Blocks of both sides go to each block of the result that needs them; a task multiplies along the common
    axis and adds up, so that a block of the result leaves it once. Where the result has fewer blocks than
    there is room for tasks, the common axis is cut in segments, whose sums are added by position.
    """
    (n, k), m = x1.shape[-2:], x2.shape[-1]
    shape, nl = (*loops, n, m), len(loops)
    if not k or not math.prod(shape):
        from ..array import full

        return full(shape, 0, d, spec=x1.spec)
    side = lambda c, size: max(1, min(size, max(c, min(PRODUCT_BLOCK, size)), PRODUCT_BLOCK))
    bn, bk, bm = side(x1.chunksize[-2], n), side(x1.chunksize[-1], k), side(x2.chunksize[-1], m)
    ones = (1,) * nl
    a, b = x1.with_chunks((*ones, bn, bk)), x2.with_chunks((*ones, bk, bm))
    check_memory(x1.spec, [bn * bk * d.itemsize, bk * bm * d.itemsize], [bn * bm * d.itemsize])
    spark, lb = session(), [f"b{i}" for i in range(nl)]
    blocks_n, blocks_k, blocks_m = -(-n // bn), -(-k // bk), -(-m // bm)
    room = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not nl and k <= PANEL_DEPTH and min(blocks_n, blocks_m) > 1:
        return _panels(x1, x2, (bn, bm), room, d)
    segments = min(blocks_k, max(1, room // (math.prod(loops) * blocks_n * blocks_m)))
    segment = F.floor(F.col("bk") * segments / blocks_k).cast("int").alias("seg")
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = to_blocks(a, "x").withColumnsRenamed({f"b{nl}": "bi", f"b{nl + 1}": "bk"})
    right = to_blocks(b, "x").withColumnsRenamed({f"b{nl}": "bk", f"b{nl + 1}": "bj"})
    left = left.select(*lb, "bi", every("bj", blocks_m), segment, "bk", F.lit(0).alias("side"), "x")
    right = right.select(*lb, every("bi", blocks_n), "bj", segment, "bk", F.lit(1).alias("side"), "x")
    keys = [*lb, "bi", "bj", "seg"]
    shapes = (*loops, n, k), (*loops, k, m)

    def run(batches):
        key, total, held = None, None, None
        for batch in batches:
            for r, (*now, kk, which) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "bk", "side")), strict=True)):
                if now != key:
                    if total is not None:
                        yield cells_batch(total.reshape((*ones, *total.shape)), [*key[:nl], key[nl] * bn, key[nl + 1] * bm], d)
                    key, total = now, None
                if which == 0:
                    held = _values(batch.column("x"), r, d).reshape(block_shape(shapes[0], (*ones, bn, bk), (*now[:nl], now[nl], kk))[nl:])
                else:
                    q = _values(batch.column("x"), r, d).reshape(block_shape(shapes[1], (*ones, bk, bm), (*now[:nl], kk, now[nl + 1]))[nl:])
                    total = held @ q if total is None else total + held @ q
        if total is not None:
            yield cells_batch(total.reshape((*ones, *total.shape)), [*key[:nl], key[nl] * bn, key[nl + 1] * bm], d)

    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "bk", "side")
    cells = both.mapInArrow(run, cell_schema(nl + 2, d))
    chunks = meta.normalize_chunks((*ones, bn, bm), shape, d)
    if segments == 1:
        return from_cells(cells, shape, d, chunks, spec=x1.spec)
    if d.kind == "c":
        part = "float" if d.itemsize == 8 else "double"
        total = F.struct(F.sum("v.re").cast(part).alias("re"), F.sum("v.im").cast(part).alias("im"))
    else:
        total = wrapping_sum(F.col("v"), d)
    return from_cells(cells.groupBy(*[f"d{i}" for i in range(nl + 2)]).agg(total.alias("v")), shape, d, chunks, spec=x1.spec)


def _panels(x1: Array, x2: Array, block, room: int, d) -> Array:
    """The product of n rows and m columns, both many, from panels of whole rows and of whole columns.

    Each panel lies in one partition, and a task reads one of either side from where it was shuffled to: nothing
    is copied for the blocks of the result, which leave the task one by one.
    """
    (n, k), m = x1.shape, x2.shape[1]
    side = math.ceil(math.sqrt(room))
    pn, pm = (max(1, min(PRODUCT_BLOCK**2 // k, -(-size // side))) for size in (n, m))
    bn, bm = min(block[0], pn), min(block[1], pm)
    check_memory(x1.spec, [pn * k * d.itemsize, k * pm * d.itemsize], [bn * bm * d.itemsize])
    left = to_blocks(x1.with_chunks((pn, k)), "x").select(F.col("b0").alias("bi"), F.col("x").alias("x0")).repartitionById(-(-n // pn), "bi")
    right = to_blocks(x2.with_chunks((k, pm)), "x").select(F.col("b1").alias("bj"), F.col("x").alias("x1")).repartitionById(-(-m // pm), "bj")

    def run(batches):
        for batch in batches:
            for r, (bi, bj) in enumerate(zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), strict=True)):
                a, b = _values(batch.column("x0"), r, d).reshape(-1, k), _values(batch.column("x1"), r, d).reshape(k, -1)
                for i in range(0, len(a), bn):
                    for j in range(0, b.shape[1], bm):
                        yield cells_batch(a[i : i + bn] @ b[:, j : j + bm], (bi * pn + i, bj * pm + j), d)

    # The hint: a broadcast of one side would leave as many tasks as the other has panels.
    cells = left.join(right.hint("shuffle_replicate_nl")).mapInArrow(run, cell_schema(2, d))
    return from_cells(cells, (n, m), d, meta.normalize_chunks(block, (n, m), d), spec=x1.spec)


def tensordot(x1: Array, x2: Array, /, *, axes=2, split_every=None) -> Array:
    if isinstance(axes, Integral):
        axes = (tuple(range(x1.ndim - axes, x1.ndim)), tuple(range(axes)))
    a1 = meta.normalize_axis(axes[0], x1.ndim)
    a2 = meta.normalize_axis(axes[1], x2.ndim)
    if [x1.shape[i] for i in a1] != [x2.shape[i] for i in a2]:
        raise ValueError("contracted axes differ in size")
    k1, k2 = [i for i in range(x1.ndim) if i not in a1], [i for i in range(x2.ndim) if i not in a2]
    s1, s2, inner = [x1.shape[i] for i in k1], [x2.shape[i] for i in k2], math.prod(x1.shape[i] for i in a1)
    left = reshape(permute_dims(x1, (*k1, *a1)) if x1.ndim else x1, (math.prod(s1), inner))
    right = reshape(permute_dims(x2, (*a2, *k2)) if x2.ndim else x2, (inner, math.prod(s2)))
    return reshape(matmul(left, right), (*s1, *s2))


def vecdot(x1: Array, x2: Array, /, *, axis=-1, split_every=None) -> Array:
    return sum_(multiply(moveaxis(x1, axis, -1), moveaxis(x2, axis, -1)), axis=-1, dtype=meta.result_type(x1, x2))


def outer(x1: Array, x2: Array, /) -> Array:
    if x1.ndim != 1 or x2.ndim != 1:
        raise ValueError("outer takes 1-d arrays")
    return multiply(expand_dims(x1, 1), expand_dims(x2, 0))


def matrix_transpose(x: Array, /) -> Array:
    return x.mT


#: Rows of stacked R factors that one task takes; more are reduced in further levels.
STACK_ROWS = 20_000


def _tall(x: Array) -> Array:
    if x.ndim != 2:
        raise ValueError("x must have 2 dimensions")
    if x.dtype.kind != "f":
        raise TypeError("qr and svd take floating-point arrays")
    if x.numblocks[1] > 1:
        raise ValueError("all columns must be one chunk")
    if x.chunksize[0] < x.shape[1] < x.shape[0]:
        x = x.with_chunks((x.shape[1], -1))
    return x


def tsqr(x: Array):
    """(blocks: b, q (rows by n), R as an ndarray): Q's blocks in rows, the small R on the driver."""
    x = _tall(x)
    rows, n = x.shape
    size, d = x.chunksize[0], x.dtype
    check_memory(x.spec, [x.chunkmem], [2 * x.chunkmem])
    level = to_blocks(x, "a").select(F.col("b0").cast("long").alias("b"), "a")

    def local(batches, take_rows):
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.column("b")[r].as_py()
                a = _values(batch.column("a"), r, np.dtype(float)).reshape(take_rows(b) if take_rows else -1, n)
                q, upper = np.linalg.qr(a)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([q.ravel().tolist()], pa.list_(pa.float64())), pa.array([upper.ravel().tolist()], pa.list_(pa.float64())), pa.array([q.shape[1]], pa.int64())], names=["b", "q", "r", "k"])

    schema = "b long, q array<double>, r array<double>, k long"
    count = -(-rows // size)
    level = level.mapInArrow(lambda it: local(it, lambda b: min(size, rows - b * size)), schema)
    from ..sources.parquet import checkpoint

    level = checkpoint(level)
    levels, fan = [level], max(2, STACK_ROWS // max(1, n))
    while count > 1:
        stacked = level.select(F.floor(F.col("b") / fan).cast("long").alias("b"), F.col("b").alias("i"), "r").groupBy("b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"])).alias("a"))
        level = checkpoint(stacked.mapInArrow(lambda it: local(it, None), schema))
        levels.append(level)
        count = -(-count // fan)
    last = level.collect()[0]
    upper = np.array(last["r"]).reshape(last["k"], n)
    # From the top down: each block's Q times its part of the Q above.
    q = levels[-1].select("b", "q")
    for lower in reversed(levels[:-1]):
        sizes = lower.select("b", F.col("k"), F.floor(F.col("b") / fan).cast("long").alias("up"))
        offsets = sizes.select("b", "up", "k", F.coalesce(F.expr("sum(k) over (partition by up order by b rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("at"))
        joined = lower.select("b", F.col("q").alias("own"), F.col("k").alias("kk")).join(offsets.drop("k"), "b").join(q.select(F.col("b").alias("up"), F.col("q").alias("above")), "up").select("b", "own", "kk", "at", "above")
        cols = upper.shape[0]

        def step(batches, cols=cols):
            for batch in batches:
                for r in range(batch.num_rows):
                    kk, at = batch.column("kk")[r].as_py(), batch.column("at")[r].as_py()
                    own = _values(batch.column("own"), r, np.dtype(float)).reshape(-1, kk)
                    above = _values(batch.column("above"), r, np.dtype(float)).reshape(-1, cols)[at : at + kk]
                    yield pa.RecordBatch.from_arrays([batch.column("b").slice(r, 1), pa.array([(own @ above).ravel().tolist()], pa.list_(pa.float64()))], names=["b", "q"])

        q = joined.mapInArrow(step, "b long, q array<double>")
    return q, upper, size, d


def _q_array(q, factor: np.ndarray | None, x: Array, size: int, cols: int, d) -> Array:
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.column("b")[r].as_py()
                block = _values(batch.column("q"), r, np.dtype(float)).reshape(min(size, x_rows - b * size), -1)
                yield cells_batch((block if factor is None else block @ factor).astype(d), [b * size, 0], d)

    x_rows = x.shape[0]
    return from_cells(q.mapInArrow(run, cell_schema(2, d)), (x_rows, cols), d, meta.normalize_chunks((size, -1), (x_rows, cols), d), spec=x.spec)


def _small(values: np.ndarray, d, spec) -> Array:
    from .creation import asarray

    return asarray(np.ascontiguousarray(values.astype(d)), spec=spec)


def qr(x: Array, /, *, mode="reduced") -> tuple[Array, Array]:
    """Reduced QR of a tall array whose columns are one chunk."""
    if mode != "reduced":
        raise ValueError("only mode 'reduced'")
    q, upper, size, d = tsqr(x)
    return _q_array(q, None, x, size, upper.shape[0], d), _small(upper, d, x.spec)


def svd(x: Array, /, *, full_matrices=True) -> tuple[Array, Array, Array]:
    if full_matrices:
        raise NotImplementedError("only full_matrices=False")
    if x.shape[0] < x.shape[1]:
        u, s, vt = svd(x.T.with_chunks((x.chunksize[1], -1)), full_matrices=False)
        return vt.T, s, u.T
    q, upper, size, d = tsqr(x)
    u, s, vt = np.linalg.svd(upper, full_matrices=False)
    return _q_array(q, u, x, size, u.shape[1], d), _small(s, d, x.spec), _small(vt, d, x.spec)


def svdvals(x: Array, /) -> Array:
    if x.shape[0] < x.shape[1]:
        return svdvals(x.T.with_chunks((x.chunksize[1], -1)))
    _, upper, _, d = tsqr(x)
    return _small(np.linalg.svd(upper, compute_uv=False), d, x.spec)
