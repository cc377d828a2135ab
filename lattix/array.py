"""Lazy n-dimensional arrays over Spark DataFrames.

An array is a table with a row for each element: bigint coordinates d0, d1, ... and columns from
which ``value`` computes the element. Shape, dtype and chunks are known on the driver, so nothing
runs until compute() or a write. Elementwise operations on arrays over one table only grow the
expression: no join is planned. Arrays that are functions of their coordinates alone (constants,
arange, eye, ...) have no table at all; they become expressions over the table that they meet.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from numbers import Integral

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import meta
from .functions import ieee

_names = itertools.count()
#: A side of a join of at most so many elements may be broadcast (about 16 bytes an element).
BROADCAST_ELEMENTS = 500_000
#: A join that multiplies rows makes at most so many of them in a task, as far as there is room for tasks.
JOINED_ROWS = 1_000_000
_guard = {"raise": False}


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no active Spark session")
    return found


def new_name(prefix: str = "v") -> str:
    return f"{prefix}_{next(_names)}"


def dim(i: int) -> str:
    return f"d{i}"


def grid(shape: tuple[int, ...]) -> DataFrame:
    """All coordinates of ``shape``."""
    total = math.prod(shape)
    df, out, rest = session().range(total), [], F.col("id")
    for i in reversed(range(len(shape))):
        size = max(1, shape[i])
        out.append((rest % size if i else rest).alias(dim(i)))
        rest = F.call_function("div", rest, F.lit(size).cast("long"))
    return df.select(*reversed(out)) if out else df.select()


class Array:
    """A lazy array. ``value(coordinates)`` gives the element as a column over ``table`` (None: over any grid)."""

    def __init__(self, table: DataFrame | None, value: Callable[[list[Column]], Column], shape, dtype, chunks="auto", spec: meta.Spec | None = None):
        self.table, self.value = table, value
        self.shape = tuple(int(n) for n in shape)
        self.dtype = np.dtype(dtype)
        if self.dtype.name not in meta.DTYPES:
            raise TypeError(f"dtype {dtype} isn't supported")
        self.chunks = chunks if isinstance(chunks, tuple) and all(isinstance(c, tuple) for c in chunks) and len(chunks) == len(self.shape) else meta.normalize_chunks(chunks, self.shape, self.dtype)
        self.spec = spec or meta.Spec()

    # ------------------------------------------------------------ facts

    ndim = property(lambda self: len(self.shape))
    size = property(lambda self: math.prod(self.shape))
    itemsize = property(lambda self: self.dtype.itemsize)
    nbytes = property(lambda self: self.size * self.itemsize)
    chunksize = property(lambda self: meta.chunk_sizes(self.chunks))
    numblocks = property(lambda self: tuple(len(c) for c in self.chunks))
    npartitions = property(lambda self: math.prod(self.numblocks))
    nchunks = npartitions
    chunkmem = property(lambda self: math.prod(self.chunksize) * self.itemsize)
    device = property(lambda self: "cpu")

    def __repr__(self) -> str:
        return f"lattix.Array<shape={self.shape}, dtype={self.dtype}, chunks={self.chunks}>"

    def _repr_html_(self) -> str:
        cells = {"Shape": self.shape, "Chunk": self.chunksize, "Bytes": f"{self.nbytes:,}", "Blocks": self.nchunks, "Type": self.dtype}
        return "<table>" + "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in cells.items()) + "</table>" + self.to_svg()

    def _repr_inline_(self, max_width: int) -> str:
        return f"lattix.Array<chunksize={self.chunksize}>"[:max_width]

    def to_svg(self, size: int = 160) -> str:
        """The grid of chunks of the last two axes."""
        rows, cols = ((1,), *self.chunks)[-2:] if self.ndim else ((1,), (1,))
        h, w, lines, at = max(1, sum(rows)), max(1, sum(cols)), [], 0
        for c in (0, *cols):
            at += c
            lines.append(f'<line x1="{at * size / w:.1f}" x2="{at * size / w:.1f}" y1="0" y2="{size}" stroke="black"/>')
        at = 0
        for r in (0, *rows):
            at += r
            lines.append(f'<line y1="{at * size / h:.1f}" y2="{at * size / h:.1f}" x1="0" x2="{size}" stroke="black"/>')
        return f'<svg width="{size}" height="{size}">{"".join(lines)}</svg>'

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("a 0-d array has no length")
        return self.shape[0]

    # ------------------------------------------------------------ tables

    @property
    def coordinates(self) -> list[Column]:
        return [F.col(dim(i)) for i in range(self.ndim)]

    @property
    def column(self) -> Column:
        return self.value(self.coordinates)

    def base(self) -> DataFrame:
        return grid(self.shape) if self.table is None else self.table

    def cells(self, name: str = "v") -> DataFrame:
        """d0, d1, ..., and the element: a row for each element."""
        return self.base().select(*self.coordinates, self.column.cast(meta.spark_type(self.dtype)).alias(name))

    def explain(self, mode: str = "formatted") -> None:
        self.cells().explain(mode)

    visualize = explain

    def with_chunks(self, chunks) -> Array:
        return Array(self.table, self.value, self.shape, self.dtype, meta.normalize_chunks(chunks, self.shape, self.dtype), self.spec)

    rechunk = with_chunks

    # ------------------------------------------------------------ terminals

    def compute(self, callbacks=None) -> np.ndarray:
        from .plans.runtime import run

        return run([self], callbacks)[0]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = self.compute()
        return out if dtype is None else out.astype(dtype)

    def item(self):
        if self.size != 1:
            raise TypeError("only arrays with one element convert to a scalar")
        return self.compute().reshape(())[()]

    def _scalar(self, what: str):
        if self.ndim:
            raise TypeError(f"only 0-d arrays convert to {what}")
        if what in ("int", "float") and self.dtype.kind == "c":
            raise TypeError(f"a complex array doesn't convert to {what}")
        return self.item()

    def __bool__(self):
        return bool(self._scalar("bool"))

    def __int__(self):
        return int(self._scalar("int"))

    def __float__(self):
        return float(self._scalar("float"))

    def __complex__(self):
        return complex(self._scalar("complex"))

    def __index__(self):
        if self.dtype.kind not in "iu":
            raise TypeError("only integer arrays can be an index")
        return int(self._scalar("int"))

    def __array_namespace__(self, *, api_version: str | None = None):
        if api_version not in (None, "2021.12", "2022.12", "2023.12", "2024.12", "2025.12"):
            raise ValueError(f"API version {api_version}")
        import lattix

        return lattix

    __hash__ = None

    # ------------------------------------------------------------ views

    @property
    def T(self) -> Array:
        if self.ndim != 2:
            raise ValueError("T takes 2-d arrays")
        return self.mT

    @property
    def mT(self) -> Array:
        from .operators.manipulation import permute_dims

        if self.ndim < 2:
            raise ValueError("mT takes arrays of 2 dimensions at least")
        return permute_dims(self, (*range(self.ndim - 2), self.ndim - 1, self.ndim - 2))

    def __getitem__(self, key) -> Array:
        from .operators.indexing import index

        return index(self, key)

    @property
    def blocks(self):
        from .operators.indexing import BlockView

        return BlockView(self)

    def astype(self, dtype, copy: bool = True) -> Array:
        from .operators.elementwise import astype

        return astype(self, dtype, copy=copy)


# ---------------------------------------------------------------- joins by position

def is_array(x) -> bool:
    return isinstance(x, Array)


def combine(fn: Callable[..., Column], arrays: list[Array], dtype, shape: tuple[int, ...] | None = None, chunks=None) -> Array:
    """fn over the elements of ``arrays`` at each position of their broadcast shape."""
    shape = shape or np.broadcast_shapes(*(a.shape for a in arrays))
    if any(a.spec != arrays[0].spec for a in arrays):
        raise ValueError("arrays with different specs")
    ndim = len(shape)
    if chunks is None:
        chunks = tuple(meta.smallest_chunks(*[a.chunks[i - ndim + a.ndim] for a in arrays if i - ndim + a.ndim >= 0 and a.shape[i - ndim + a.ndim] == n]) for i, n in enumerate(shape))
    groups: list[tuple[DataFrame, Array, list[int]]] = []  # (table, an array over it, the operands)
    for k, a in enumerate(arrays):
        if a.table is None:
            continue
        for table, first, ks in groups:
            if table is a.table and first.shape == a.shape:
                ks.append(k)
                break
        else:
            groups.append((a.table, a, [k]))
    if not groups:
        def virtual(coordinates):
            return fn(*[a.value(_own(a, shape, coordinates)) for a in arrays])

        return Array(None, virtual, shape, dtype, chunks, arrays[0].spec)
    if len(groups) == 1 and groups[0][1].shape == shape:
        table = groups[0][0]
        return Array(table, lambda cs: fn(*[a.value(_own(a, shape, cs)) for a in arrays]), shape, dtype, chunks, arrays[0].spec)
    names: dict[int, str] = {}
    sides = []
    for table, first, ks in groups:
        axes = [i for i in range(first.ndim) if first.shape[i] != 1]
        names.update((k, new_name()) for k in ks)
        keys = [F.col(dim(i)).alias(dim(i + ndim - first.ndim)) for i in axes]
        sides.append((table.select(*keys, *[arrays[k].column.alias(names[k]) for k in ks]), {i + ndim - first.ndim for i in axes}, first.size))
    covered = set().union(*(s[1] for s in sides))
    for i, n in enumerate(shape):
        if n != 1 and i not in covered:
            sides.append((session().range(n).toDF(dim(i)), {i}, n))
    sides.sort(key=lambda s: -s[2])
    table, have, rows = sides[0]
    if math.prod(shape) > max(rows, JOINED_ROWS):
        # Few rows, of one file perhaps, become many: dealt over tasks before, not made by one.
        table = table.repartition(min(rows, _tasks(math.prod(shape))))
    for side, keys, size in sides[1:]:
        if size > BROADCAST_ELEMENTS and not have & keys:
            side = side.repartition(_tasks(size))
        elif size <= BROADCAST_ELEMENTS:
            side = F.broadcast(side)
        shared = sorted(have & keys)
        table = table.join(side, [dim(i) for i in shared]) if shared else table.crossJoin(side)
        have |= keys
    table = table.select(*[F.col(dim(i)) if i in have else F.lit(0).cast("long").alias(dim(i)) for i in range(ndim)], *names.values())

    def joined(coordinates):
        return fn(*[F.col(names[k]) if k in names else a.value(_own(a, shape, coordinates)) for k, a in enumerate(arrays)])

    return Array(table, joined, shape, dtype, chunks, arrays[0].spec)


def _tasks(rows: int) -> int:
    """So many tasks that each makes JOINED_ROWS rows, or as many as there is room for."""
    spark = session()
    room = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(room, -(-rows // JOINED_ROWS)))


def _own(a: Array, shape: tuple[int, ...], coordinates: list[Column]) -> list[Column]:
    """The coordinates of ``a`` at a position of the broadcast shape."""
    skip = len(shape) - a.ndim
    return [F.lit(0).cast("long") if n == 1 and shape[i + skip] != 1 else coordinates[i + skip] for i, n in enumerate(a.shape)]


def moved(x: Array, coordinates: list[Column], shape, where: Column | None = None, chunks="auto", dtype=None) -> Array:
    """The elements of ``x``, those with ``where``, at new coordinates (columns over its table)."""
    name = new_name()
    table = x.base() if where is None else x.base().where(where)
    table = table.select(*[c.cast("long").alias(dim(i)) for i, c in enumerate(coordinates)], x.column.alias(name))
    return Array(table, lambda _: F.col(name), shape, dtype or x.dtype, chunks, x.spec)


def from_cells(table: DataFrame, shape, dtype, chunks="auto", value: str = "v", spec=None) -> Array:
    """An array over a table of coordinates d0, d1, ... and values: a row for each element."""
    return Array(table, lambda _: F.col(value), shape, dtype, chunks, spec)


def full(shape, fill_value, dtype, chunks="auto", spec=None) -> Array:
    c = ieee.literal(fill_value, dtype)
    shape = (shape,) if isinstance(shape, Integral) else tuple(shape)
    return Array(None, lambda _: c, shape, dtype, chunks, spec)
