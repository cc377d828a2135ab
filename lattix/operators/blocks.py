"""Functions of whole blocks: NumPy over Arrow, one block of each array at a time.

A block travels as a row: block numbers and its elements in C order. Blocks are gathered by one
shuffle on the block numbers; several arrays on one grid of blocks are gathered together.
"""

from __future__ import annotations

import inspect
import itertools
import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, from_cells, new_name, session


def projected_mem(spec: meta.Spec, inputs: list[int], outputs: list[int], copies: int = 2) -> int:
    """Bytes that a block function may need: what is reserved, and every block with its copies."""
    return spec.reserved_mem + sum(n * (1 + copies) for n in inputs) + sum(n * (1 + copies) for n in outputs)


def check_memory(spec: meta.Spec, inputs: list[int], outputs: list[int]) -> None:
    need = projected_mem(spec, inputs, outputs)
    if need > spec.allowed_mem:
        raise ValueError(f"projected task memory ({need}) exceeds allowed_mem ({spec.allowed_mem})")


def _place(coordinates, sizes, shape):
    """The place of an element in its block, in C order."""
    out = F.lit(0).cast("long")
    for c, s, n in zip(coordinates, sizes, shape, strict=True):
        width = F.least(F.lit(s).cast("long"), F.lit(n).cast("long") - F.floor(c / s) * s)
        out = out * width + c % s
    return out


def to_blocks(x: Array, value: str = "x0") -> DataFrame:
    """b0, b1, ..., and an array column of a block's elements in C order."""
    sizes = x.chunksize
    ids = [F.floor(c / s).cast("int").alias(f"b{i}") for i, (c, s) in enumerate(zip(x.coordinates, sizes, strict=True))]
    name = new_name()
    table = x.base().select(*ids, _place(x.coordinates, sizes, x.shape).alias("_p"), x.column.cast(meta.spark_type(x.dtype)).alias(name))
    return table.groupBy(*[f"b{i}" for i in range(x.ndim)]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", name))), lambda s: s[name]).alias(value))


def block_shape(shape, sizes, block) -> tuple[int, ...]:
    return tuple(min(s, n - b * s) for n, s, b in zip(shape, sizes, block, strict=True))


def _values(column, row: int, dtype) -> np.ndarray:
    part = column.slice(row, 1).flatten()
    if dtype.kind == "c":
        return (part.field(0).to_numpy(zero_copy_only=False) + 1j * part.field(1).to_numpy(zero_copy_only=False)).astype(dtype)
    if dtype.name == "uint64":
        return np.array([int(v) for v in part.to_pylist()], np.uint64)
    return part.to_numpy(zero_copy_only=False).astype(dtype)


def cells_batch(block: np.ndarray, offset, dtype) -> pa.RecordBatch:
    """The elements of a block with their coordinates."""
    at = [(np.arange(n) + o).reshape(-1, *(1,) * (block.ndim - 1 - i)) for i, (n, o) in enumerate(zip(block.shape, offset, strict=True))]
    columns = [pa.array(np.broadcast_to(c, block.shape).ravel()) for c in at]
    flat = np.ascontiguousarray(block).ravel()
    if dtype.kind == "c":
        part = pa.float32() if dtype.itemsize == 8 else pa.float64()
        value = pa.StructArray.from_arrays([pa.array(flat.real, part), pa.array(flat.imag, part)], names=["re", "im"])
    elif dtype.name == "uint64":
        from decimal import Decimal

        value = pa.array([Decimal(int(v)) for v in flat], pa.decimal128(20, 0))
    else:
        value = pa.array(flat.astype({"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}.get(dtype.name, dtype)))
    return pa.RecordBatch.from_arrays([*columns, value], names=[*[f"d{i}" for i in range(block.ndim)], "v"])


def cell_schema(ndim: int, dtype) -> str:
    return ", ".join([*[f"d{i} long" for i in range(ndim)], f"v {meta.spark_type(dtype).simpleString()}"])


def block_source(make: Callable, shape, dtype, chunks, spec=None) -> Array:
    """An array whose blocks are made by tasks: make(block numbers, slices) gives a block."""
    shape, dtype = tuple(shape), np.dtype(dtype)
    chunks = meta.normalize_chunks(chunks, shape, dtype)
    sizes, counts = meta.chunk_sizes(chunks), [len(c) for c in chunks]
    total = math.prod(counts) if math.prod(shape) else 0

    def run(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                block = np.unravel_index(number, counts) if counts else ()
                offset = [int(b) * s for b, s in zip(block, sizes, strict=True)]
                slices = tuple(slice(o, o + n) for o, n in zip(offset, block_shape(shape, sizes, block), strict=True))
                yield cells_batch(np.asarray(make(tuple(int(b) for b in block), slices), dtype), offset, dtype)

    parts = max(1, min(total, 4 * session().sparkContext.defaultParallelism))
    return from_cells(session().range(total, numPartitions=parts).mapInArrow(run, cell_schema(len(shape), dtype)), shape, dtype, chunks, spec=spec)


def map_blocks(func: Callable, *arrays: Array, dtype=None, chunks=None, drop_axis=None, new_axis=None, spec=None, shape=None, **kwargs) -> Array:
    """func over corresponding blocks. If it takes block_id, it gets the block's numbers.

    drop_axis and new_axis name axes that blocks lose and gain; a dropped axis must have one block.
    chunks: block sizes of the result, if they differ. Without arrays, chunks and shape say what is made.
    """
    wants_id = "block_id" in inspect.signature(func).parameters if _has_signature(func) else False
    dtype = np.dtype(dtype if dtype is not None else arrays[0].dtype)
    if not arrays:
        sizes = meta.normalize_chunks(chunks, shape, dtype) if shape is not None else tuple(tuple(c) for c in chunks)
        shape = tuple(sum(c) for c in sizes)
        return block_source(lambda block, slices: func(**({"block_id": block} if wants_id else {}), **kwargs), shape, dtype, sizes, spec)
    ndim = max(a.ndim for a in arrays)
    first = next(a for a in arrays if a.ndim == ndim)
    counts = np.broadcast_shapes(*(a.numblocks for a in arrays))
    dropped = set(meta.normalize_axis(drop_axis, ndim)) if drop_axis is not None else set()
    if any(counts[a] > 1 for a in dropped):
        raise ValueError("an axis that is dropped must have one block")
    kept = [i for i in range(ndim) if i not in dropped]
    gained = sorted([new_axis] if isinstance(new_axis, int) else new_axis or [])
    out_counts, source = [counts[i] for i in kept], list(kept)
    base = [first.chunks[i] if first.numblocks[i] == counts[i] else next(a for a in arrays if a.ndim > i - ndim + a.ndim >= 0 and a.numblocks[i - ndim + a.ndim] == counts[i]).chunks[i - ndim + first.ndim] for i in kept]
    for a in gained:
        out_counts.insert(a, 1)
        source.insert(a, None)
        base.insert(a, (1,))
    if chunks is not None:
        base = [tuple(c) if isinstance(c, tuple | list) else (int(c),) * k for c, k in zip(chunks, out_counts, strict=True)]
    out_shape = tuple(sum(c) for c in base)
    offsets = [np.concatenate([[0], np.cumsum(c)]).tolist() for c in base]
    check_memory(first.spec, [a.chunkmem for a in arrays], [math.prod(max(c, default=1) for c in base) * dtype.itemsize])
    rows = _together(list(arrays), ndim)
    shapes, sizes, dtypes = [a.shape for a in arrays], [a.chunksize for a in arrays], [a.dtype for a in arrays]

    def run(batches):
        for batch in batches:
            numbers = [batch.column(f"b{i}").to_pylist() for i in range(ndim)]
            for r in range(batch.num_rows):
                block = tuple(n[r] for n in numbers)
                parts = []
                for k in range(len(shapes)):
                    own = tuple(0 if -(-shapes[k][i] // sizes[k][i]) <= 1 else block[i + ndim - len(shapes[k])] for i in range(len(shapes[k])))
                    parts.append(_values(batch.column(f"x{k}"), r, dtypes[k]).reshape(block_shape(shapes[k], sizes[k], own)))
                out_block = tuple(0 if s is None else block[s] for s in source)
                made = func(*parts, **({"block_id": out_block} if wants_id else {}), **kwargs)
                yield cells_batch(np.asarray(made).astype(dtype), [offsets[i][b] for i, b in enumerate(out_block)], dtype)

    regular = tuple(base) if all(len(set(c[:-1])) <= 1 and (not c or c[-1] <= c[0]) for c in base) else "auto"
    return from_cells(rows.mapInArrow(run, cell_schema(len(out_shape), dtype)), out_shape, dtype, regular, spec=first.spec)


def _has_signature(func) -> bool:
    try:
        inspect.signature(func)
    except (TypeError, ValueError):
        return False
    return True


def _together(arrays: list[Array], ndim: int) -> DataFrame:
    """A row for each block of the common grid with the blocks x0, x1, ... of all arrays."""
    table, have = None, []
    for k, a in enumerate(arrays):
        skip = ndim - a.ndim
        axes = [i for i in range(a.ndim) if a.numblocks[i] > 1]
        side = to_blocks(a, f"x{k}").select(*[F.col(f"b{i}").alias(f"b{i + skip}") for i in axes], f"x{k}")
        keys = [i + skip for i in axes]
        if table is None:
            table, have = side, keys
            continue
        shared = [f"b{i}" for i in keys if i in have]
        table = table.join(side, shared) if shared else table.crossJoin(side)
        have = sorted({*have, *keys})
    return table.select(*[F.col(f"b{i}") if i in have else F.lit(0).alias(f"b{i}") for i in range(ndim)], *[f"x{k}" for k in range(len(arrays))])


def _packed(x: Array, k: int) -> DataFrame:
    """k, n (the linear number of a block), data (its elements in C order): a row for each block."""
    counts, dtype, ndim = x.numblocks, x.dtype, x.ndim

    def run(batches):
        for batch in batches:
            numbers = [batch.column(f"b{i}").to_pylist() for i in range(ndim)]
            for r in range(batch.num_rows):
                n = int(np.ravel_multi_index(tuple(b[r] for b in numbers), counts)) if ndim else 0
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([_values(batch.column("x"), r, dtype).tobytes()], pa.binary())], names=["k", "n", "data"])

    return to_blocks(x, "x").mapInArrow(run, "k int, n long, data binary")


def _by_key(batches, *names: str):
    """(key, rows as lists of values) of consecutive rows with equal values of the first column; the others are read in order."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row[1:])
    if rows:
        yield key, rows


def general_blockwise(func: Callable, key_function: Callable, *arrays: Array, shapes, dtypes, chunkss, spec=None, **kwargs) -> tuple[Array, ...]:
    """func over any blocks: key_function(block numbers of the result) names, for each argument of func, a block
    as (number of the array, its block numbers), or a list of such. Gives an array for each of ``shapes``, all
    with the same grid of blocks; func returns a tuple if there are several, and gets block_id if it takes one.

    func runs once for a block, however many results are computed.
    """
    dtypes = [np.dtype(d) for d in dtypes]
    chunkss = [meta.normalize_chunks(c, tuple(s), d) for c, s, d in zip(chunkss, shapes, dtypes, strict=True)]
    counts = tuple(len(c) for c in chunkss[0])
    if any(tuple(len(c) for c in chunks) != counts for chunks in chunkss):
        raise ValueError("results must have the same grid of blocks")
    wants_id = "block_id" in inspect.signature(func).parameters if _has_signature(func) else False
    plan = []
    for number, block in enumerate(itertools.product(*(range(c) for c in counts))):
        for argument, item in enumerate(key_function(block)):
            many = isinstance(item, list)
            for place, (k, own) in enumerate(item if many else [item]):
                plan.append((number, argument, place, many, k, int(np.ravel_multi_index(tuple(own), arrays[k].numblocks)) if arrays[k].ndim else 0))
    widest = max((sum(math.prod(block_shape(arrays[k].shape, arrays[k].chunksize, np.unravel_index(n, arrays[k].numblocks) if arrays[k].ndim else ())) * arrays[k].itemsize for _, _, _, _, k, n in rows) for _, rows in itertools.groupby(plan, key=lambda r: r[0])), default=0)
    check_memory(spec or arrays[0].spec, [widest], [math.prod(meta.chunk_sizes(c)) * d.itemsize for c, d in zip(chunkss, dtypes, strict=True)])
    wanted = session().createDataFrame(plan, "number long, argument int, place int, many boolean, k int, n long")
    pieces = _packed(arrays[0], 0)
    for k, x in enumerate(arrays[1:], 1):
        pieces = pieces.unionByName(_packed(x, k))
    facts = [(x.shape, x.chunksize, x.numblocks, x.dtype) for x in arrays]
    ndim = max(len(s) for s in shapes)

    def run(batches):
        for number, rows in _by_key(batches, "number", "argument", "place", "many", "k", "n", "data"):
            parts: list = []
            for argument, _, many, k, n, data in rows:
                shape, sizes, blocks, dtype = facts[k]
                block = np.frombuffer(data, dtype).reshape(block_shape(shape, sizes, np.unravel_index(n, blocks) if blocks else ()))
                if argument == len(parts):
                    parts.append([block] if many else block)
                else:
                    parts[argument].append(block)
            block_id = tuple(int(b) for b in np.unravel_index(number, counts)) if counts else ()
            made = func(*parts, **({"block_id": block_id} if wants_id else {}), **kwargs)
            for o, (part, chunks, dtype) in enumerate(zip(made if len(dtypes) > 1 else (made,), chunkss, dtypes, strict=True)):
                cells = cells_batch(np.asarray(part).astype(dtype), [sum(c[:b]) for c, b in zip(chunks, block_id, strict=True)], dtype)
                n = cells.num_rows
                at = [cells.column(f"d{i}") if f"d{i}" in cells.schema.names else pa.nulls(n, pa.int64()) for i in range(ndim)]
                values = [cells.column("v") if k == o else pa.nulls(n, empty[k]) for k in range(len(dtypes))]
                yield pa.RecordBatch.from_arrays([pa.array([o] * n, pa.int32()), *at, *values], names=["o", *(f"d{i}" for i in range(ndim)), *(f"v{k}" for k in range(len(dtypes)))])

    empty = [cells_batch(np.zeros((0,) * len(c), d), [0] * len(c), d).schema.field("v").type for c, d in zip(chunkss, dtypes, strict=True)]
    schema = ", ".join(["o int", *[f"d{i} long" for i in range(ndim)], *[f"v{k} {meta.spark_type(d).simpleString()}" for k, d in enumerate(dtypes)]])
    table = wanted.join(pieces, ["k", "n"]).repartition("number").sortWithinPartitions("number", "argument", "place").mapInArrow(run, schema)
    if len(dtypes) > 1:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for o, (shape, chunks, dtype) in enumerate(zip(shapes, chunkss, dtypes, strict=True)):
        out.append(from_cells(table.where(F.col("o") == o).select(*[f"d{i}" for i in range(len(shape))], F.col(f"v{o}").alias("v")), tuple(shape), dtype, chunks, spec=spec or arrays[0].spec))
    return tuple(out)


def map_blocks_multiple_outputs(func: Callable, *arrays: Array, shapes, dtypes, chunkss, **kwargs) -> tuple[Array, ...]:
    """One pass over corresponding blocks with several results; func gives a tuple."""
    ndim = max(a.ndim for a in arrays)

    def same(block):
        return [(k, tuple(0 if a.numblocks[i] == 1 else block[i + ndim - a.ndim] for i in range(a.ndim))) for k, a in enumerate(arrays)]

    return general_blockwise(func, same, *arrays, shapes=shapes, dtypes=dtypes, chunkss=chunkss, **kwargs)


def map_selection(func: Callable | None, selection: Callable, x: Array, shape, dtype, chunks) -> Array:
    """Each block of the result is func of the part of ``x`` that selection(block numbers) names by slices with positive steps.

    Blocks of ``x`` go to the blocks of the result that need them, in one shuffle.
    """
    sizes, x_shape, counts = x.chunksize, x.shape, x.numblocks

    def ranges(block):
        named = tuple(selection(block))
        slices = [s.indices(n) for s, n in zip(named + (slice(None),) * (len(x_shape) - len(named)), x_shape, strict=True)]
        if any(step < 1 for _, _, step in slices):
            raise ValueError("selections have positive steps")
        return slices, [range(min(start // s, n - 1), min(max(stop - 1, start) // s, n - 1) + 1) for (start, stop, _), s, n in zip(slices, sizes, counts, strict=True)]

    def needed(block):
        return [[(0, own) for own in itertools.product(*ranges(block)[1])]]

    def pick(parts, block_id):
        slices, spans = ranges(block_id)
        grid = dict(zip(itertools.product(*(range(len(r)) for r in spans)), parts, strict=True))
        whole = _assemble(grid, len(spans))
        part = whole[tuple(slice(start - r[0] * s, max(stop - r[0] * s, 0), step) for (start, stop, step), r, s in zip(slices, spans, sizes, strict=True))]
        return func(part) if func else part

    return general_blockwise(pick, needed, x, shapes=[shape], dtypes=[dtype], chunkss=[chunks])[0]


def _assemble(grid: dict[tuple, np.ndarray], ndim: int) -> np.ndarray:
    """The array whose blocks are at their places in a grid."""
    for axis in reversed(range(ndim)):
        lines: dict[tuple, list] = {}
        for place in sorted(grid):
            lines.setdefault(place[:axis], []).append(grid[place])
        grid = {place: np.concatenate(parts, axis) if len(parts) > 1 else parts[0] for place, parts in lines.items()}
    return grid[()]


def map_overlap(func: Callable, x: Array, *more, dtype=None, chunks=None, depth=None, boundary=None, trim=False, **kwargs) -> Array:
    """func over blocks with ``depth`` elements of their neighbours around; ``boundary`` fills in outside."""
    if more or trim:
        raise NotImplementedError("map_overlap takes one array and doesn't trim")
    depths = _by_axis(depth, x.ndim, 0)
    fills = _by_axis(boundary, x.ndim, None)
    depths = [(d, d) if not isinstance(d, tuple | list) else tuple(d) for d in depths]
    dtype, sizes, shape, ndim = np.dtype(dtype or x.dtype), x.chunksize, x.shape, x.ndim
    if any((lo or hi) and f is None for (lo, hi), f in zip(depths, fills, strict=True)):
        raise ValueError("boundary must be given where there is depth")
    name, table = new_name(), x.base().select(*x.coordinates, x.column.cast(meta.spark_type(x.dtype)).alias(new_name("w")))
    table = table.withColumnRenamed(table.columns[-1], name)
    for i, ((lo, hi), s, count) in enumerate(zip(depths, sizes, x.numblocks, strict=True)):
        c = F.col(f"d{i}")
        first = F.greatest(F.floor((c - hi) / s), F.lit(0)).cast("int")
        last = F.least(F.floor((c + lo) / s), F.lit(count - 1)).cast("int")
        table = table.withColumn(f"b{i}", F.explode(F.sequence(first, last)))
    rows = table.groupBy(*[f"b{i}" for i in range(ndim)]).agg(*[F.collect_list(f"d{i}").alias(f"d{i}") for i in range(ndim)], F.collect_list(name).alias("x0"))
    base = x.chunks if chunks is None else tuple(tuple(c) if isinstance(c, tuple | list) else (int(c),) * k for c, k in zip(chunks, x.numblocks, strict=True))
    offsets = [np.concatenate([[0], np.cumsum(c)]).tolist() for c in base]
    old = x.dtype

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                block = tuple(batch.column(f"b{i}")[r].as_py() for i in range(ndim))
                inner = block_shape(shape, sizes, block)
                start = [b * s - lo for b, s, (lo, _) in zip(block, sizes, depths, strict=True)]
                grown = [n + lo + hi for n, (lo, hi) in zip(inner, depths, strict=True)]
                part = np.zeros(grown, old)
                for axis in range(ndim):  # later axes decide at corners
                    outside = np.arange(grown[axis]) + start[axis]
                    outside = (outside < 0) | (outside >= shape[axis])
                    if outside.any():
                        part[(*[slice(None)] * axis, outside)] = fills[axis]
                at = tuple(batch.column(f"d{i}").slice(r, 1).flatten().to_numpy(zero_copy_only=False) - start[i] for i in range(ndim))
                part[at] = _values(batch.column("x0"), r, old)
                yield cells_batch(np.asarray(func(part, **kwargs)).astype(dtype), [offsets[i][b] for i, b in enumerate(block)], dtype)

    out_shape = tuple(sum(c) for c in base)
    return from_cells(rows.mapInArrow(run, cell_schema(ndim, dtype)), out_shape, dtype, base, spec=x.spec)


def _by_axis(value, ndim: int, default) -> list:
    if isinstance(value, dict):
        return [value.get(i, default) for i in range(ndim)]
    if isinstance(value, tuple | list) and len(value) == ndim:
        return list(value)
    return [default if value is None else value] * ndim


def apply_gufunc(func: Callable, signature: str, *arrays: Array, axes=None, axis=None, keepdims=False, output_dtypes=None, output_sizes=None, vectorize=None, allow_rechunk=False, **kwargs) -> Array:
    """A generalised function: core dimensions of `(i),(j)->(k)` are whole in every block, others are looped over."""
    if axes is not None or axis is not None or keepdims or allow_rechunk:
        raise NotImplementedError("axes, axis, keepdims and allow_rechunk")
    left, right = signature.replace(" ", "").split("->")
    names = [tuple(n for n in part.strip("()").split(",") if n) for part in left.replace("),(", ")|(").split("|")]
    outs = [tuple(n for n in part.strip("()").split(",") if n) for part in right.replace("),(", ")|(").split("|")]
    if len(outs) != 1:
        raise NotImplementedError("several outputs")
    if len(names) != len(arrays):
        raise ValueError(f"{len(names)} arrays expected")
    known = dict(output_sizes or {})
    for a, core in zip(arrays, names, strict=True):
        for i, n in enumerate(core):
            k = a.ndim - len(core) + i
            if a.numblocks[k] > 1:
                raise ValueError(f"core dimension {n} must be one chunk")
            if known.setdefault(n, a.shape[k]) != a.shape[k]:
                raise ValueError(f"core dimension {n} has different sizes")
    missing = [n for n in outs[0] if n not in known]
    if missing:
        raise ValueError(f"output_sizes must give {missing}")
    dtype = np.dtype(output_dtypes[0] if isinstance(output_dtypes, tuple | list) else output_dtypes or arrays[0].dtype)
    call = np.vectorize(func, signature=signature, otypes=[dtype]) if vectorize else func
    loops = [a.ndim - len(core) for a, core in zip(arrays, names, strict=True)]
    depth = max(loops)
    # Loop dimensions line up in front; core ones follow, those that others don't have with size 1.
    width = max(len(core) for core in names)
    from .manipulation import expand_dims

    lined = []
    for a, core, loop in zip(arrays, names, loops, strict=True):
        extra = width - len(core)
        lined.append(expand_dims(a, tuple(loop + i for i in range(extra))) if extra else a)
    cores = [len(core) for core in names]

    def block(*parts):
        own = [p.reshape(p.shape[: p.ndim - width] + p.shape[p.ndim - c :] if c else p.shape[: p.ndim - width]) for p, c in zip(parts, cores, strict=True)]
        return call(*own, **kwargs)

    loop_chunks = [meta.smallest_chunks(*[a.chunks[i - depth + loop] for a, loop in zip(arrays, loops, strict=True) if i - depth + loop >= 0 and a.shape[i - depth + loop] != 1] or [(1,)]) for i in range(depth)]
    chunks = (*loop_chunks, *((known[n],) for n in outs[0]))
    return map_blocks(block, *lined, dtype=dtype, chunks=chunks, drop_axis=list(range(depth, depth + width)) if width else None, new_axis=list(range(depth, depth + len(outs[0]))))


def reduce_blocks(x: Array, axis, func, combine, dtype, keepdims=False, aggregate=None, split_every: int = 4) -> Array:
    """A reduction by NumPy functions with axis and keepdims: func of each block, combine of ``split_every`` results
    along each axis at a time until one is left, and aggregate of that.

    What func and combine give is an array, or a dict of arrays if a result has several parts (as the count
    and total of a mean). It stays a block between the rounds.
    """
    axes, dtype, ndim = meta.normalize_axis(axis, x.ndim), np.dtype(dtype), x.ndim
    if split_every < 2:
        raise ValueError("split_every must be 2 at least")
    check_memory(x.spec, [x.chunkmem], [x.chunkmem // max(1, math.prod(x.chunksize[a] for a in axes))])
    shape, sizes, old = x.shape, x.chunksize, x.dtype
    ids = [f"b{i}" for i in range(ndim)]
    schema = ", ".join([*(f"{c} int" for c in ids), "part binary"])

    def row(block, part):
        return pa.RecordBatch.from_arrays([*(pa.array([b], pa.int32()) for b in block), pa.array([pickle.dumps(part)], pa.binary())], names=[*ids, "part"])

    def first(batches):
        for batch in batches:
            numbers = [batch.column(c).to_pylist() for c in ids]
            for r in range(batch.num_rows):
                block = tuple(n[r] for n in numbers)
                yield row(block, func(_values(batch.column("x"), r, old).reshape(block_shape(shape, sizes, block)), axis=axes, keepdims=True))

    def merge(batches):
        for _, rows in _by_key(batches, "_key", *(f"_{c}" for c in ids), *ids, "part"):
            grid = {tuple(r[ndim + a] for a in axes): pickle.loads(r[-1]) for r in rows}
            places = [sorted({p[k] for p in grid}) for k in range(len(axes))]
            grid = {tuple(places[k].index(v) for k, v in enumerate(p)): part for p, part in grid.items()}
            yield row(rows[0][:ndim], combine(_joined(grid, axes), axis=axes, keepdims=True))

    parts, counts = to_blocks(x, "x").mapInArrow(first, schema), list(x.numblocks)
    while any(counts[a] > 1 for a in axes):
        up = [(F.floor(F.col(c) / split_every).cast("int") if i in axes else F.col(c)).alias(f"_{c}") for i, c in enumerate(ids)]
        keyed = parts.select(*ids, "part", *up).withColumn("_key", F.concat_ws(",", *(f"_{c}" for c in ids)))
        parts = keyed.repartition("_key").sortWithinPartitions("_key", *ids).mapInArrow(merge, schema)
        counts = [-(-n // split_every) if i in axes else n for i, n in enumerate(counts)]
    kept = [i for i in range(ndim) if i not in axes]
    where = ndim if keepdims else len(kept)

    def last(batches):
        for batch in batches:
            for *block, data in zip(*(batch.column(c).to_pylist() for c in ids), batch.column("part").to_pylist(), strict=True):
                part = pickle.loads(data)
                out = np.asarray(aggregate(part) if aggregate else part).astype(dtype)
                offset = [0 if i in axes else block[i] * sizes[i] for i in range(ndim)]
                yield cells_batch(out if keepdims else out.reshape([out.shape[i] for i in kept]), offset if keepdims else [offset[i] for i in kept], dtype)

    out_shape = tuple(1 if i in axes else n for i, n in enumerate(shape)) if keepdims else tuple(shape[i] for i in kept)
    chunks = tuple((1,) if i in axes else c for i, c in enumerate(x.chunks)) if keepdims else tuple(x.chunks[i] for i in kept)
    return from_cells(parts.mapInArrow(last, cell_schema(where, dtype)), out_shape, dtype, chunks, spec=x.spec)


def _joined(grid: dict[tuple, np.ndarray | dict], axes: tuple[int, ...]):
    """Partial results, each with all axes, at their places along ``axes`` (in that order) as one."""
    some = next(iter(grid.values()))
    if isinstance(some, dict):
        return {name: _joined({p: part[name] for p, part in grid.items()}, axes) for name in some}
    for k in reversed(range(len(axes))):
        lines: dict[tuple, list] = {}
        for place in sorted(grid):
            lines.setdefault(place[:k], []).append(grid[place])
        grid = {place: np.concatenate(parts, axes[k]) for place, parts in lines.items()}
    return grid[()]


reduction = reduce_blocks


def blockwise(func: Callable, out_ind, *args, dtype=None, new_axes=None, adjust_chunks=None, **kwargs) -> Array:
    """Blocks in index notation: args are pairs of an array and its indices. Indices that the result lacks must be one chunk."""
    pairs = [(args[i], tuple(args[i + 1])) for i in range(0, len(args), 2)]
    out_ind, new_axes = tuple(out_ind), dict(new_axes or {})
    order = [i for i in out_ind if i not in new_axes]
    lost = sorted({i for _, ind in pairs for i in ind} - set(out_ind))
    every = [*order, *lost]
    from .manipulation import expand_dims, permute_dims

    lined, restore = [], []
    for a, ind in pairs:
        for i in lost:
            if i in ind and a.numblocks[ind.index(i)] > 1:
                raise ValueError(f"index {i} isn't in the result and has several chunks")
        have = [i for i in every if i in ind]
        a = permute_dims(a, tuple(ind.index(i) for i in have)) if a.ndim else a
        gaps = tuple(k for k, i in enumerate(every) if i not in ind)
        lined.append(expand_dims(a, gaps) if gaps else a)
        restore.append((gaps, tuple(have.index(i) for i in ind)))

    def block(*parts):
        own = [np.transpose(np.squeeze(p, gaps), perm) for p, (gaps, perm) in zip(parts, restore, strict=True)]
        return func(*own, **kwargs)

    sizes = {}
    for a, ind in pairs:
        for i, c in zip(ind, a.chunks, strict=True):
            if i not in sizes or sum(c) > 1:
                sizes[i] = c
    for i, n in new_axes.items():
        sizes[i] = tuple(n) if isinstance(n, tuple | list) else (n,)
    for i, c in (adjust_chunks or {}).items():
        sizes[i] = tuple(c(n) for n in sizes[i]) if callable(c) else tuple(c) if isinstance(c, tuple | list) else (c,) * len(sizes[i])
    return map_blocks(block, *lined, dtype=dtype, chunks=tuple(sizes[i] for i in out_ind), drop_axis=list(range(len(order), len(every))) or None, new_axis=[k for k, i in enumerate(out_ind) if i in new_axes])
