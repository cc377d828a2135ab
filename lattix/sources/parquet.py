"""Chunked storage as Parquet: a folder for each block, coordinates and values in its files.

Layout: ``<path>/cells/b0=…/b1=…/*.parquet`` and ``<path>/meta``, one JSON line with shape, dtype and chunks. Reading
a part of an array touches only its blocks: selection becomes filters on coordinates and on the
block numbers that they imply. Writing a region overwrites just the region's blocks.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, from_cells, new_name, session


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by files in the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


def scratch_folder(spark) -> str:
    """The folder of spark.checkpoint.dir; a local one where that is unset and the master is local."""
    setting = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not setting and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return setting or f"file://{tempfile.mkdtemp(prefix='lattix-')}"


def _write_meta(path: str, x: Array) -> None:
    facts = {"shape": x.shape, "dtype": x.dtype.name, "chunks": x.chunksize}
    session().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(path: str) -> dict:
    return json.loads(session().read.text(f"{path}/meta").first()["value"])


def _blocked(x: Array, offset=None, chunks=None) -> DataFrame:
    offset = offset or [0] * x.ndim
    sizes = chunks or x.chunksize
    at = [(c + o).alias(f"d{i}") for i, (c, o) in enumerate(zip(x.coordinates, offset, strict=True))]
    table = x.base().select(*at, x.column.cast(meta.spark_type(x.dtype)).alias("v"))
    ids = [F.floor(F.col(f"d{i}") / s).cast("int").alias(f"b{i}") for i, s in enumerate(sizes)]
    table = table.select("*", *ids)
    # One task for a block: a file each, and no task holds the files of many blocks open.
    return table.repartition(*[f"b{i}" for i in range(x.ndim)]).sortWithinPartitions(*[f"b{i}" for i in range(x.ndim)], *[f"d{i}" for i in range(x.ndim)]) if x.ndim else table


def to_parquet(x: Array, path: str, region: tuple[slice, ...] | None = None) -> None:
    """Write an array, or with ``region`` the part of a stored array that starts and ends at its blocks."""
    if region is None:
        writer = _blocked(x).write.mode("overwrite")
        (writer.partitionBy(*[f"b{i}" for i in range(x.ndim)]) if x.ndim else writer).parquet(f"{path}/cells")
        _write_meta(path, x)
        return
    facts = read_meta(path)
    offset = check_region(region, facts["shape"], facts["chunks"], x.shape)
    if x.dtype.name != facts["dtype"]:
        raise ValueError(f"dtype {x.dtype} isn't the stored {facts['dtype']}")
    _blocked(x, offset, facts["chunks"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[f"b{i}" for i in range(x.ndim)]).parquet(f"{path}/cells")


def check_region(region, shape, chunks, size) -> list[int]:
    """Where a region starts; it must begin and end at block boundaries and fit the array."""
    if len(region) != len(shape):
        raise ValueError("a region needs a slice for each axis")
    offset = []
    for s, n, c, m in zip(region, shape, chunks, size, strict=True):
        start, stop, step = s.indices(n)
        if step != 1 or start % c or stop % c and stop != n:
            raise ValueError(f"region {s} doesn't follow blocks of {c}")
        if stop - start != m:
            raise ValueError(f"region {s} has {stop - start} places for {m}")
        offset.append(start)
    return offset


def create(path: str, shape, dtype, chunks) -> None:
    """An empty stored array, to be written by regions; what isn't written can't be read."""
    from ..operators.creation import zeros

    x = zeros(shape, dtype=dtype, chunks=chunks)
    _write_meta(path, x)


def from_parquet(path: str, chunks=None, spec=None) -> Array:
    facts = read_meta(path)
    own = meta.normalize_chunks(tuple(facts["chunks"]), tuple(facts["shape"]), facts["dtype"])
    if chunks is not None:
        new = meta.normalize_chunks(chunks, tuple(facts["shape"]), facts["dtype"])
        if any(a % b for a, b, n in zip(meta.chunk_sizes(new), meta.chunk_sizes(own), facts["shape"], strict=True) if a < n):
            raise ValueError("chunks must be multiples of the stored ones")
        own = new
    table = session().read.parquet(f"{path}/cells")
    # Block numbers bound coordinates: a selection of the array also filters them, which prunes folders.
    table.lattix_blocks = {i: (f"b{i}", c) for i, c in enumerate(facts["chunks"])}
    return from_cells(table, tuple(facts["shape"]), facts["dtype"], own, spec=spec)


def read_region(path: str, region: tuple[slice, ...], spec=None) -> Array:
    """A part of a stored array; only its blocks are listed and read."""
    facts = read_meta(path)
    table, shape = session().read.parquet(f"{path}/cells"), []
    name = new_name()
    for i, (s, n, c) in enumerate(zip(region, facts["shape"], facts["chunks"], strict=True)):
        start, stop, step = s.indices(n)
        if step != 1:
            raise ValueError("a region has no steps")
        table = table.where((F.col(f"b{i}") >= start // c) & (F.col(f"b{i}") <= max(stop - 1, start) // c) & (F.col(f"d{i}") >= start) & (F.col(f"d{i}") < stop))
        shape.append(max(0, stop - start))
    starts = [s.indices(n)[0] for s, n in zip(region, facts["shape"], strict=True)]
    table = table.select(*[(F.col(f"d{i}") - o).alias(f"d{i}") for i, o in enumerate(starts)], F.col("v").alias(name))
    return from_cells(table, tuple(shape), facts["dtype"], meta.normalize_chunks(tuple(facts["chunks"]), tuple(shape), facts["dtype"]), name, spec)


def store(sources, targets, regions=None, compute: bool = True):
    """Write arrays to paths (Parquet, or Zarr for paths that end in .zarr). With compute=False, returns what does it."""
    sources = [sources] if isinstance(sources, Array) else list(sources)
    targets = [targets] if isinstance(targets, str) else list(targets)
    if any(not isinstance(s, Array) for s in sources):
        raise ValueError("sources must be arrays")
    if len(sources) != len(targets):
        raise ValueError(f"{len(sources)} sources for {len(targets)} targets")
    regions = [regions] * len(sources) if regions is None or isinstance(regions, tuple) else list(regions)
    if len(regions) != len(sources):
        raise ValueError(f"{len(regions)} regions for {len(sources)} sources")

    def write() -> None:
        from .zarr import to_zarr

        for x, path, region in zip(sources, targets, regions, strict=True):
            (to_zarr if path.rstrip("/").endswith(".zarr") else to_parquet)(x, path, region=region)

    return write() if compute else write


def store_transaction(sources, targets) -> None:
    """Write all arrays or none: into staging folders first, which take their places when all are complete.

    What stood there is moved aside, and moved back if any move fails. Only if the driver itself dies
    between two moves, replaced targets stay replaced; the folders moved aside (``.replaced-…``) are then left.
    """
    spark = session()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = uuid.uuid4().hex
    path = jvm.org.apache.hadoop.fs.Path
    files = lambda p: path(p).getFileSystem(conf)

    def move(a: str, b: str) -> None:
        if not files(a).rename(path(a), path(b)):
            raise OSError(f"can't move {a} to {b}")

    def drop(p: str) -> None:
        if files(p).exists(path(p)):
            files(p).delete(path(p), True)

    targets = [t.rstrip("/") for t in targets]
    kind = lambda t: ".zarr" if t.endswith(".zarr") else ""  # noqa: E731  the ending decides the format
    staged = [f"{t}.staging-{mark}{kind(t)}" for t in targets]
    undo: list[tuple[str, str]] = []
    try:
        store(sources, staged)
        for s, t in zip(staged, targets, strict=True):
            if files(t).exists(path(t)):
                move(t, f"{t}.replaced-{mark}")
                undo.append((f"{t}.replaced-{mark}", t))
            move(s, t)
            undo.append((t, ""))
    except BaseException:
        for a, b in reversed(undo):
            move(a, b) if b else drop(a)
        raise
    finally:
        for s in staged:
            drop(s)
    for a, b in undo:
        if b:
            drop(a)


def is_complete(x: Array, path: str) -> bool:
    """Is an array of the shape, dtype and chunks of ``x`` stored there, with every element?"""
    spark = session()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("meta", "cells"):
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            return False
    facts = read_meta(path)
    if (tuple(facts["shape"]), facts["dtype"], tuple(facts["chunks"])) != (x.shape, x.dtype.name, x.chunksize):
        return False
    return spark.read.parquet(f"{path}/cells").count() == x.size  # from the files' footers


def resume(x: Array, path: str) -> Array:
    """The stored array, if it was written whole before, as ``x`` is; else it is written now."""
    if not is_complete(x, path):
        to_parquet(x, path)
    return from_parquet(path, spec=x.spec)
