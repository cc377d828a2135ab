"""Zarr arrays (format 2 and 3): chunks are read and written by tasks, one file each.

Metadata is JSON, read and written by the driver. Files go through pyarrow's file systems, so a path
may be local (shared by all executors) or a URI that pyarrow opens. Codecs: none, zlib, gzip and zstd.
Chunks that aren't there hold the fill value. C order only; no filters.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from .. import meta
from ..array import Array
from ..operators.blocks import block_source, block_shape, _values, to_blocks
from .parquet import check_region


def _open(path: str):
    """(file system, path in it)"""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _get(path: str) -> bytes | None:
    files, at = _open(path)
    if files.get_file_info(at).type != pafs.FileType.File:
        return None
    with files.open_input_stream(at) as f:
        return f.read()


def _put(path: str, data: bytes) -> None:
    files, at = _open(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at) as f:
        f.write(data)


class Layout:
    """Shape, dtype, chunks, codec and file names of a stored array."""

    def __init__(self, path: str, info: dict, version: int):
        self.path, self.info, self.version = path.rstrip("/"), info, version
        self.shape = tuple(info["shape"])
        if version == 2:
            self.chunks, self.dtype = tuple(info["chunks"]), np.dtype(info["dtype"])
            self.separator = info.get("dimension_separator", ".")
            if info.get("order", "C") != "C" or info.get("filters"):
                raise NotImplementedError("only C order without filters")
            codec = info.get("compressor")
            self.codec = codec["id"] if codec else None
            self.level = (codec or {}).get("level", 1)
        else:
            self.chunks = tuple(info["chunk_grid"]["configuration"]["chunk_shape"])
            self.dtype, self.codec, self.level = np.dtype(info["data_type"]), None, 1
            self.separator = info.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
            for c in info["codecs"]:
                how = c.get("configuration", {})
                if c["name"] == "bytes":
                    self.dtype = self.dtype.newbyteorder({"big": ">", "little": "<"}[how.get("endian", "little")])
                elif c["name"] in ("gzip", "zstd"):
                    self.codec, self.level = c["name"], how.get("level", 1)
                else:
                    raise NotImplementedError(f"codec {c['name']}")
        if self.codec not in (None, "zlib", "gzip", "zstd"):
            raise NotImplementedError(f"codec {self.codec}")
        fill = info.get("fill_value")
        self.fill = 0 if fill is None else float(fill) if isinstance(fill, str) else complex(*fill) if isinstance(fill, list) else fill

    def file(self, block) -> str:
        names = [str(b) for b in block]
        if self.version == 2:
            return f"{self.path}/{self.separator.join(names) or '0'}"
        return f"{self.path}/" + self.separator.join(["c", *names])

    def read(self, block) -> np.ndarray:
        """A whole chunk; parts beyond the array are padding."""
        data = _get(self.file(block))
        if data is None:
            return np.full(self.chunks, self.fill, self.dtype)
        if self.codec == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif self.codec:
            data = gzip.decompress(data) if self.codec == "gzip" else zlib.decompress(data)
        return np.frombuffer(data, self.dtype).reshape(self.chunks)

    def write(self, block, values: np.ndarray) -> None:
        whole = np.full(self.chunks, self.fill, self.dtype)
        whole[tuple(slice(0, n) for n in values.shape)] = values
        data = whole.tobytes()
        if self.codec == "zstd":
            import zstandard

            data = zstandard.ZstdCompressor(self.level).compress(data)
        elif self.codec:
            data = gzip.compress(data, self.level) if self.codec == "gzip" else zlib.compress(data, self.level)
        _put(self.file(block), data)


def open_zarr(path: str, sub: str | None = None) -> Layout:
    path = f"{path.rstrip('/')}/{sub}" if sub else path.rstrip("/")
    if (found := _get(f"{path}/zarr.json")) is not None:
        return Layout(path, json.loads(found), 3)
    if (found := _get(f"{path}/.zarray")) is not None:
        return Layout(path, json.loads(found), 2)
    raise FileNotFoundError(f"no Zarr array at {path}")


def create_zarr(path: str, shape, dtype, chunks, *, version: int = 3, codec: str | None = "zstd", sub: str | None = None) -> Layout:
    """Metadata of a new array; its chunks come with writes."""
    path = f"{path.rstrip('/')}/{sub}" if sub else path.rstrip("/")
    dtype = np.dtype(dtype)
    fill = False if dtype.kind == "b" else [0.0, 0.0] if dtype.kind == "c" else 0.0 if dtype.kind == "f" else 0
    if version == 2:
        info = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype.str, "order": "C", "fill_value": fill, "filters": None, "compressor": {"id": codec, "level": 1} if codec else None, "dimension_separator": "."}
        _put(f"{path}/.zarray", json.dumps(info).encode())
    else:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {"level": 1, **({"checksum": False} if codec == "zstd" else {})}}] if codec else [])
        info = {
            "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs, "attributes": {},
        }
        _put(f"{path}/zarr.json", json.dumps(info).encode())
    return open_zarr(path)


def from_zarr(store: str, path: str | None = None, chunks=None, spec=None) -> Array:
    """A lazy Zarr array; ``chunks`` must be multiples of the stored ones."""
    z = open_zarr(store, path)
    own = meta.normalize_chunks(tuple(min(c, n) if n else 1 for c, n in zip(z.chunks, z.shape, strict=True)), z.shape, z.dtype)
    if chunks is not None:
        own = meta.normalize_chunks(chunks, z.shape, z.dtype)
        if any(a % b for a, b, n in zip(meta.chunk_sizes(own), z.chunks, z.shape, strict=True) if a < n):
            raise ValueError("chunks must be multiples of the stored ones")

    def make(block, slices):
        out = np.empty([s.stop - s.start for s in slices], z.dtype)
        ranges = [range(s.start // c, -(-s.stop // c)) for s, c in zip(slices, z.chunks, strict=True)]
        for stored in itertools.product(*ranges):
            values = z.read(stored)
            inner = block_shape(z.shape, z.chunks, stored)
            at = tuple(slice(b * c - s.start, b * c - s.start + n) for b, c, s, n in zip(stored, z.chunks, slices, inner, strict=True))
            out[at] = values[tuple(slice(0, n) for n in inner)]
        return out

    return block_source(make, z.shape, z.dtype.newbyteorder("="), own, spec)


def to_zarr(x: Array, store: str, path: str | None = None, region: tuple[slice, ...] | None = None, *, version: int = 3, codec: str | None = "zstd") -> None:
    """Write an array as Zarr, or a region of an array that exists; a task writes whole chunks only."""
    if region is None:
        z, offset = create_zarr(store, x.shape, x.dtype, x.chunksize, version=version, codec=codec, sub=path), [0] * x.ndim
    else:
        z = open_zarr(store, path)
        offset = check_region(region, z.shape, z.chunks, x.shape)
        x = x.with_chunks(tuple(min(c, n) for c, n in zip(z.chunks, x.shape, strict=True)))
    shape, sizes, dtype = x.shape, x.chunksize, x.dtype
    first = [o // c for o, c in zip(offset, z.chunks, strict=True)]

    def run(batches):
        done = 0
        for batch in batches:
            for r in range(batch.num_rows):
                block = tuple(batch.column(f"b{i}")[r].as_py() for i in range(len(shape)))
                values = _values(batch.column("x"), r, dtype).reshape(block_shape(shape, sizes, block))
                z.write(tuple(b + f for b, f in zip(block, first, strict=True)), values)
                done += 1
        yield pa.RecordBatch.from_pydict({"n": [done]}, pa.schema([("n", pa.int64())]))

    rows = to_blocks(x, "x") if math.prod(shape) else None
    if rows is not None:
        rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
