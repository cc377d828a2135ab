"""Driver-side facts about arrays: dtypes, Spark types, chunks, the specification of a computation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from numbers import Integral

import numpy as np
from pyspark.sql import types as T

DTYPES = {n: np.dtype(n) for n in ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "complex64", "complex128")}

_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(),
    "complex64": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
}

#: Kinds of dtype that functions accept.
CATEGORIES = {"any": "biufc", "numeric": "iufc", "real numeric": "iuf", "integer": "iu", "integer or boolean": "biu", "boolean": "b", "floating-point": "fc", "real floating-point": "f", "complex floating-point": "c"}


def spark_type(dtype) -> T.DataType:
    return _SPARK[np.dtype(dtype).name]


def check_kind(name: str, category: str, *dtypes) -> None:
    for d in dtypes:
        if np.dtype(d).kind not in CATEGORIES[category]:
            raise TypeError(f"{name} takes {category} arrays, not {d}")


def can_cast(from_, to, /) -> bool:
    return np.can_cast(getattr(from_, "dtype", from_), to)


def result_type(*things) -> np.dtype:
    return np.result_type(*(getattr(t, "dtype", t) for t in things))


def isdtype(dtype, kind) -> bool:
    return np.isdtype(np.dtype(dtype), kind)


finfo, iinfo = np.finfo, np.iinfo
broadcast_shapes = np.broadcast_shapes


@dataclass(frozen=True)
class Spec:
    """Where intermediate data may lie and how much memory a block function may take."""

    work_dir: str | None = None
    allowed_mem: int = 2_000_000_000
    reserved_mem: int = 100_000_000
    storage_options: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        for name in ("allowed_mem", "reserved_mem"):
            object.__setattr__(self, name, parse_bytes(getattr(self, name)))
        if self.reserved_mem > self.allowed_mem:
            raise ValueError("reserved_mem exceeds allowed_mem")


def parse_bytes(size: int | str) -> int:
    """'2GB', '500 MiB' or a number of bytes."""
    if isinstance(size, int | float):
        return int(size)
    m = re.fullmatch(r"\s*([\d.]+)\s*([kKMGTP]?)(i?)B?\s*", size)
    if not m:
        raise ValueError(f"not a size: {size!r}")
    power = "kMGTP".find(m[2].replace("K", "k")) + 1 if m[2] else 0
    return int(float(m[1]) * (1024 if m[3] else 1000) ** power)


# ---------------------------------------------------------------- chunks

AUTO_BYTES = 100_000_000


def normalize_chunks(chunks, shape: tuple[int, ...], dtype) -> tuple[tuple[int, ...], ...]:
    """Sizes of all chunks of every axis, from an int, a tuple, a dict, 'auto', -1 or None (whole axis)."""
    if chunks == "auto":
        chunks = ("auto",) * len(shape)
    if isinstance(chunks, dict):
        chunks = tuple(chunks.get(i, -1) for i in range(len(shape)))
    if isinstance(chunks, Integral) or chunks is None:
        chunks = (chunks,) * len(shape)
    if len(chunks) != len(shape):
        raise ValueError(f"chunks {chunks} don't fit shape {shape}")
    sizes = [n if c is None or isinstance(c, Integral) and c == -1 else c for c, n in zip(chunks, shape, strict=True)]
    free = [i for i, c in enumerate(sizes) if isinstance(c, str)]
    if free:
        rest = math.prod(max(1, c[0] if isinstance(c, tuple | list) else c) for c in sizes if not isinstance(c, str))
        room = max(1, AUTO_BYTES // (np.dtype(dtype).itemsize * rest))
        for k, i in enumerate(sorted(free, key=lambda i: shape[i])):
            sizes[i] = max(1, min(shape[i], int(room ** (1 / (len(free) - k)))))
            room = max(1, room // sizes[i])
    out = []
    for c, n in zip(sizes, shape, strict=True):
        if isinstance(c, tuple | list):
            if sum(c) != n:
                raise ValueError(f"chunks {c} don't add up to {n}")
            if len(set(c[:-1])) > 1 or c and c[-1] > c[0]:
                raise ValueError(f"chunks {c} aren't regular")
            out.append(tuple(int(x) for x in c))
            continue
        if c < 1 and n > 0:
            raise ValueError(f"chunk size {c}")
        c = max(1, min(int(c), n)) if n else 1
        out.append((c,) * (n // c) + ((n % c,) if n % c else ()) or (0,))
    return tuple(out)


def chunk_sizes(chunks: tuple[tuple[int, ...], ...]) -> tuple[int, ...]:
    """The regular chunk size of every axis."""
    return tuple(max(1, c[0]) for c in chunks)


def smallest_chunks(*many: tuple[int, ...]) -> tuple[int, ...]:
    """Of several chunkings of one axis that with the smallest first chunk."""
    if len({sum(c) for c in many}) > 1:
        raise ValueError(f"chunks of different totals: {many}")
    return min(many, key=lambda c: c[0])


def split_chunks(shape, source, target) -> tuple[tuple[int, ...], ...]:
    """Sizes between all boundaries of two chunkings."""
    out = []
    for n, s, t in zip(shape, source, target, strict=True):
        cuts = sorted({*range(0, n, s), *range(0, n, t), n})
        out.append(tuple(b - a for a, b in zip(cuts, cuts[1:], strict=False)))
    return tuple(out)


def normalize_axis(axis, ndim: int) -> tuple[int, ...]:
    if axis is None:
        return tuple(range(ndim))
    axes = (axis,) if isinstance(axis, Integral) else tuple(axis)
    out = []
    for a in axes:
        if not -ndim <= a < ndim:
            raise ValueError(f"axis {a} is out of bounds for {ndim} dimensions")
        out.append(int(a) % ndim)
    if len(set(out)) < len(out):
        raise ValueError("repeated axis")
    return tuple(out)
