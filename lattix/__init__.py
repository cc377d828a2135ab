"""Lattix: n-dimensional arrays on Spark DataFrames, in the manner of the Python array API standard."""

import numpy as _np

from .array import Array, from_cells
from .meta import Spec, broadcast_shapes, can_cast, finfo, iinfo, isdtype, result_type
from .operators import elementwise as _elementwise
from .operators.blocks import apply_gufunc, blockwise, general_blockwise, map_blocks, map_blocks_multiple_outputs, map_overlap, map_selection, reduce_blocks
from .operators.blocks import reduction
from .operators.creation import arange, asarray, empty, empty_like, empty_virtual_array, eye, from_array, from_table, full, full_like, linspace, meshgrid, ones, ones_like, tril, triu, zeros, zeros_like
from .operators.elementwise import astype, clip, elemwise, where
from .operators.groupby import Aggregation, groupby_blockwise, groupby_reduction
from .operators.indexing import take
from .operators.linalg import matmul, matrix_transpose, tensordot, vecdot
from .operators.manipulation import (
    broadcast_arrays, broadcast_to, concat, expand_dims, flatten, flip, merge_chunks, moveaxis, pad, permute_dims, repeat, reshape, reshape_chunks, roll, squeeze, stack, tile, unify_chunks, unstack,
)
from .operators.reductions import (
    all, any, argmax, argmin, count_nonzero, max, mean, min, nanargmax, nanargmin, nanmax, nanmean, nanmedian, nanmin, nanprod, nanstd, nansum, nanvar, prod, std, sum, var,
)
from .operators.scans import cumulative_prod, cumulative_sum, diff, nancumprod, nancumsum, scan
from .operators.searching import isin, searchsorted
from .plans.rechunk import explain_rechunk, rechunk_plan
from .plans.runtime import Callback, HistoryCallback, MemoryWarningCallback, ProgressCallback, TaskEvent, TimelineCallback, analyze, compute, measure_reserved_mem, raise_if_computes, visualize
from .sources.parquet import from_parquet, resume, store, store_transaction, to_parquet
from .sources.zarr import from_zarr, to_zarr

__array_api_version__ = "2025.12"
globals().update({name: getattr(_elementwise, name) for name in _elementwise.NAMES})
bool, int8, int16, int32, int64 = (_np.dtype(n) for n in ("bool", "int8", "int16", "int32", "int64"))
uint8, uint16, uint32, uint64 = (_np.dtype(n) for n in ("uint8", "uint16", "uint32", "uint64"))
float32, float64, complex64, complex128 = (_np.dtype(n) for n in ("float32", "float64", "complex64", "complex128"))
e, inf, nan, newaxis, pi = _np.e, _np.inf, _np.nan, None, _np.pi


def rechunk(x, chunks):
    """The same array with other chunks: no data moves until blocks are needed."""
    return x.with_chunks(chunks)


def __array_namespace_info__():
    from .plans.info import NamespaceInfo

    return NamespaceInfo()


from .operators import linalg, random  # noqa: E402

