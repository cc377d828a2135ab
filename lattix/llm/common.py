"""What the operators of this subpackage share: stored tables, byte-level tokens, hashing."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker tokenises at a time; a longer text is one slice by itself.
SLICE_BYTES = 1 << 18

_FOLDERS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application under ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session; where it is unset, a local folder is taken if the master is local.
    The folder is removed when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='lattix-')}"
        _FOLDERS[app] = f"{base.rstrip('/')}/lattix-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        drop_stored(spark, folder)
    except Exception:  # noqa: BLE001  the JVM may be gone, and the folder is only scratch space
        pass


def drop_stored(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def store(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: it cuts lineage and survives lost executors.

    ``rows_per_file`` (0: any number) bounds what a reader of long rows holds at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    if _OPEN:
        _OPEN[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch():
    """What is stored inside goes at the end: for functions whose result is no DataFrame."""
    at = len(_OPEN)
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in [x for held in _OPEN[at:] for x in held]:
            drop_stored(spark, path)
        del _OPEN[at:]


def tidy(make):
    """A function whose stored tables go when it ends; its result, a DataFrame, is stored and stays."""

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        before = len(_OPEN)
        _OPEN.append([])
        try:
            made = make(*args, **kwargs)
            spare = _OPEN.pop()
            try:
                return store(made)
            finally:
                for spark, path in spare:
                    drop_stored(spark, path)
        finally:
            del _OPEN[before:]

    return run


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod == rest


# ---------------------------------------------------------------- hashing

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


#: The lowest n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: eight bytes at a time, each step a bijection of what was hashed before.

    Ranges of at most eight bytes of one length never collide, and no pattern within longer ones makes them collide.
    """
    eights, lengths = _eights(data), (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        code = mix(lengths.astype(np.uint64) * _M2 ^ (eights[starts] & _MASKS[np.minimum(lengths, 8)]))
        live, done = np.flatnonzero(lengths > 8), 8
        while len(live):
            left = lengths[live] - done
            code[live] = mix(code[live] * _M3 ^ (eights[starts[live] + done] & _MASKS[np.minimum(left, 8)]))
            live, done = live[left > 8], done + 8
    return code


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def hash_grams(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n bytes, eight at most, from each of ``starts`` on."""
    with np.errstate(over="ignore"):
        return mix(_eights(data)[starts] & _MASKS[n] ^ np.uint64(n) * _M2)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Words gives for these byte strings."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return hash_ranges(data, ends - np.array([len(w) for w in words], np.int64), ends) if words else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- tokens

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(97, 123)]] = False


class Texts:
    """Consecutive texts as one byte array; text i is data[bounds[i]:bounds[i + 1]], null as empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, their texts) so that each slice has about ``limit`` bytes or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, Texts(all_bytes[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


class Words:
    """The words of Texts, in order: byte ranges, hashes, and the text that each belongs to."""

    def __init__(self, texts: Texts, separators: np.ndarray, lower: bool = True):
        data = LOWER[texts.data] if lower else texts.data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(separators[data], out=inside[1:-1])
        new_text = np.zeros(n + 1, bool)
        new_text[texts.bounds] = True
        self.data = data
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | new_text))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | new_text))
        #: Words of text i are first[i] .. first[i + 1] - 1.
        self.first = np.searchsorted(self.starts, texts.bounds)
        self.hashes = hash_ranges(data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] in double precision."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
