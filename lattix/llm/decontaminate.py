"""Benchmark decontamination by a distributed positional inverted index.

The index is stored in the shared folder in segments, each over about ``SEGMENT_BYTES`` of text (or one
longer text): the sorted terms of its documents, and for each term the list of positions at which it
stands. A document lies in one segment, so no posting is shuffled, and segments are alike in size
whatever the documents hold. The benchmark comes in blocks of at most ``BLOCK_WORDS`` words (or one
longer item); for each block every segment answers all its windows from the lists alone: the list of a
window's rarest term gives the candidates, and the lists of the other terms, each shifted by the term's
offset in the window, are intersected with them in the order of their rarity. A task holds one
segment and one block at a time, at any size of both tables. What blocks find in a document is united after.

A phrase match has every term of the window at its place. With ``slop`` s a proximity match at a word has
every term within s words of its place there, in the same document.

Null and empty texts have no words and no hits. Repeated items and repeated windows are answered
once and count for each item. An item without words, id or text is ignored. Rows that repeat, or have no doc_id,
are documents of their own. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, read, store, text_slices, tidy

WINDOW = 10
#: Bytes of text in a segment of the index, about as many bytes of lists; a longer text is a segment by itself.
SEGMENT_BYTES = 1 << 17
#: Segments in a file at most: readers and writers of Parquet hold many rows at a time.
SEGMENTS_PER_FILE = 256
#: Words of benchmark items in one block: at most about 8 MB in each task.
BLOCK_WORDS = 200_000
#: Rows of contaminated documents that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class Windows:
    """The distinct windows of some benchmark items, by the terms they consist of."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int):
        seen: dict[bytes, int] = {}
        rows, owners = [], []
        for item, words in items:
            for i in range(max(1, len(words) - size + 1)) if len(words) else ():
                row = words[i : i + size]
                k = seen.setdefault(row.tobytes(), len(seen))
                if k == len(rows):
                    rows.append(row)
                owners.append((k, item))
        self.terms = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        #: Term numbers, -1 behind the end of a window of fewer words.
        self.rows = np.full((len(rows), size), -1, np.int32)
        for k, r in enumerate(rows):
            self.rows[k, : len(r)] = np.searchsorted(self.terms, r)
        owners = sorted(set(owners))
        self.items = np.array([i for _, i in owners], np.int64)
        #: Items of window k are items[first[k]:first[k + 1]].
        self.first = np.searchsorted(np.array([k for k, _ in owners], np.int64), np.arange(len(rows) + 1))


INDEX = "segment long, doc_ids array<long>, text_keys array<long>, first binary, terms binary, begin binary, positions binary"


def build_index(documents: DataFrame) -> DataFrame:
    """The stored index: a row for each segment.

    doc_ids and text_keys of its documents, first (their first words, and the number of all words), terms
    (sorted hashes), begin (where the list of each term starts), positions (all lists, one after the other).
    """

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), SEGMENT_BYTES):
                words = Words(texts, NOT_ALNUM)
                order = np.argsort(words.hashes, kind="stable")
                terms, begin = np.unique(words.hashes[order], return_index=True)
                arrays = words.first.astype(np.int64), terms, np.append(begin, len(order)).astype(np.int32), order.astype(_width(len(order)))
                ids = [pa.array([batch.column(c).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | count]), *ids, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=[c.split()[0] for c in INDEX.split(", ")])
                count += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return store(rows.mapInArrow(run, INDEX), SEGMENTS_PER_FILE)


def _width(words: int):
    return np.uint16 if words <= 1 << 16 else np.int32


class Postings:
    """A segment of the index."""

    def __init__(self, segment: dict):
        self.first, self.terms, self.begin = (np.frombuffer(segment[k], t) for k, t in (("first", np.int64), ("terms", np.uint64), ("begin", np.int32)))
        self.begin = self.begin.astype(np.int64)
        self.positions = np.frombuffer(segment["positions"], _width(int(self.begin[-1]))).astype(np.int64)
        #: All lists as one sorted sequence of (term number, position).
        self.keys = np.repeat(np.arange(len(self.terms)) << 32, np.diff(self.begin)) | self.positions

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def _within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does the list of the term hold a position from low to high?"""
        at = np.searchsorted(self.keys, (term << 32) | low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32) | high)

    def search(self, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, word at which it starts, exact?) of each match."""
        none = np.zeros(0, np.int64)
        if not len(windows.rows) or not len(self.keys):
            return none, none, none.astype(bool)
        place = np.minimum(np.searchsorted(self.terms, windows.terms), len(self.terms) - 1)
        number = np.where(self.terms[place] == windows.terms, place, -1)
        count = np.where(number >= 0, np.diff(self.begin)[place], 0)
        counts = np.where(windows.rows >= 0, count[windows.rows], np.iinfo(np.int64).max)
        possible = np.flatnonzero(counts.min(1) > 0)
        rarest = np.argsort(counts[possible], axis=1, kind="stable")
        anchor = rarest[:, 0]
        term = number[windows.rows[possible, anchor]]
        many = np.diff(self.begin)[term]
        of = np.repeat(np.arange(len(possible)), many)
        at = self.positions[np.repeat(self.begin[term], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)].astype(np.int64)
        # The first term may stand up to slop words off its place: each of those starts is a candidate.
        shift = np.arange(-slop, slop + 1)
        of, start, text = np.repeat(of, len(shift)), (at[:, None] - anchor[of][:, None] + shift).ravel(), np.repeat(self.text_of(at), len(shift))
        low, high = self.first[text], self.first[text + 1]
        keep = (start >= low) & (start + windows.lengths[possible[of]] <= high)
        if slop:  # several places of the first term may give the same start
            keep[keep] = np.isin(np.arange(keep.sum()), np.unique(of[keep] * (self.first[-1] + 1) + start[keep], return_index=True)[1])
        of, start, low, high = of[keep], start[keep], low[keep], high[keep]
        exact = np.ones(len(of), bool)
        for step in range(0 if slop else 1, windows.rows.shape[1]):
            offset = rarest[of, step]
            row = windows.rows[possible[of], offset]
            term, past = number[row], row < 0
            here = past | self._within(term, start + offset, start + offset)
            near = past | self._within(term, np.maximum(start + offset - slop, low), np.minimum(start + offset + slop, high - 1)) if slop else here
            of, start, low, high, exact = of[near], start[near], low[near], high[near], (exact & here)[near]
        return possible[of], start, exact


def benchmark_blocks(benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The items in blocks; the driver holds one block at a time (and one item, if it is longer)."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).toLocalIterator():
        (_, _, texts), = text_slices(pa.array([row.text]), max(1, 4 * len(row.text)))
        words = Words(texts, NOT_ALNUM).hashes
        if held and held + len(words) > block_words:
            yield Windows(block, size)
            block, held = [], 0
        block.append((row.item_id, words))
        held += len(words)
    yield Windows(block, size)


def _items_of(windows: Windows, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into w, item) for each item of each window."""
    many = np.diff(windows.first)[w]
    each = np.repeat(np.arange(len(w)), many)
    return each, windows.items[np.repeat(windows.first[w], many) + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]


def _over_blocks(index: DataFrame, benchmark: DataFrame, window: int, make, schema: str) -> DataFrame:
    """What ``make`` yields for each segment and block, of all blocks: each is answered and stored before the next is read."""
    found = None
    for windows in benchmark_blocks(benchmark, window):

        def run(batches, windows=windows):
            for batch in batches:
                for i in range(batch.num_rows):  # one segment at a time
                    segment = batch.slice(i, 1).to_pylist()[0]
                    yield make(segment, Postings(segment), windows)

        part = store(index.mapInArrow(run, schema))
        found = part if found is None else found.unionByName(part)
    return found


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every match: doc_id, item_id, word (index of its first word), n_words, kind (phrase or proximity)."""

    def matches(segment, index, windows):
        w, start, exact = index.search(windows, slop)
        each, item = _items_of(windows, w)
        text, ids = index.text_of(start[each]), np.array(segment["doc_ids"], object)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[text], pa.int64()), pa.array(item), pa.array(start[each] - index.first[text]), pa.array(windows.lengths[w][each].astype(np.int32)), pa.array(np.where(exact[each], "phrase", "proximity"), pa.string())],
            names=["doc_id", "item_id", "word", "n_words", "kind"],
        )

    return _over_blocks(build_index(documents), benchmark, window, matches, "doc_id long, item_id long, word long, n_words int, kind string")


def _hits(index: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """segment, doc (its number there), doc_id, text_key, words (numbers of hit words), items: a row for each document of a block with hits."""

    def hits(segment, index, windows):
        w, start, _ = index.search(windows)
        marks = np.zeros(int(index.first[-1]) + 1, np.int64)
        np.add.at(marks, start, 1)
        np.add.at(marks, start + windows.lengths[w], -1)
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        of_hit = index.text_of(hit)
        each, item = _items_of(windows, w)
        pairs = np.unique(np.stack([index.text_of(start[each]), item]), axis=1) if len(each) else np.zeros((2, 0), np.int64)
        docs = np.unique(of_hit)
        lists = []
        for values, of in ((hit - index.first[of_hit], of_hit), (pairs[1], pairs[0])):
            bounds = np.append(np.searchsorted(of, docs), len(of)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int64))))
        ids = [pa.array([segment[k][d] for d in docs.tolist()], pa.int64()) for k in ("doc_ids", "text_keys")]
        return pa.RecordBatch.from_arrays([pa.array([segment["segment"]] * len(docs), pa.int64()), pa.array(docs.astype(np.int32)), *ids, *lists], names=["segment", "doc", "doc_id", "text_key", "words", "items"])

    return _over_blocks(index, benchmark, window, hits, "segment long, doc int, doc_id long, text_key long, words array<long>, items array<long>")


@tidy
def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(documents)

    def sizes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.diff(np.frombuffer(row["first"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(n)], names=["segment", "doc", "doc_id", "n_words"])

    rows = index.select("segment", "doc_ids", "first").mapInArrow(sizes, "segment long, doc int, doc_id long, n_words long")
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    hits = _hits(index, benchmark, window).groupBy("segment", "doc").agg(F.size(all_of("words")).alias("n_hit"), all_of("items").cast("array<string>").alias("items"))
    out = rows.join(hits, ["segment", "doc"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    digest = F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", count("n_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"), digest.alias("items_sha256"), (count("n_hit") > 0).alias("contaminated"))


@tidy
def _contaminated(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    return _hits(build_index(documents), benchmark, window).select(F.col("doc_id").alias("_lattix_doc"), F.col("text_key").alias("_lattix_text")).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    hit = _contaminated(documents, benchmark, window)
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_lattix_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_lattix_text"))
    return documents.join(hit, same, "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
