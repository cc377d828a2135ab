"""Jaccard self-join of word n-gram sets by signature trees.

1. Equal sets are one class from the start (`class_id`: a 64-bit hash of the set).
2. Which tree a set enters. All n-grams have one order (`hang`), and a set names the first of its
   n-grams in that order as its roots: so many that a linked pair of sets shares at least ``need`` of
   them, however the rest differs. A set with fewer roots that other sets name too is linked with
   none and leaves. Of the roots that are left, all but ``need`` - 1 suffice for a pair to meet, so a
   set keeps the rarest. Sets that are connected by kept roots are a family. This loses no link.
   The order puts n-grams of passages that many documents share last; they are told by a sample
   that grows with the corpus, and the order changes the work but no result. The rows of n-grams
   that very many documents share are dealt out by set instead of by n-gram.
3. Each family gets a signature tree, whose nodes hold the OR of their members' bitmaps of n-grams,
   the range of their sizes and components. A dual traversal visits pairs of nodes and drops those
   that can't reach the overlap for their sizes (bits in common, plus n-grams that share a bit) or lie
   in one component; at the leaves, bitmaps and then the sets themselves decide.
   Families above ``BLOCK`` sets are cut into blocks, each with its tree. Then a set of each
   component found so far meets those of the other blocks in a tree of its own, which connects
   groups of near copies of any size. Last, the upper levels of the blocks' trees are traversed,
   and the pairs of blocks that may hold links between components get a task each.
4. Distributed union-find makes components of all links.

No document is compared by a prefix of its text or skipped for the size of its group. Null, empty and
wordless texts have no n-grams and stay alone. Texts of fewer words than ``width`` have their whole
sequence as the one n-gram. Rows with equal doc_id are rows like others. A row without doc_id takes
part; its component is named by the smallest doc_id in it, null if there is none. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Texts, Words, mix, read, store, text_slices, tidy
from .components import connected_components

BITS = 4096
LEAF, FAN = 32, 8
#: Sets of a block at most, and n-grams of a block from which on no other set enters it (16 MB).
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
#: Rounds in which sets with too few shared roots leave; more rounds save work and change no result.
PEELS = 1
#: Common n-grams: those in this many documents or more of a sample of one in COMMON_RATE; at most MAX_COMMON (4 MB) are told to the tasks.
COMMON_RATE, COMMON_DOCUMENTS, MAX_COMMON = 8, 3, 300_000
#: N-grams of so many documents in the sample have their rows dealt out by set.
HOT_DOCUMENTS = 250
#: Distinct sets whose roots a task remembers to have sent already.
REMEMBERED = 500_000
#: Documents whose keys may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class Measure:
    """Links need q * |x & y| >= p * |x | y|."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q

    def least_partner(self, sizes: np.ndarray) -> np.ndarray:
        """The smallest set that one of this size can be linked with, and their least overlap."""
        return -(-self.p * sizes // self.q)

    def _extra(self, sizes: np.ndarray) -> np.ndarray:
        return 1 + sizes - self.least_partner(sizes)

    def roots(self, sizes: np.ndarray) -> np.ndarray:
        """How many n-grams, in any order common to all sets, a set of this size names as its roots.

        Of the n-grams that a linked pair has in common at most ``least_partner - extra`` come behind
        the roots of a set, so the first ``extra`` of them are roots of it.
        """
        return np.minimum(sizes, sizes - self.least_partner(sizes) + self._extra(sizes))

    def need(self, sizes: np.ndarray) -> np.ndarray:
        """Roots at least that a set of this size shares with any that it is linked with."""
        least = self.least_partner(sizes)
        return np.minimum(least, self._extra(least))

    def needed(self, total):
        """Least overlap of linked sets whose sizes sum to ``total``."""
        return -(-self.p * total // (self.p + self.q))


def shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct n-grams of text i are hashes[bounds[i]:bounds[i + 1]]."""
    words = Words(texts, SPACE)
    many = np.diff(words.first)
    grams = np.where(many > 0, np.maximum(many - width + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), grams)
    at = words.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    code = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words.hashes, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(width):
            there = k < many[of]
            code = np.where(there, mix(code * np.uint64(0x2545F4914F6CDD1D) + padded[at + k]), code)
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    code, of = code[new], of[new]
    return code, np.searchsorted(of, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by index, modulo 2^64."""
    low = np.bincount(index, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(index, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    with np.errstate(over="ignore"):
        return low + (high << np.uint64(32))


def common_shingles(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents): sorted hashes of n-grams that several documents of the sample have, and in how many."""

    def run(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(texts, width)[0].view(np.int64))], names=["code"])

    sample = documents.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_RATE)) == 0).select("text").mapInArrow(run, "code long")
    often = sample.groupBy("code").count().where(F.col("count") >= COMMON_DOCUMENTS).orderBy(F.desc("count"), "code").limit(MAX_COMMON).toPandas()
    code, count = often["code"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)
    order = np.argsort(code)
    return code[order], count[order]


def _classes(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    return mix(_sums(mix(code ^ np.uint64(0x5DEECE66D)), of, len(n)) ^ mix(n.astype(np.uint64))).view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and text_key, a hash of the text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def profile(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id (null: no n-grams)."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                code, bounds = shingles(texts, width)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key")), pa.array(n.astype(np.int64)), pa.array(_classes(code, bounds), mask=n == 0)], names=["doc_id", "text_key", "n_shingles", "class_id"])

    return _keyed(documents).mapInArrow(run, "doc_id long, text_key long, n_shingles long, class_id long")


def pick_roots(code: np.ndarray, bounds: np.ndarray, measure: Measure, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, root, documents of the sample that have it) of sets of sorted n-grams."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    often = np.zeros(len(code), np.int64)
    if len(common[0]):
        place = np.minimum(np.searchsorted(common[0], code), len(common[0]) - 1)
        often = np.where(common[0][place] == code, common[1][place], 0)
    rare = often == 0
    before = np.concatenate([[0], np.cumsum(rare)])
    rares = before[bounds[1:]] - before[bounds[:-1]]
    rank_rare = before[:-1] - before[bounds[:-1]][of]
    rank = np.where(rare, rank_rare, rares[of] + np.arange(len(code)) - bounds[:-1][of] - rank_rare)
    keep = rank < measure.roots(n)[of]
    return of[keep], code[keep], often[keep]


def hang(documents: DataFrame, width: int, measure: Measure) -> DataFrame:
    """root, class_id, tally: a row for each root of each set; a task sends a set once.

    tally holds, in 32 bits each, about how many sets name a hot root (0 for others) and the need of the set.
    """
    common = common_shingles(documents, width)

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                code, bounds = shingles(texts, width)
                classes = _classes(code, bounds)
                n = np.diff(bounds)
                fresh = np.zeros(hi - lo, bool)
                if len(sent) > REMEMBERED:
                    sent.clear()
                for i, c in enumerate(classes.tolist()):
                    if n[i] and c not in sent:
                        sent.add(c)
                        fresh[i] = True
                of, root, often = pick_roots(code, bounds, measure, common)
                own = fresh[of]
                of, root, often = of[own], root[own], often[own]
                many = np.where(often >= HOT_DOCUMENTS, often * COMMON_RATE, 0)
                yield pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), pa.array(classes[of]), pa.array(np.minimum(many, 1 << 30) << 32 | measure.need(n)[of])], names=["root", "class_id", "tally"])

    return documents.select("text").where("text IS NOT NULL").mapInArrow(run, "root long, class_id long, tally long")


def _shared_roots(batches):
    """Of rows sorted by (root, class_id): one for each set of the roots that have several, with their number and a node of all of them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        root = held.column("root").to_numpy()
        # The last root may go on in the next batch, unless it is hot and needs no count.
        whole = len(root) if batch.column("tally")[-1].as_py() >> 32 else int(np.searchsorted(root, root[-1]))
        if whole:
            yield from _several(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield from _several(held)


def _several(rows: pa.Table):
    root, one, tally = (rows.column(c).to_numpy() for c in ("root", "class_id", "tally"))
    new = np.ones(len(root), bool)
    new[1:] = (root[1:] != root[:-1]) | (one[1:] != one[:-1])
    root, one, tally = root[new], one[new], tally[new]
    hot = tally >> 32
    starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
    size = np.diff(np.concatenate([starts, [len(root)]]))
    many = np.where(hot > 0, hot, np.repeat(size, size))
    # The node that connects the sets of a root: the first of them, or for a hot root, whose sets lie in many tasks, the root itself.
    node = np.where(hot > 0, root, np.repeat(one[starts], size))
    keep = many > 1
    made = pa.table({"root": root[keep], "class_id": one[keep], "need": tally[keep].astype(np.int32), "many": many[keep].astype(np.int32), "node": node[keep]})
    yield from made.to_batches(max_chunksize=50_000)


def _rarest(rows: DataFrame) -> DataFrame:
    """Of rows (root, class_id, need, many, ...): those of sets with enough roots; of each set the rarest, all but need - 1."""
    counted = rows.withColumn("_degree", F.expr("count(*) over (partition by class_id)")).withColumn("_rank", F.expr("row_number() over (partition by class_id order by many, root)"))
    return counted.where("_degree >= need AND _rank <= _degree - need + 1").drop("_degree", "_rank")


def _peel(rows: DataFrame) -> DataFrame:
    """Rows (root, class_id, node) of roots that still have several sets."""
    several = rows.groupBy("root").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high").select("root")
    return rows.join(several, "root", "left_semi")


#: What a node has besides its bitmap.
NODE = ("low", "high", "excess", "first_component", "last_component")


class SignatureTree:
    """Nodes over sets in the given order; node 0 of level 0 is the first leaf."""

    def __init__(self, rows: tuple, leaf: int = LEAF):
        """rows: bitmaps, least and greatest size, most n-grams that share a bit, least and greatest component."""
        self.levels = [self._combine(rows, leaf)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(self._combine(self.levels[-1], FAN))

    @staticmethod
    def _combine(rows: tuple, size: int) -> tuple:
        at = np.arange(0, len(rows[1]), size)
        least, most = np.minimum, np.maximum
        return np.bitwise_or.reduceat(rows[0], at, axis=0), *(f.reduceat(r, at) for f, r in zip((least, most, most, least, most), rows[1:], strict=True))


def _may_link(a: tuple, i: np.ndarray, b: tuple, k: np.ndarray, measure: Measure) -> np.ndarray:
    """For pairs of nodes: can sets below them be linked, and is the link not known yet?"""
    fits = (a[2][i] * measure.q >= b[1][k] * measure.p) & (b[2][k] * measure.q >= a[1][i] * measure.p)
    fits &= (a[4][i] != b[5][k]) | (a[5][i] != b[4][k])
    if fits.any():
        i, k = i[fits], k[fits]
        overlap = np.bitwise_count(a[0][i] & b[0][k]).sum(1, dtype=np.int64) + np.minimum(a[3][i], b[3][k])
        fits[fits] = overlap >= measure.needed(a[1][i] + b[1][k])
    return fits


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool, measure: Measure) -> Iterator[tuple[int, int]]:
    """Pairs of lowest nodes that may hold linked sets; in one tree (``same``) each pair once."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, k = stack.pop()
        keep = _may_link(a.levels[la], i, b.levels[lb], k, measure)
        i, k = i[keep], k[keep]
        if not len(i):
            continue
        if la == lb == 0:
            yield from zip(i.tolist(), k.tolist(), strict=True)
            continue
        da, db = la > 0, lb > 0
        ci = i[:, None] * (FAN if da else 1) + np.arange(FAN if da else 1)
        ck = k[:, None] * (FAN if db else 1) + np.arange(FAN if db else 1)
        ci, ck = np.broadcast_arrays(ci[:, :, None], ck[:, None, :])
        ci, ck = ci.ravel(), ck.ravel()
        real = (ci < len(a.levels[la - da][1])) & (ck < len(b.levels[lb - db][1]))
        if same:
            real &= ci <= ck
        ci, ck = ci[real], ck[real]
        for lo in range(0, len(ci), 4096):  # bounds the bitmaps that are combined at a time
            stack.append((la - da, lb - db, ci[lo : lo + 4096], ck[lo : lo + 4096]))


class Members:
    """Sets of one block, with what their tree needs."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray):
        self.sets, self.component = sets, component
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bit = np.concatenate(sets) >> np.uint64(64 - BITS.bit_length() + 1)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        self.bitmaps = np.zeros((len(sets), BITS // 64), np.uint64)
        np.bitwise_or.at(self.bitmaps, (of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        self.excess = self.sizes - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)

    def rows(self) -> tuple:
        return self.bitmaps, self.sizes, self.sizes, self.excess, self.component, self.component


def join_blocks(a: Members, b: Members, measure: Measure) -> list[tuple[int, int]]:
    """Pairs of components that a link joins, enough to connect all that links connect."""
    same, parent, out = a is b, {}, []

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    rows_a, rows_b = a.rows(), b.rows()
    tree = SignatureTree(rows_a)
    for x, y in dual_traversal(tree, tree if same else SignatureTree(rows_b), same, measure):
        i, k = np.meshgrid(np.arange(x * LEAF, min((x + 1) * LEAF, len(a.sizes))), np.arange(y * LEAF, min((y + 1) * LEAF, len(b.sizes))), indexing="ij")
        i, k = i.ravel(), k.ravel()
        if same:
            i, k = i[i < k], k[i < k]
        keep = _may_link(rows_a, i, rows_b, k, measure)
        for u, v in zip(i[keep].tolist(), k[keep].tolist(), strict=True):
            c, d = root(int(a.component[u])), root(int(b.component[v]))
            if c != d and len(np.intersect1d(a.sets[u], b.sets[v], assume_unique=True)) >= measure.needed(int(a.sizes[u] + b.sizes[v])):
                parent[max(c, d)] = min(c, d)
                out.append((c, d))
    return out


def _groups(batches, key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            piece = table.slice(lo, hi - lo)
            if held and held[0].column(key)[0].as_py() != piece.column(key)[0].as_py():
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)


def _members(rows: pa.Table, own: str = "component") -> Members:
    return Members([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("codes")], rows.column(own).to_numpy())


def _in_blocks(sets: DataFrame, *order: str) -> DataFrame:
    """The rows (family, n, ...) with a block: consecutive sets of a family in the given order.

    Sets are dealt to tasks by ranges of (family, order), so a family of any size is spread over many tasks.
    """
    keys = ["family", *order]

    def number(batches):
        task, count, family, sets_in, grams = TaskContext.get().partitionId(), 0, None, 0, 0
        for batch in batches:
            blocks = []
            for f, n in zip(batch.column("family").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if f != family or sets_in == BLOCK or grams >= BLOCK_GRAMS:
                    family, sets_in, grams, count = f, 0, 0, count + 1
                sets_in, grams = sets_in + 1, grams + n
                blocks.append((task << 40) | count)
            yield batch.append_column("block", pa.array(blocks, pa.int64()))

    return sets.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, sets.withColumn("block", F.lit(0).cast("long")).schema)


def _sets_of(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (doc_id, text_key, class_id and others) with codes, the n-grams of its document as bytes."""
    small = wanted.count() <= BROADCAST_IDS
    other = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = _keyed(documents.where("text IS NOT NULL"))
    rows = rows.join(F.broadcast(other) if small else other.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).drop("doc_id", "text_key", "_id", "_key")
    rest = [c for c in rows.columns if c != "text"]
    schema = rows.select(*rest).withColumn("codes", F.lit(b"")).schema

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                code, bounds = shingles(texts, width)
                sets = [code[bounds[i] : bounds[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in rest), pa.array(sets, pa.binary())], names=[*rest, "codes"])

    return rows.mapInArrow(run, schema)


LINKS = "a long, b long"


def _block_links(sets: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) between classes that the tree of each block finds; a class may have several rows with the same set."""

    def links(batches):
        for rows in _groups(batches, "block"):
            one = rows.column("class_id").to_numpy()
            # The order within the block is kept, of each class the first row.
            first = np.sort(np.unique(one, return_index=True)[1])
            m = _members(rows.take(pa.array(first)), "class_id")
            found = join_blocks(m, m, measure)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return sets.select("block", "near", "n", "class_id", "codes").repartition("block").sortWithinPartitions("block", "near", "n", "class_id").mapInArrow(links, LINKS)


def _pair_links(sets: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) between components in different blocks of a family, from sets with family, block, class_id, component, codes."""

    def node(batches):
        for rows in _groups(batches, "block"):
            m = _members(rows)
            top = SignatureTree(m.rows(), len(m.sizes)).levels[0]
            first = [rows.column(c)[:1].combine_chunks() for c in ("family", "block")]
            yield pa.RecordBatch.from_arrays([*first, pa.array([top[0][0].tobytes()], pa.binary()), *(pa.array(x[:1]) for x in top[1:])], names=["family", "block", "bitmap", *NODE])

    def pairs(batches):
        for rows in _groups(batches, "family"):
            bitmaps = np.stack([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("bitmap")])
            tree = SignatureTree((bitmaps, *(rows.column(c).to_numpy() for c in NODE)), 1)
            blocks = rows.column("block").to_numpy()
            found = [(int(blocks[i]), int(blocks[k])) for i, k in dual_traversal(tree, tree, True, measure) if i != k]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["x", "y"])

    def links(batches):
        for rows in _groups(batches, "task"):
            sides = rows.column("side").to_numpy()
            found = join_blocks(*(_members(rows.filter(pa.array(sides == k))) for k in (0, 1)), measure)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    sides = sets.select("family", "block", "class_id", "component", "codes")
    nodes = sides.repartition("block").sortWithinPartitions("block", "component", "class_id").mapInArrow(node, "family long, block long, bitmap binary, " + ", ".join(f"{c} long" for c in NODE))
    split = store(nodes.repartition("family").sortWithinPartitions("family", "block").mapInArrow(pairs, "x long, y long"))
    task = F.xxhash64("x", "y").alias("task")
    both = split.select(F.col("x").alias("block"), task, F.lit(0).alias("side")).unionByName(split.select(F.col("y").alias("block"), task, F.lit(1).alias("side")))
    dealt = sides.join(both, "block").select("task", "side", "class_id", "component", "codes")
    return dealt.repartition("task").sortWithinPartitions("task", "side", "component", "class_id").mapInArrow(links, LINKS)


def _with_components(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with their component under the links."""
    components = connected_components(links).withColumnRenamed("node", "class_id")
    return sets.join(components, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))


def _unconnected(sets: DataFrame) -> DataFrame:
    """Of sets with components: those of families that have several."""
    several = sets.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family")
    return sets.join(several, "family", "left_semi")


def family_links(documents: DataFrame, classes: DataFrame, width: int, measure: Measure) -> DataFrame:
    """Links (a, b) between classes: enough to connect all that links connect."""
    hung = hang(documents, width, measure)
    shared = hung.repartition(F.when(F.shiftright("tally", 32) > 0, F.col("class_id")).otherwise(F.col("root"))).sortWithinPartitions("root", "class_id")
    kept = store(_rarest(shared.mapInArrow(_shared_roots, "root long, class_id long, need int, many int, node long")).select("root", "class_id", "node"))
    for _ in range(PEELS):
        kept = store(_peel(kept))
    edges = store(kept.select("class_id", "node").distinct())
    family = connected_components(edges.select(F.col("class_id").alias("a"), F.col("node").alias("b"))).select(F.col("node").alias("class_id"), F.col("component").alias("family"))
    members = edges.groupBy("class_id").agg(F.min("node").alias("near")).join(family, "class_id", "left").withColumn("family", F.coalesce("family", "class_id")).join(classes, "class_id")
    blocked = store(_in_blocks(members, "near", "n", "class_id"))
    several = blocked.groupBy("family").agg(F.count("*").alias("sets"), F.min("block").alias("low"), F.max("block").alias("high")).where("sets > 1")
    wanted = store(blocked.join(several.select("family", (F.col("low") < F.col("high")).alias("split")), "family"))
    sets = store(_sets_of(documents, wanted, width))
    links = store(_block_links(sets, measure))
    if wanted.where("split").isEmpty():
        return links
    placed = store(_unconnected(_with_components(wanted.where("split").drop("codes"), links)))
    chosen = placed.groupBy("family", "component").agg(F.min(F.struct("near", "n", "class_id")).alias("first")).select("family", "first.*")
    meeting = _in_blocks(chosen, "near", "n", "class_id")
    more = store(_block_links(sets.select("class_id", "codes").join(meeting, "class_id"), measure))
    links = store(links.unionByName(more))
    left = store(_unconnected(_with_components(wanted.where("split"), links)))
    if left.isEmpty():
        return links
    one_each = sets.select("class_id", "codes").join(left, "class_id").dropDuplicates(["class_id"])
    return store(links.unionByName(_pair_links(store(one_each), measure)))


def _components(documents: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """The profile of every row, with component, a class (null: no n-grams), and component_id, the smallest doc_id in it."""
    profiles = store(profile(documents, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = profiles.where("class_id IS NOT NULL").groupBy("class_id").agg(first, F.first("n_shingles").alias("n"))
    classes = store(classes.select("class_id", "first.doc_id", "first.text_key", "n"))
    links = family_links(documents, classes, width, Measure(p, q))
    linked = connected_components(links).withColumnRenamed("node", "class_id").join(classes, "class_id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least, "component").select("class_id", "component", "component_id")
    alone = classes.join(named, "class_id", "left_anti").select("class_id", F.col("class_id").alias("component"), F.col("doc_id").alias("component_id"))
    return profiles.join(store(named.unionByName(alone)), "class_id", "left")


@tidy
def link_components(documents: DataFrame, width: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; links are Jaccard similarities of p / q or more."""
    rows = _components(documents, width, p, q)
    return rows.select("doc_id", "n_shingles", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@tidy
def _kept_rows(documents: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """_lattix_doc, _lattix_text, _lattix_copies: doc_id and text_key of the one row of each component that stays, and how many rows have both."""
    rows = _components(documents, width, p, q).where("class_id IS NOT NULL")
    same = rows.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    first = same.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "copies")).alias("first"))
    return first.select(F.col("first.doc_id").alias("_lattix_doc"), F.col("first.text_key").alias("_lattix_text"), F.col("first.copies").alias("_lattix_copies"))


def drop_near_copies(documents: DataFrame, width: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """The documents, with all their columns: of each component the row with the smallest doc_id, and all without n-grams.

    Nulls come behind all doc_ids. Of rows with equal doc_id the text with the least hash goes first, and of
    rows that also have the same text any one stays.
    """
    kept = _kept_rows(documents, width, p, q)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.withColumns({"_lattix_id": F.col("doc_id").cast("long"), "_lattix_key": F.xxhash64(F.col("text").cast("string"))})
    here = F.col("_lattix_id").eqNullSafe(F.col("_lattix_doc")) & (F.col("_lattix_key") == F.col("_lattix_text"))
    stay = rows.join(kept.where("_lattix_copies = 1"), here, "left_semi").select(*columns)
    repeated = kept.where("_lattix_copies > 1")
    if not repeated.isEmpty():
        stay = stay.unionByName(rows.join(repeated, here, "left_semi").dropDuplicates(["_lattix_id", "_lattix_key"]).select(*columns))
    return stay.unionByName(_without_ngrams(documents))


def _without_ngrams(documents: DataFrame) -> DataFrame:
    """The rows whose text has no word."""
    return documents.where(F.col("text").isNull() | ~F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents"), width=3, p=9, q=10)
