"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it.

Vectors become nodes (equal vectors one node, with the rows it stands for kept beside). A node also
has the component that makes all norms equal, so that near nodes are near by inner product.

NN-descent. Every node keeps its ``NEIGHBOURS`` nearest nodes known so far. In each round it sends
itself to nodes of its list; all that meet at a node are neighbours of a neighbour of each other,
are compared there with one small matrix product, and each learns those that improve its list. The
first round meets at random. Rounds are two shuffles each: by meeting place, and by node to merge.
A meeting place takes part with ``MEETING`` of its visitors, chosen anew in each round, and a node
visits ``VISITS`` places; these bound the work at hubs and are part of the method (they decide how
fast lists improve, not which rows are indexed: all are).

Search. A query holds the ``BEAM`` best nodes seen. In each round it expands the best ``EXPAND``
that it has not expanded, reads their lists from the graph by a join, and keeps the best again; it ends
when all it holds are expanded. It starts from the best of a sample of nodes that grows with the square root of their number up to ``ENTRIES`` and, if it is a
row of the index, from its own node. The best ``RERANK`` nodes are then scored exactly, in double
precision on the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most. Ties go to the smaller vec_id. Rows that repeat with their vec_id count
once. Other columns play no part. Recall against brute force is tested; see the README for figures.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, read, store, tidy

NEIGHBOURS = 40
VISITS = 30
MEETING = 64
LEARN = 12
ROUNDS = 9
#: Stop when a round changes fewer than this share of list places.
SETTLED = 0.01
BEAM = 224
EXPAND = 32
#: Entry points: ENTRY_ROOTS times the square root of the number of nodes, at most ENTRIES.
ENTRIES, ENTRY_ROOTS = 512, 4
RERANK = 64
#: Random meetings of the first round: places visited by a node, and visitors of a place.
FIRST_VISITS, FIRST_SIZE = 4, 40


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of rounds that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _aligned(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by ``key``."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (held and held[-1].column(key)[-1].as_py() != keys[-1]):
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    column = table.column(name).combine_chunks() if isinstance(table.column(name), pa.ChunkedArray) else table.column(name)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)


def _lists(row: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """List arrays of n rows from values sorted by row."""
    at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(v)) for v in values]


def _half(column) -> np.ndarray:
    """The vectors of a binary column of half-precision numbers, as a matrix."""
    vectors = [np.frombuffer(x, np.float16) for x in column.to_pylist()]
    return np.stack(vectors).astype(np.float32) if vectors else np.zeros((0, 1), np.float32)


# ---------------------------------------------------------------- nodes

def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(whole)
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (size["n"] if size else 0))
    # 0.0 and -0.0 are the same component.
    return rows.select("vec_id", F.transform("vector", lambda x: x + 0.0).alias("vector"))


def make_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, vector), (node, vec_id)); a node is named by the smallest vec_id of its vector."""
    nodes = store(rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("many")))
    several = nodes.where("many > 1").select("vector", "node")
    single = nodes.where("many = 1").select("node", F.col("node").alias("vec_id"))
    members = single.unionByName(rows.join(several, "vector").select("node", "vec_id").distinct())
    return nodes.select("node", "vector"), store(members)


def _halved(nodes: DataFrame) -> DataFrame:
    """(node, half: binary): the vector at half precision and unit scale, with the component that evens out norms."""
    top = nodes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 1.0

    def run(batches):
        for batch in batches:
            v = np.stack(batch.column("vector").to_pylist()).astype(np.float64) / np.sqrt(top) if batch.num_rows else np.zeros((0, 1))
            rest = np.sqrt(np.maximum(0.0, 1 - (v * v).sum(1)))
            halves = np.concatenate([v, rest[:, None]], 1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([h.tobytes() for h in halves], pa.binary())], names=["node", "half"])

    return nodes.mapInArrow(run, "node long, half binary")


# ---------------------------------------------------------------- graph

GRAPH = "node long, half binary, near array<long>, score array<float>, fresh int"
VISIT = "place long, turn long, node long, half binary, least float"


def _visit(batches, seed: int, places: int):
    """Send nodes to meeting places: ``places`` random ones, or (0) nodes of their lists and themselves."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        tag = mix(node.view(np.uint64) ^ mix(np.array([seed], np.uint64)))
        if places:
            place = np.concatenate([(mix(tag + np.uint64(k)) % np.uint64(places)).astype(np.int64) for k in range(FIRST_VISITS)])
            row = np.tile(np.arange(len(node)), FIRST_VISITS)
            least = np.full(len(place), -np.inf, np.float32)
        else:
            near, row = _flat(pa.Table.from_batches([batch]), "near")
            score, _ = _flat(pa.Table.from_batches([batch]), "score")
            draw = mix(near.view(np.uint64) ^ tag[row])
            order = np.lexsort((draw, row))
            first = np.searchsorted(row, np.arange(len(node)))
            chosen = order[np.arange(len(order)) - first[row] < VISITS]
            full = np.bincount(row, minlength=len(node)) >= NEIGHBOURS
            last = np.full(len(node), np.inf, np.float32)
            np.minimum.at(last, row, score)
            last[~full] = -np.inf
            place, row = np.concatenate([near[chosen], node]), np.concatenate([row[chosen], np.arange(len(node))])
            least = last[row]
        turn = (mix(tag[row] ^ place.view(np.uint64)) >> np.uint64(1)).view(np.int64)
        turn[place == node[row]] = -1  # the place itself always takes part
        # Those beyond the first MEETING of these rows are beyond them at the place, too: a hub gets no more from any batch.
        order = np.lexsort((turn, place))
        sorted_place = place[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_place, sorted_place)
        order = np.sort(order[rank < MEETING])
        place, row, turn, least = place[order], row[order], turn[order], least[order]
        for lo in range(0, len(place), 20_000):
            some = slice(lo, lo + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(turn[some]), pa.array(node[row[some]]), batch.column("half").take(pa.array(row[some])), pa.array(least[some])], names=["place", "turn", "node", "half", "least"])


def _meet(batches):
    """At each place (rows sorted by place and turn) compare the visitors with each other."""
    for table in _aligned(batches, "place"):
        place = table.column("place").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.minimum(np.diff(np.append(start, len(place))), MEETING)
        node, least = table.column("node").to_numpy(), table.column("least").to_numpy()
        half = table.column("half").combine_chunks()
        out: list[tuple] = []
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            if n < 2:
                continue
            v = _half(half.slice(s, n))
            score = v @ v.T
            np.fill_diagonal(score, -np.inf)
            m = min(n - 1, LEARN)
            best = np.argpartition(-score, m - 1, 1)[:, :m]
            value = np.take_along_axis(score, best, 1)
            a, b = np.nonzero(value > least[s : s + n, None])
            out.append((node[s + a], node[s + best[a, b]], value[a, b]))
        if out:
            who, near, value = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(who, kind="stable")
            who, near, value = who[order], near[order], value[order]
            names, row = np.unique(who, return_inverse=True)
            a, b = _lists(row, len(names), near, value.astype(np.float32))
            batch = pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.binary()), a, b, pa.nulls(len(names), pa.int32())], names=["node", "half", "near", "score", "fresh"])
            for lo in range(0, len(names), 10_000):
                yield batch.slice(lo, 10_000)


def _merge(batches):
    """Merge what nodes have learned (rows sorted by node) into their lists."""
    for table in _aligned(batches, "node"):
        node = table.column("node").to_numpy()
        names, group = np.unique(node, return_inverse=True)
        near, row = _flat(table, "near")
        score, _ = _flat(table, "score")
        half = table.column("half").combine_chunks()
        own = np.asarray(half.is_valid())
        old = own[row]
        of = group[row]
        order = np.lexsort((~old, near, -score, of))
        of, near, score, old = of[order], near[order], score[order], old[order]
        keep = np.ones(len(of), bool)  # a pair's score is the same wherever it was computed, up to rounding
        pair = np.lexsort((~old, near, of))
        same = (of[pair][1:] == of[pair][:-1]) & (near[pair][1:] == near[pair][:-1])
        keep[pair[1:][same]] = False
        keep &= near != names[of]
        of, near, score, old = of[keep], near[keep], score[keep], old[keep]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(names)))[of]
        of, near, score, old = (x[place < NEIGHBOURS] for x in (of, near, score, old))
        has = np.full(len(names), -1)
        has[group[own]] = np.flatnonzero(own)
        fresh = np.bincount(of, ~old, len(names)).astype(np.int32)
        a, b = _lists(of, len(names), near, score)
        batch = pa.RecordBatch.from_arrays([pa.array(names), half.take(pa.array(has)), a, b, pa.array(fresh)], names=["node", "half", "near", "score", "fresh"])
        for lo in range(0, len(names), 5_000):
            yield batch.slice(lo, 5_000)


def build_graph(nodes: DataFrame, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(node, half, near, score, fresh): for each node its neighbours, nearest first."""
    spark = nodes.sparkSession
    empty = F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("score"), F.lit(0).alias("fresh")
    graph = store(_halved(nodes).select("node", "half", *empty))
    count = graph.count()
    for k in range(rounds if count > 1 else 0):
        places = -(-count // FIRST_SIZE) * FIRST_VISITS if k == 0 else 0
        visits = graph.mapInArrow(lambda it, k=k, p=places: _visit(it, seed + k, p), VISIT)
        learned = visits.repartition("place").sortWithinPartitions("place", "turn").mapInArrow(_meet, GRAPH)
        graph = store(graph.unionByName(learned).repartition("node").sortWithinPartitions("node").mapInArrow(_merge, GRAPH))
        changed = graph.agg(F.sum("fresh")).first()[0] or 0
        _release(spark)
        if k and changed < SETTLED * NEIGHBOURS * count:
            break
    return graph


# ---------------------------------------------------------------- search

BEAMS = "query_id long, half binary, near array<long>, score array<float>, done array<boolean>"


def _unexpanded(row: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Places of the EXPAND first entries of each row that are not expanded; entries are best first."""
    at = np.flatnonzero(~done)
    nth = np.arange(len(at)) - np.searchsorted(row[at], np.arange(row[-1] + 1 if len(row) else 0))[row[at]]
    return at[nth < EXPAND]


def _frontier(batches):
    for batch in batches:
        near, row = _flat(pa.Table.from_batches([batch]), "near")
        done, _ = _flat(pa.Table.from_batches([batch]), "done")
        pick = _unexpanded(row, done.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(near[pick]), *(batch.column(c).take(pa.array(row[pick])) for c in ("query_id", "half"))], names=["node", "query_id", "half"])


def _score_lists(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            table = pa.Table.from_batches([whole.slice(lo, 1000)])
            query = _half(table.column("half"))
            near, row = _flat(table, "near")
            vectors = np.frombuffer(b"".join(table.column("halves").to_pylist()), np.float16).reshape(len(near), -1) if len(near) else np.zeros((0, query.shape[1]))
            score = np.einsum("ij,ij->i", vectors.astype(np.float32), query[row])
            a, b, c = _lists(row, table.num_rows, near, score.astype(np.float32), np.zeros(len(near), bool))
            yield pa.RecordBatch.from_arrays([table.column("query_id").combine_chunks(), pa.nulls(table.num_rows, pa.binary()), a, b, c], names=["query_id", "half", "near", "score", "done"])


def _advance(batches, beam: int):
    """Merge the lists read in this round (rows sorted by query) into the beams."""
    for table in _aligned(batches, "query_id"):
        names, group = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        near, row = _flat(table, "near")
        score, _ = _flat(table, "score")
        done = _flat(table, "done")[0].astype(bool)
        half = table.column("half").combine_chunks()
        own = np.asarray(half.is_valid())
        mine = own[row]
        expanded = np.flatnonzero(mine)[_unexpanded(row[mine], done[mine])]
        done[expanded] = True
        of = group[row]
        pair = np.lexsort((~done, ~mine, near, of))
        keep = np.ones(len(of), bool)
        keep[pair[1:][(of[pair][1:] == of[pair][:-1]) & (near[pair][1:] == near[pair][:-1])]] = False
        of, near, score, done = of[keep], near[keep], score[keep], done[keep]
        order = np.lexsort((near, -score, of))
        of, near, score, done = of[order], near[order], score[order], done[order]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(names)))[of]
        of, near, score, done = (x[place < beam] for x in (of, near, score, done))
        has = np.full(len(names), -1)
        has[group[own]] = np.flatnonzero(own)
        a, b, c = _lists(of, len(names), near, score, done)
        batch = pa.RecordBatch.from_arrays([pa.array(names), half.take(pa.array(has)), a, b, c], names=["query_id", "half", "near", "score", "done"])
        for lo in range(0, len(names), 2_000):
            yield batch.slice(lo, 2_000)


def search_graph(graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query_id, node, score): the nodes held at the end of each query's search.

    ``queries``: query_id, half (as in the graph), own (its node in the graph, or null).
    """
    spark = graph.sparkSession
    many_entries = min(ENTRIES, int(np.ceil(ENTRY_ROOTS * np.sqrt(graph.count()))))
    entries = graph.select("node", "half").orderBy(F.xxhash64("node"), "node").limit(many_entries).collect()
    if not entries:
        return spark.createDataFrame([], "query_id long, node long, score float")
    ids = np.array([r["node"] for r in entries], np.int64)
    matrix = np.stack([np.frombuffer(r["half"], np.float16) for r in entries]).astype(np.float32)
    matrix[:, -1] = 0

    def start(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _half(batch.column("half")) @ matrix.T
            order = np.argsort(-score, 1, kind="stable")[:, :EXPAND]
            near, value = ids[order], np.take_along_axis(score, order, 1)
            rows: list[list] = []
            for k, own in enumerate(batch.column("own").to_pylist()):
                known = own is None or own in near[k]
                rows.append(([] if known else [(own, 2.0)]) + list(zip(near[k].tolist(), value[k].tolist(), strict=True)))
            row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            flat = [x for r in rows for x in r[:beam]]
            a, b, c = _lists(row, len(rows), np.array([x for x, _ in flat], np.int64), np.array([x for _, x in flat], np.float32), np.zeros(len(flat), bool))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("half"), a, b, c], names=["query_id", "half", "near", "score", "done"])

    # Each node's list with the vectors in it: one join now, and none that moves the graph in the rounds.
    edges = graph.select("node", F.posexplode("near").alias("place", "other"))
    halves = graph.select(F.col("node").alias("other"), F.col("half").alias("of_other"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = edges.join(halves, "other").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "other", "of_other"))).alias("x"))
    listed = listed.select("node", F.col("x.other").alias("near"), F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["of_other"])).alias("halves"))
    listed = store(listed).repartition(parts, "node").persist(StorageLevel.MEMORY_AND_DISK)
    beams = store(queries.select("query_id", "half", "own").mapInArrow(start, BEAMS))
    finished = None
    while True:  # beams only improve, so a node that has left one doesn't come back
        open_ones = beams.where(F.exists("done", lambda x: ~x))
        if open_ones.isEmpty():
            break
        steps = open_ones.mapInArrow(_frontier, "node long, query_id long, half binary").repartition(parts, "node")
        read_lists = listed.join(steps.hint("shuffle_hash"), "node").select("query_id", "half", "near", "halves").mapInArrow(_score_lists, BEAMS)
        closed = beams.where(F.forall("done", lambda x: x))
        finished = closed if finished is None else finished.unionByName(closed)
        beams = store(open_ones.unionByName(read_lists).repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _advance(it, beam), BEAMS))
        _release(spark)
    found = store((beams if finished is None else finished.unionByName(beams)).select("query_id", F.explode(F.arrays_zip("near", "score")).alias("x")).select("query_id", F.col("x.near").alias("node"), F.col("x.score").alias("score")))
    listed.unpersist()
    return found


@tidy
def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` for which ``is_query`` holds."""
    rows = store(usable(vectors))
    nodes, members = make_nodes(rows)
    graph = build_graph(nodes)
    own = members.where(is_query).select(F.col("vec_id").alias("query_id"), "node")
    # A query has no component that evens out norms.
    plain = F.expr("concat(substring(half, 1, length(half) - 2), x'0000')")
    queries = store(own.join(graph.select("node", plain.alias("half")), "node").select("query_id", "half", F.col("node").alias("own")))
    found = search_graph(graph, queries)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    # The own node comes first among equals: copies of the query are its nearest by any measure that norms allow.
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= max(RERANK, k + 1)).select("query_id", "node")
    near = Window.partitionBy("node").orderBy("vec_id")
    rows_of = members.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1).drop("nth")
    left = own.join(nodes, "node").select("query_id", F.col("vector").alias("q"))
    pairs = found.join(nodes, "node").join(left, "query_id")
    product = F.aggregate(F.zip_with("q", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select("query_id", "node", product.alias("score")).join(rows_of, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
