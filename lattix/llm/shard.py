"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly (law `bytes`).

Groups of equal texts are what is packed, each as the vector of its bytes, tokens and rows, largest
first, into the shard where the dot product with the residual capacity is highest. This takes three steps,
so that neither the driver nor a task holds more than a bounded number of groups:

1. Large groups, above 1 / ``LARGE`` of any total (there are 3 * ``LARGE`` at most), are packed on the driver.
   A group stays whole if it is no larger than a shard and the bytes of any shard have room for it; otherwise
   shards could not be equal, and it is cut by the hash of doc_id into cells that are packed one by one.
2. All others but the reserve are packed in tasks of about ``GROUPS`` groups by hash, each with its
   part of the capacity that is left.
3. The reserve, the ``RESERVE`` small groups with the least hashes, is packed last on the driver, into
   what the tasks left, and groups that the driver has placed are moved or exchanged while that brings the bytes of two shards closer.

Slots count the rows of a shard from 0: rows are counted by task while they are written, and the counts
of the tasks before are added. No task sees a whole shard, and no rows are sorted.

Null texts count as empty: size 1, no tokens. Rows with equal doc_id and text are interchangeable and lie in
one shard. An empty table gives an empty result. Other columns play no part and are kept by assign_shards().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, store, tidy

LARGE, RESERVE = 1024, 4096
#: Groups that a task packs.
GROUPS = 100_000
#: Groups whose shards may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000
#: Bytes come first in the order of importance; tokens and rows follow.
IMPORTANCE = np.array([2.0, 1.0, 1.0])
SUMS = ("bytes", "tokens", "n_rows")


def measures() -> dict[str, Column]:
    """Of a document: the hash that stands for its group, size in bytes and one more, CRC, tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "group_key": F.xxhash64(text, F.octet_length(text)),
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary")),
        "tokens": F.regexp_count(text, F.lit(r"\S+")).cast("long"),
    }


def pack(share: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A shard for each row of ``share`` (items by dimensions); ``residual`` (shards by dimensions) falls by what is placed.

    Of shards whose bytes have room for an item the one with the highest dot product takes it, else the one with most room.
    """
    placed = np.zeros(len(share), np.int32)
    for i in np.argsort(-share.max(1), kind="stable") if len(share) else ():
        room = residual[:, 0] >= share[i, 0]
        k = placed[i] = int(np.argmax(np.where(room, residual @ (IMPORTANCE * share[i]), -np.inf) if room.any() else residual[:, 0]))
        residual[k] -= share[i]
    return placed


def _even_out(sizes: np.ndarray, placed: np.ndarray, loads: np.ndarray, rounds: int = 2000) -> None:
    """Move or exchange items between the fullest and the emptiest shard while that lowers their difference; ``loads``: all bytes of shards."""
    able = np.ones(len(loads), bool)  # shards whose fullness no move can lower, as with one huge group, are passed over
    for _ in range(rounds if len(sizes) else 0):
        a, b = int(np.where(able, loads, -1).argmax()), int(loads.argmin())
        gap = loads[a] - loads[b]
        if not able.any() or gap <= 1:
            return
        out, back = np.flatnonzero(placed == a), np.flatnonzero(placed == b)
        back = back[np.argsort(sizes[back], kind="stable")]
        options = np.concatenate([[0], sizes[back]])  # 0: nothing comes back
        at = np.clip(np.searchsorted(options, sizes[out] - gap / 2), 1, len(options)) - 1
        at = np.stack([at, np.minimum(at + 1, len(options) - 1)])
        change = np.abs(gap - 2 * (sizes[out] - options[at]))
        if not len(out) or change.min() > 0.99 * gap:  # a huge item would only change places, over and over
            able[a] = False
            continue
        j, i = np.unravel_index(change.argmin(), change.shape)
        delta = sizes[out[i]] - options[at[j, i]]
        placed[out[i]] = b
        if at[j, i]:
            placed[back[at[j, i] - 1]] = a
        loads[a] -= delta
        loads[b] += delta


def _vectors(rows) -> np.ndarray:
    return np.array([[r[k] for k in SUMS] for r in rows], float).reshape(-1, 3)


def _pack_large(large: list, shares: np.ndarray, residual: np.ndarray) -> tuple[list, list]:
    """((group_key, shard) of groups that stay whole, (group_key, cells) of those that are cut)."""
    whole, cut = [], []
    for i in np.argsort(-shares.max(1), kind="stable") if len(large) else ():
        k = int(np.argmax(np.where(residual[:, 0] >= shares[i, 0], residual @ (IMPORTANCE * shares[i]), -np.inf)))
        if shares[i].max() <= 1 and residual[k, 0] >= shares[i, 0]:
            residual[k] -= shares[i]
            whole.append((large[i]["group_key"], k))
        else:
            cut.append((large[i]["group_key"], min(large[i]["n_rows"], int(np.ceil(shares[i].max() / len(residual) * RESERVE)))))
    return whole, cut


def plan(measured: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards of groups: (group_key, cells) of cut groups and (group_key, cell, shard) on the driver's part, both bounded; (group_key, shard) of all others.

    ``cell`` is null for groups that are whole.
    """
    spark = measured.sparkSession
    groups = store(measured.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")))
    total = groups.agg(*[F.sum(k).alias(k) for k in SUMS], F.count("*").alias("groups")).first()
    totals = np.array([total[k] or 0 for k in SUMS], float)
    share_of = lambda rows: _vectors(rows) / np.where(totals > 0, totals, 1) * shards  # noqa: E731  1: the capacity of a shard
    is_large = F.lit(False)
    for k, t in zip(SUMS, totals.tolist(), strict=True):
        is_large = is_large | (F.col(k) > t / LARGE)
    large = sorted(groups.where(is_large).collect())
    residual = np.ones((shards, 3))
    whole, cut = _pack_large(large, share_of(large), residual)
    cut_df = spark.createDataFrame(cut, "group_key long, cells int")
    cells = sorted(_cells(measured.join(F.broadcast(cut_df), "group_key")).groupBy("group_key", "cell").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")).collect()) if cut else []
    of_cells = pack(share_of(cells), residual)

    small = groups.where(~is_large)
    order = F.xxhash64("group_key", F.lit(5))
    reserve = sorted(small.orderBy(order, "group_key").limit(RESERVE).collect())
    rest = small.join(F.broadcast(spark.createDataFrame([(r["group_key"],) for r in reserve], "group_key long")), "group_key", "left_anti")
    room = np.maximum(residual, 0) / np.maximum(np.maximum(residual, 0).sum(0), 1e-300)

    def pack_part(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            keys, order = table.column("group_key").to_numpy(), np.argsort(table.column("group_key").to_numpy(), kind="stable")
            share = np.stack([table.column(k).to_numpy().astype(float) for k in SUMS], 1)[order] / np.where(totals > 0, totals, 1) * shards
            yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(pack(share, room * share.sum(0)))], names=["group_key", "shard"])

    parts = max(1, -(-int(total["groups"] or 0) // GROUPS))
    others = store(rest.repartition(parts, "group_key").mapInArrow(pack_part, "group_key long, shard int"))
    loads = np.zeros((shards, 3))
    for r in others.join(groups, "group_key").groupBy("shard").agg(*[F.sum(k).alias(k) for k in SUMS]).collect():
        loads[r["shard"]] = [r[k] for k in SUMS]
    residual -= loads / np.where(totals > 0, totals, 1) * shards
    of_reserve = pack(share_of(reserve), residual)
    # What the driver has placed may still move: whole groups, cells of cut ones and the reserve.
    by_key = {g["group_key"]: g["bytes"] for g in large}
    loose = np.array([*(by_key[key] for key, _ in whole), *(r["bytes"] for r in cells), *(r["bytes"] for r in reserve)], np.int64)
    placed = np.concatenate([np.array([k for _, k in whole], np.int32), of_cells, of_reserve]).astype(np.int64)
    _even_out(loose, placed, loads[:, 0].astype(np.int64) + np.bincount(placed, loose, shards).astype(np.int64))
    names = [*((key, None) for key, _ in whole), *((r["group_key"], r["cell"]) for r in cells), *((r["group_key"], None) for r in reserve)]
    made = [(*name, int(k)) for name, k in zip(names, placed, strict=True)]
    return cut_df, spark.createDataFrame(made, "group_key long, cell int, shard int"), others


def _cells(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, cells, ...) with their cell, null where cells is null."""
    return rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("cells")).cast("int")).drop("cells")


def place(rows: DataFrame, planned: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``rows`` (doc_id, group_key, ...) with shard. Only rows of groups that tasks packed may be shuffled, by their group, none of which is large."""
    cut, known, others = planned
    known = known.withColumnsRenamed({"group_key": "_group", "cell": "_cell", "shard": "_known"})
    found = _cells(rows.join(F.broadcast(cut), "group_key", "left"))
    found = found.join(F.broadcast(known), (F.col("group_key") == F.col("_group")) & F.col("cell").eqNullSafe(F.col("_cell")), "left").drop("_group", "_cell", "cell")
    if others.count() <= BROADCAST_GROUPS:
        return found.join(F.broadcast(others), "group_key", "left").withColumn("shard", F.coalesce("_known", "shard")).drop("_known")
    return found.where("_known IS NOT NULL").withColumnRenamed("_known", "shard").unionByName(found.where("_known IS NULL").drop("_known").join(others, "group_key"))


@tidy
def shard_table(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    measured = store(documents.select("doc_id", *[c.alias(n) for n, c in measures().items()]))
    placed = place(measured, plan(measured, shards)).select("doc_id", "size", "text_crc32", "shard")

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard, within = batch.column("shard").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for k in range(shards):
                here = np.flatnonzero(shard == k)
                within[here] = seen[k] + np.arange(len(here))
                seen[k] += len(here)
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32())).append_column("within", pa.array(within))

    numbered = store(placed.mapInArrow(number, placed.withColumn("part", F.lit(0)).withColumn("within", F.lit(0).cast("long")).schema))
    counts = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    out = numbered.join(F.broadcast(before), (F.col("part") == F.col("_part")) & (F.col("shard") == F.col("_shard")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def assign_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """``documents`` with a column shard (replaced, if there is one)."""
    columns = [F.col(f"`{c}`") for c in documents.columns if c != "shard"]
    made = measures()
    measured = store(documents.select("doc_id", made["group_key"].alias("group_key"), made["size"].alias("size"), made["tokens"].alias("tokens")))
    rows = documents.select(F.struct(*columns).alias("row"), "doc_id", made["group_key"].alias("group_key"))
    return place(rows, plan(measured, shards)).select("row.*", "shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(read(spark, sf_dir, "documents"))
