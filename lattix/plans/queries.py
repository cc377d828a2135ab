"""The queries: each operator over array views of the tables, with DuckDB SQL for those that SQL can express.

Views: E embeddings (vec_id, position), EL their labels, V event values, U users of events, O order
prices, P and PS part prices and sizes, C customer balances, G lineitem quantities by supplier and
line number.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lattix as xp

from ..array import Array


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark, sf_dir, table, key, value, dtype, chunks) -> Array:
    return xp.from_table(_table(spark, sf_dir, table).select(F.col(key).alias("_k"), F.col(value).alias("_v")), ["_k"], "_v", dtype=dtype, chunks=chunks)


def E(spark, d) -> Array:
    rows = _table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", "k", F.col("x").cast("double").alias("x"))
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    return xp.from_table(rows, ["vec_id", "k"], "x", (n, 64), "float64", (1000, 16))


def EL(spark, d):
    return _view(spark, d, "embeddings", "vec_id", "label", "int32", 1000)


def V(spark, d):
    return _view(spark, d, "events", "event_id", "value", "float64", 1000)


def U(spark, d):
    return _view(spark, d, "events", "event_id", "user_id", "int64", 1000)


def O(spark, d):  # noqa: E743
    return _view(spark, d, "orders", "o_orderkey", "o_totalprice", "float64", 5000)


def P(spark, d):
    return _view(spark, d, "part", "p_partkey", "p_retailprice", "float64", 500)


def PS(spark, d):
    return _view(spark, d, "part", "p_partkey", "p_size", "int32", 500)


def C(spark, d):
    return _view(spark, d, "customer", "c_custkey", "c_acctbal", "float64", 500)


def G(spark, d) -> Array:
    sums = _table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_linenumber") - 1).cast("long").alias("j")).agg(F.sum("l_quantity").alias("q"))
    n, m = sums.agg(F.max("i") + 1, F.max("j") + 1).first()
    places = spark.range(n).toDF("i").crossJoin(F.broadcast(spark.range(m).toDF("j")))
    full = places.join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("q", F.lit(0.0)).alias("q"))
    return xp.from_table(full, ["i", "j"], "q", (n, m), "float64", (5, 7))


def _over(columns: dict[str, Array]) -> DataFrame:
    """Arrays of one shape as a table: i0, i1, ... and a column for each; what shares a table isn't joined."""
    names = list(columns)
    arrays = [columns[n] for n in names]
    out = xp.array.combine(lambda *cs: F.struct(*[c.alias(n) for n, c in zip(names, cs, strict=True)]), arrays, np.float64)
    return out.base().select(*[c.alias(f"i{i}") for i, c in enumerate(out.coordinates)], out.column.alias("_s")).select(*[f"i{i}" for i in range(out.ndim)], "_s.*")


def _round(c: Column, digits: int) -> Column:
    """round(c, digits), half away from zero, by arithmetic as SQL has it; F.round, many times slower, takes numbers too large for that."""
    scaled = F.abs(c) * 10.0**digits
    whole = F.floor(scaled).cast("double")
    return F.when(scaled < 2.0**52, F.signum(c) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits + 0.0).otherwise(F.round(c, digits))


def _out(x: Array, name: str = "v", digits: int | None = None) -> DataFrame:
    df = x.cells(name)
    for i in range(x.ndim):
        df = df.withColumnRenamed(f"d{i}", f"i{i}")
    return df.withColumn(name, _round(F.col(name), digits) if x.dtype == np.float64 else F.round(name, digits)) if digits is not None else df


def _rounded(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_E = "(SELECT vec_id AS i, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_G = "(SELECT i, j, coalesce(q, 0) AS q FROM (SELECT unnest(range((SELECT max(l_suppkey) + 1 FROM lineitem))) AS i) CROSS JOIN (SELECT unnest(range((SELECT max(l_linenumber) FROM lineitem))) AS j) LEFT JOIN (SELECT l_suppkey AS i, l_linenumber - 1 AS j, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) USING (i, j))"


@_query(f"SELECT j AS i0, round(sum(x), 6) AS v FROM {_E} GROUP BY j")
def sum_axis0(spark, d):
    return _out(xp.sum(E(spark, d), axis=0), digits=6)


@_query("SELECT event_id AS i0, round(value * 2 + 1.5, 6) AS a, round(value - value * value, 6) AS b, round(value / (value * value + 1), 9) AS c, round(-value, 6) AS n FROM events")
def ew_arith(spark, d):
    v = V(spark, d)
    return _rounded(_over({"a": v * 2.0 + 1.5, "b": v - v * v, "c": v / (v * v + 1.0), "n": -v}), 6, ("c",)).withColumn("c", F.round("c", 9))


@_query("SELECT event_id AS i0, round(exp(value / 1000), 9) AS e, round(ln(value * value + 1), 9) AS l, round(sin(value), 9) AS s, round(cos(value), 9) AS c, round(atan(value), 9) AS t, round(sqrt(abs(value)), 9) AS r, round(tanh(value / 100), 9) AS h, round(log2(value * value + 1), 9) AS l2 FROM events")
def ew_math(spark, d):
    v = V(spark, d)
    square = xp.square(v) + 1.0
    return _rounded(_over({"e": xp.exp(v / 1000.0), "l": xp.log(square), "s": xp.sin(v), "c": xp.cos(v), "t": xp.atan(v), "r": xp.sqrt(abs(v)), "h": xp.tanh(v / 100.0), "l2": xp.log2(square)}), 9)


@_query("SELECT event_id AS i0, value > 50 AS g, value <= 10 OR value > 90 AS o, NOT (value < 50) AS n, (value > 20) <> (value > 60) AS x, user_id % 7 = 3 AS q FROM events")
def ew_cmp_logic(spark, d):
    v, u = V(spark, d), U(spark, d)
    return _over({"g": v > 50.0, "o": xp.logical_or(v <= 10.0, v > 90.0), "n": xp.logical_not(v < 50.0), "x": xp.logical_xor(v > 20.0, v > 60.0), "q": u % 7 == 3})


@_query("SELECT event_id AS i0, user_id & 12 AS a, user_id | 5 AS o, xor(user_id, 9) AS x, ~user_id AS n, user_id << 3 AS l, user_id >> 2 AS r FROM events")
def ew_bitwise(spark, d):
    u = U(spark, d)
    return _over({"a": u & 12, "o": u | 5, "x": u ^ 9, "n": ~u, "l": u << 3, "r": u >> 2})


@_query("SELECT event_id AS i0, floor(value) AS f, ceil(value) AS c, trunc(value) AS t, round_even(value * 4, 0) AS r, sign(value - 50) AS s FROM events")
def ew_round_floor(spark, d):
    v = V(spark, d)
    return _over({"f": xp.floor(v), "c": xp.ceil(v), "t": xp.trunc(v), "r": xp.round(v * 4.0), "s": xp.sign(v - 50.0)})


@_query("SELECT o_orderkey AS i0, CAST(floor(o_custkey_ / 7.0) AS BIGINT) AS q, ((o_custkey_ % 7) + 7) % 7 AS m FROM (SELECT o_orderkey, o_custkey - 500 AS o_custkey_ FROM orders)")
def ew_floor_divide(spark, d):
    c = _view(spark, d, "orders", "o_orderkey", "o_custkey", "int64", 5000) - 500
    return _over({"q": c // 7, "m": c % 7})


@_query("SELECT event_id AS i0, greatest(value, user_id) AS a, least(value, user_id) AS i, round(sqrt(value * value + user_id * user_id), 6) AS h, round(atan2(value, user_id + 1), 9) AS t FROM events")
def ew_binary(spark, d):
    v, u = V(spark, d), U(spark, d).astype("float64")
    return _over({"a": xp.maximum(v, u), "i": xp.minimum(v, u), "h": xp.hypot(v, u), "t": xp.atan2(v, u + 1.0)}).select("i0", "a", "i", F.round("h", 6).alias("h"), F.round("t", 9).alias("t"))


@_query("SELECT event_id AS i0, least(greatest(value, 25), 75) AS c, CASE WHEN value > 50 THEN value ELSE -1 END AS w FROM events")
def clip_where(spark, d):
    v = V(spark, d)
    return _over({"c": xp.clip(v, 25.0, 75.0), "w": xp.where(v > 50.0, v, -1.0)})


@_query("SELECT event_id AS i0, CAST(round(value * 100) AS BIGINT) AS v FROM (SELECT event_id, trunc(value * 100) / 100 AS value FROM events)")
def astype_int(spark, d):
    return _out(xp.round(xp.trunc(V(spark, d) * 100.0) / 100.0 * 100.0).astype("int64"))


@_query(f"SELECT (i - 10) // 3 AS i0, j - 4 AS i1, x AS v FROM {_E} WHERE i >= 10 AND i < 200 AND (i - 10) % 3 = 0 AND j >= 4 AND j < 20")
def index_slice(spark, d):
    return _out(E(spark, d)[10:200:3, 4:20])


@_query("SELECT (400 - event_id) // 5 AS i0, value AS v FROM events WHERE event_id <= 400 AND event_id > 100 AND (400 - event_id) % 5 = 0")
def index_negative_step(spark, d):
    return _out(V(spark, d)[400:100:-5])


@_query(f"SELECT p AS i0, j AS i1, x AS v FROM {_E} JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 499)) t(p, r) ON i = r")
def take(spark, d):
    return _out(xp.take(E(spark, d), np.array([7, 3, 7, 499]), axis=0))


@_query(f"SELECT i - 5 AS i0, j AS i1, q AS v FROM {_G} WHERE i >= 5 AND i < 10")
def block_view(spark, d):
    return _out(G(spark, d).blocks[1])


@_query("WITH n AS (SELECT count(*) AS n FROM events) SELECT (n - 1 - event_id + 3) % n AS i0, value AS v FROM events, n")
def flip_roll(spark, d):
    return _out(xp.roll(xp.flip(V(spark, d)), 3))


@_query("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS i0, p_retailprice AS v FROM part UNION ALL SELECT p_partkey + n, -p_retailprice FROM part, n")
def concat(spark, d):
    p = P(spark, d)
    return _out(xp.concat([p, -p]))


@_query("SELECT p_partkey AS i0, 0 AS i1, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, 1, CAST(p_size AS DOUBLE) FROM part")
def stack(spark, d):
    return _out(xp.stack([P(spark, d), PS(spark, d).astype("float64")], axis=1))


@_query(f"SELECT (i * 64 + j) // 128 AS i0, (i * 64 + j) % 128 AS i1, x AS v FROM {_E}")
def reshape_flatten(spark, d):
    return _out(xp.reshape(xp.flatten(E(spark, d)), (-1, 128)))


@_query(f"SELECT j AS i0, i AS i1, x AS v FROM {_E}")
def transpose(spark, d):
    return _out(E(spark, d).T)


@_query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT s_suppkey * 2 + r + t * 2 * n AS i0, s_acctbal AS v FROM supplier, n, (SELECT unnest(range(2)) AS r), (SELECT unnest(range(3)) AS t)")
def repeat_tile(spark, d):
    s = _view(spark, d, "supplier", "s_suppkey", "s_acctbal", "float64", 25)
    return _out(xp.tile(xp.repeat(s, 2), (3,)))


@_query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT s_suppkey + 2 AS i0, s_acctbal AS v FROM supplier UNION ALL SELECT unnest([0, 1]), 99 UNION ALL SELECT n + 2, 99 FROM n")
def pad_constant(spark, d):
    s = _view(spark, d, "supplier", "s_suppkey", "s_acctbal", "float64", 25)
    return _out(xp.pad(s, ((2, 1),), constant_values=99.0))


@_query(f"SELECT i AS i0, j AS i1, CASE WHEN j <= i + 1 THEN q ELSE 0 END AS l, CASE WHEN j >= i - 1 THEN q ELSE 0 END AS u FROM {_G}")
def tril_triu(spark, d):
    g = G(spark, d)
    return _over({"l": xp.tril(g, k=1), "u": xp.triu(g, k=-1)})


@_query("SELECT y AS i0, x AS i1, x * 10 + y AS v FROM (SELECT unnest(range(30)) AS y), (SELECT unnest(range(20)) AS x)")
def meshgrid_xy(spark, d):
    a, b = xp.meshgrid(xp.arange(20), xp.arange(30))
    return _out(a * 10 + b)


@_query("SELECT i AS i0, j AS i1, CASE WHEN j - i = 2 THEN 1.0 ELSE 0.0 END AS e, i * 0.5 AS l, CAST(7 AS BIGINT) AS f FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(15)) AS j)")
def creation(spark, d):
    shape = (20, 15)
    return _over({"e": xp.eye(20, 15, k=2), "l": xp.broadcast_to(xp.reshape(xp.linspace(0.0, 9.5, 20), (20, 1)), shape), "f": xp.full(shape, 7)})


@_query(f"SELECT i AS i0, 0 AS i1, round(avg(x), 9) AS v FROM {_E} GROUP BY i")
def mean_keepdims(spark, d):
    return _out(xp.mean(E(spark, d), axis=1, keepdims=True), digits=9)


@_query(f"SELECT i AS i0, min(x) AS lo, max(x) AS hi FROM {_E} GROUP BY i")
def minmax(spark, d):
    e = E(spark, d)
    return _over({"lo": xp.min(e, axis=1), "hi": xp.max(e, axis=1)})


@_query(f"SELECT j AS i0, round(var_samp(x), 9) AS v, round(stddev_pop(x), 9) AS s FROM {_E} GROUP BY j")
def var_std_corr(spark, d):
    e = E(spark, d)
    return _rounded(_over({"v": xp.var(e, axis=0, correction=1.0), "s": xp.std(e, axis=0)}), 9)


@_query(f"SELECT i AS i0, arg_max(j, x) AS hi, arg_min(j, x) AS lo FROM (SELECT * FROM {_E} ORDER BY i, j) GROUP BY i")
def argmax_argmin(spark, d):
    e = E(spark, d)
    return _over({"hi": xp.argmax(e, axis=1), "lo": xp.argmin(e, axis=1)})


@_query(f"SELECT j AS i0, bool_and(q > 0) AS a, bool_or(q > 1000) AS o FROM {_G} GROUP BY j")
def all_any(spark, d):
    g = G(spark, d)
    return _over({"a": xp.all(g > 0.0, axis=0), "o": xp.any(g > 1000.0, axis=0)})


@_query("SELECT count(*) FILTER (user_id % 5 <> 0) AS v FROM events")
def count_nonzero(spark, d):
    return _out(xp.count_nonzero(U(spark, d) % 5))


@_query("SELECT CAST(sum(user_id % 100) AS BIGINT) AS s, round(avg(user_id % 100), 9) AS m, max(user_id) AS x FROM events")
def sum_mean_int(spark, d):
    u = U(spark, d)
    return _rounded(_over({"s": xp.sum(u % 100), "m": xp.mean(u % 100), "x": xp.max(u)}), 9)


@_query(f"""
SELECT j AS i0, round(product(1 + x / 1000), 9) AS f,
       CAST(CASE WHEN bool_or(i % 1000 = 999) THEN 0 ELSE CAST(round(pow(2, count(*) FILTER (i % 50 = 7))) AS BIGINT) END AS BIGINT) AS n
FROM {_E} GROUP BY j""")
def prod(spark, d):
    """Products over all rows: of floats, and of integers that are mostly 1."""
    e = E(spark, d)
    i = xp.broadcast_to(xp.reshape(xp.arange(e.shape[0]), (-1, 1)), e.shape)
    factors = xp.where(i % 1000 == 999, 0, 1 + (i % 50 == 7).astype("int64")) + (e * 0.0).astype("int64")
    return _rounded(_over({"f": xp.prod(e / 1000.0 + 1.0, axis=0), "n": xp.prod(factors, axis=0)}), 9)


@_query(f"WITH n AS (SELECT i, x FROM {_E} WHERE x > 0) SELECT i AS i0, round(coalesce(sum(x), 0), 9) AS s, round(avg(x), 9) AS m, max(x) AS hi, min(x) AS lo, round(median(x), 9) AS med, round(var_pop(x), 9) AS v FROM n GROUP BY i")
def nan_family(spark, d):
    e = E(spark, d)
    x = xp.where(e > 0.0, e, math.nan)
    return _rounded(_over({"s": xp.nansum(x, axis=1), "m": xp.nanmean(x, axis=1), "hi": xp.nanmax(x, axis=1), "lo": xp.nanmin(x, axis=1), "med": xp.nanmedian(x, axis=1), "v": xp.nanvar(x, axis=1)}), 9, ("hi", "lo"))


@_query(f"SELECT i AS i0, arg_max(j, x) AS hi, arg_min(j, x) AS lo FROM (SELECT * FROM {_E} WHERE x > 0 ORDER BY i, j) GROUP BY i")
def nanargmax_nanargmin(spark, d):
    e = E(spark, d)
    x = xp.where(e > 0.0, e, math.nan)
    return _over({"hi": xp.nanargmax(x, axis=1), "lo": xp.nanargmin(x, axis=1)})


@_query("SELECT event_id AS i0, round(sum(value) OVER (ORDER BY event_id), 4) AS v FROM events")
def cumulative_sum(spark, d):
    return _out(xp.cumulative_sum(V(spark, d)), digits=4)


@_query("SELECT event_id AS i0, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS v FROM events")
def cumulative_sum_int(spark, d):
    return _out(xp.cumulative_sum(U(spark, d)))


@_query(f"SELECT i AS i0, j AS i1, round(product(1 + x / 100) OVER (PARTITION BY i ORDER BY j), 9) AS v FROM {_E}")
def cumulative_prod(spark, d):
    return _out(xp.cumulative_prod(E(spark, d) / 100.0 + 1.0, axis=1), digits=9)


@_query(f"SELECT i AS i0, j AS i1, round(sum(CASE WHEN x > 0 THEN x ELSE 0 END) OVER (PARTITION BY i ORDER BY j), 9) AS v FROM {_E}")
def nancumsum(spark, d):
    e = E(spark, d)
    return _out(xp.nancumsum(xp.where(e > 0.0, e, math.nan), axis=1), digits=9)


@_query("SELECT event_id AS i0, lead(user_id, 2) OVER w - 2 * lead(user_id, 1) OVER w + user_id AS v FROM events WINDOW w AS (ORDER BY event_id) QUALIFY lead(user_id, 2) OVER w IS NOT NULL")
def diff_n2(spark, d):
    return _out(xp.diff(U(spark, d), n=2))


@_query("SELECT p_partkey AS i0, (SELECT count(*) FROM range(0, 3000, 125) r(x) WHERE x < p_retailprice) AS l, (SELECT count(*) FROM range(0, 3000, 125) r(x) WHERE x <= p_retailprice) AS r FROM part")
def searchsorted_left_right(spark, d):
    p, edges = P(spark, d), xp.arange(0.0, 3000.0, 125.0)
    return _over({"l": xp.searchsorted(edges, p, side="left"), "r": xp.searchsorted(edges, p, side="right")})


@_query("SELECT event_id AS i0, user_id IN (SELECT s_suppkey * 3 FROM supplier) AS v FROM events")
def isin(spark, d):
    keys = _view(spark, d, "supplier", "s_suppkey", "s_suppkey", "int64", 25) * 3
    return _out(xp.isin(U(spark, d), keys))


@_query("SELECT g AS i0, round(avg(value), 6) AS v FROM (SELECT user_id % 10 AS g, value FROM events) GROUP BY g")
def groupby_mean(spark, d):
    return _out(xp.groupby_reduction(V(spark, d), U(spark, d) % 10, "mean", axis=0, num_groups=10), digits=6)


@_query(f"SELECT g AS i0, j AS i1, round(sum(x), 6) AS v FROM (SELECT e.j, e.x, m.label AS g FROM {_E} e JOIN embeddings m ON e.i = m.vec_id) GROUP BY ALL UNION ALL SELECT 10, unnest(range(64)), 0")
def groupby_sum_2d(spark, d):
    return _out(xp.groupby_reduction(E(spark, d), EL(spark, d), "sum", axis=0, num_groups=11), digits=6)


@_query("SELECT event_id // 100 AS i0, round(sum(value), 6) AS v FROM events GROUP BY ALL")
def groupby_blockwise_sum(spark, d):
    v = V(spark, d)
    return _out(xp.groupby_blockwise(v, xp.arange(v.shape[0], chunks=1000) // 100, "sum", axis=0, num_groups=-(-v.shape[0] // 100)), digits=6)


@_query(f"SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x), 6) AS v FROM {_E} a JOIN {_E} b USING (i) GROUP BY ALL")
def matmul(spark, d):
    e = E(spark, d)
    return _out(e.T @ e, digits=6)


@_query(f"SELECT a.j AS i0, b.j AS i1, sum(a.q * b.q) AS v FROM {_G} a JOIN {_G} b USING (i) GROUP BY ALL")
def tensordot(spark, d):
    g = G(spark, d)
    return _out(xp.tensordot(g, g, axes=((0,), (0,))))


@_query(f"SELECT i AS i0, round(sum(x * x), 9) AS v FROM {_E} GROUP BY i")
def vecdot(spark, d):
    e = E(spark, d)
    return _out(xp.vecdot(e, e), digits=9)


@_query("SELECT a.s_suppkey AS i0, b.s_suppkey AS i1, round(a.s_acctbal * b.s_acctbal, 6) AS v FROM supplier a, supplier b")
def outer(spark, d):
    s = _view(spark, d, "supplier", "s_suppkey", "s_acctbal", "float64", 25)
    return _out(xp.linalg.outer(s, s), digits=6)


@_query("SELECT event_id AS i0, round((coalesce(lag(value) OVER w, 0) + value + coalesce(lead(value) OVER w, 0)) / 3, 6) AS v FROM events WINDOW w AS (ORDER BY event_id)")
def overlap_mean3(spark, d):
    return _out(xp.map_overlap(lambda b: (b[:-2] + b[1:-1] + b[2:]) / 3, V(spark, d), depth=1, boundary=0.0), digits=6)


@_query("SELECT event_id AS i0, value * 2 + event_id // 1000 AS v FROM events")
def map_blocks_udf(spark, d):
    return _out(xp.map_blocks(lambda b, block_id: b * 2 + block_id[0], V(spark, d)))


@_query(f"SELECT i AS i0, round(avg(x), 9) AS v FROM {_E} GROUP BY i")
def gufunc(spark, d):
    return _out(xp.apply_gufunc(lambda a: a.mean(-1), "(i)->()", E(spark, d).rechunk((500, -1)), output_dtypes="float64"), digits=9)


@_query("SELECT i AS i0, j AS i1, CAST((i // 7) * 4 + j // 10 AS BIGINT) AS v FROM (SELECT unnest(range(30)) AS i), (SELECT unnest(range(40)) AS j)")
def block_ids(spark, d):
    from ..operators.creation import block_ids as ids

    return _out(ids((30, 40), (7, 10)))


_WANG = "SELECT i, xor(xor(s, 61), s >> 16) AS s FROM (SELECT i, i AS s FROM range(10000) r(i))"


@_query(f"""
WITH a AS ({_WANG}), b AS (SELECT i, (s * 9) & 4294967295 AS s FROM a), c AS (SELECT i, xor(s, s >> 4) AS s FROM b),
d AS (SELECT i, (s * 668265261) & 4294967295 AS s FROM c), e AS (SELECT i, xor(s, s >> 15) AS s FROM d)
SELECT i // 100 AS i0, i % 100 AS i1, CAST(CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END AS INTEGER) AS v FROM e""")
def random_integers(spark, d):
    return _out(xp.random.integers((100, 100), chunks=(30, 40)))


@_query("SELECT o_orderkey AS i0, o_totalprice AS v FROM orders")
def rechunk_roundtrip(spark, d):
    """Through storage and back, with other chunks."""
    from ..sources.parquet import checkpoint

    o = O(spark, d).rechunk(2500)
    return _out(xp.from_cells(checkpoint(o.cells()), o.shape, o.dtype, o.chunks).rechunk(10_000))


@_query(f"SELECT i AS i0, j AS i1, round((x - m) / s, 6) AS v FROM (SELECT i, j, x, avg(x) OVER (PARTITION BY j) AS m, stddev_pop(x) OVER (PARTITION BY j) AS s FROM {_E})")
def standardize(spark, d):
    e = E(spark, d)
    return _out((e - xp.mean(e, axis=0)) / xp.std(e, axis=0), digits=6)


@_query("SELECT round(avg(a.value * (a.value + 1)), 6) AS v FROM events a")
def quad_means(spark, d):
    v = V(spark, d)
    return _out(xp.mean(v * (v + 1.0)), digits=6)


@_query()
def random_uniform(spark, d):
    return _out(xp.random.random((200, 50), chunks=(50, 25), seed=42))


@_query(f"WITH m AS (SELECT i, j, x FROM {_E}) SELECT j AS i0, true AS orthonormal, round((SELECT sum(x * x) FROM m), 6) AS squares FROM (SELECT DISTINCT j FROM m)")
def qr_svd(spark, d):
    """How far Q is from orthonormal, and the sum of squared singular values: that of all elements."""
    e = E(spark, d).rechunk((500, -1))
    q, _ = xp.linalg.qr(e)
    squares = xp.sum(xp.square(xp.linalg.svdvals(e)))
    off = xp.max(abs(q.T @ q - xp.eye(64)), axis=0)
    return _over({"off": off, "squares": xp.broadcast_to(squares, off.shape)}).select("i0", (F.col("off") < 1e-8).alias("orthonormal"), F.round("squares", 6).alias("squares"))


@_query(f"SELECT i AS i0, j AS i1, round(x, 6) + 0.0 AS q, round(x, 6) + 0.0 AS s FROM {_E}")
def qr_svd_product(spark, d):
    """Q R, and U S V: the array itself."""
    e = E(spark, d).rechunk((500, -1))
    q, r = xp.linalg.qr(e)
    u, s, v = xp.linalg.svd(e, full_matrices=False)
    whole = _over({"q": q @ r, "s": (u * s) @ v})
    return whole.select("i0", "i1", (F.round("q", 6) + 0.0).alias("q"), (F.round("s", 6) + 0.0).alias("s"))


@_query("SELECT event_id AS i0, nextafter(value, 'infinity'::DOUBLE) AS v FROM events")
def nextafter(spark, d):
    return _out(xp.nextafter(V(spark, d), xp.full((), math.inf)))


@_query("""
SELECT event_id AS i0, round(asin(x), 9) AS asin, round(acos(x), 9) AS acos, round(atanh(x * 0.5), 9) AS atanh, round(asinh(value), 9) AS asinh,
       round(acosh(value * value + 1), 9) AS acosh, round(sinh(x), 9) AS sinh, round(cosh(x), 9) AS cosh, round(tan(x), 9) AS tan
FROM (SELECT event_id, value, value / (abs(value) + 1) AS x FROM events)""")
def ew_trig(spark, d):
    v = V(spark, d)
    x = v / (abs(v) + 1.0)
    return _rounded(_over({"asin": xp.asin(x), "acos": xp.acos(x), "atanh": xp.atanh(x * 0.5), "asinh": xp.asinh(v), "acosh": xp.acosh(v * v + 1.0), "sinh": xp.sinh(x), "cosh": xp.cosh(x), "tan": xp.tan(x)}), 9)


@_query("""
SELECT event_id AS i0, round(exp(x) - 1, 9) AS expm1, round(ln(1 + s), 9) AS log1p, round(log10(s + 1), 9) AS log10, round(ln(exp(x) + exp(0.5)), 9) AS logaddexp,
       round(pow(s + 1, 0.3), 9) AS pow, round(1 / (s + 1), 12) AS reciprocal
FROM (SELECT event_id, value / (abs(value) + 1) AS x, value * value AS s FROM events)""")
def ew_logs(spark, d):
    v = V(spark, d)
    x, s = v / (abs(v) + 1.0), xp.square(v)
    made = _over({"expm1": xp.expm1(x), "log1p": xp.log1p(s), "log10": xp.log10(s + 1.0), "logaddexp": xp.logaddexp(x, 0.5), "pow": xp.pow(s + 1.0, 0.3), "reciprocal": xp.reciprocal(s + 1.0)})
    return _rounded(made, 9, ("reciprocal",)).withColumn("reciprocal", F.round("reciprocal", 12))


@_query("""
SELECT event_id AS i0, CASE WHEN user_id % 2 = 0 THEN -abs(value) ELSE abs(value) END AS copysign, value < 50 AS signbit, value AS positive, value <> 50 AS not_equal, value >= 50 AS greater_equal,
       value > 20 AND value < 80 AS logical_and, user_id % 3 = 0 AND value = 0 AS isnan, user_id % 3 = 0 AND value <> 0 AS isinf, user_id % 3 <> 0 AS isfinite
FROM events""")
def ew_signs(spark, d):
    v, u = V(spark, d), U(spark, d)
    by_zero = v / (u % 3).astype("float64")
    sign = (u % 2 * 2 - 1).astype("float64")
    return _over({
        "copysign": xp.copysign(v, sign), "signbit": xp.signbit(v - 50.0), "positive": xp.positive(v), "not_equal": v != 50.0, "greater_equal": v >= 50.0,
        "logical_and": xp.logical_and(v > 20.0, v < 80.0), "isnan": xp.isnan(by_zero), "isinf": xp.isinf(by_zero), "isfinite": xp.isfinite(by_zero),
    })


@_query("""
SELECT event_id AS i0, round(3 + value, 9) AS radd, round(3 - value, 9) AS rsub, round(3 * value, 9) AS rmul, round(3 / (value * value + 1), 12) AS rtruediv, 100 // (user_id % 7 + 1) AS rfloordiv,
       100 % (user_id % 7 + 1) AS rmod, CAST(pow(2, user_id % 8) AS BIGINT) AS rpow, 12 & user_id AS rand, 5 | user_id AS ror, xor(9, user_id) AS rxor, 1 << (user_id % 8) AS rlshift, 1000 >> (user_id % 8) AS rrshift
FROM (SELECT event_id, value, CAST(user_id AS BIGINT) AS user_id FROM events)""")
def ew_reflected(spark, d):
    v, u = V(spark, d), U(spark, d)
    made = _over({
        "radd": 3.0 + v, "rsub": 3.0 - v, "rmul": 3.0 * v, "rtruediv": 3.0 / (v * v + 1.0), "rfloordiv": 100 // (u % 7 + 1), "rmod": 100 % (u % 7 + 1), "rpow": 2 ** (u % 8),
        "rand": 12 & u, "ror": 5 | u, "rxor": 9 ^ u, "rlshift": 1 << (u % 8), "rrshift": 1000 >> (u % 8),
    })
    return _rounded(made, 9, ("rtruediv",)).withColumn("rtruediv", F.round("rtruediv", 12))


@_query("SELECT event_id AS i0, value AS re, 2 * value AS im, -2 * value AS conj FROM events")
def complex_conj(spark, d):
    z = V(spark, d).astype("complex128") * (1.0 + 2.0j)
    return _over({"re": xp.real(z), "im": xp.imag(z), "conj": xp.imag(xp.conj(z))})


@_query(f"SELECT i AS i0, round(product(CASE WHEN x > 0 THEN 1 + x ELSE 1 END), 9) AS p, round(coalesce(stddev_pop(x) FILTER (x > 0), 'nan'::DOUBLE), 9) AS s FROM {_E} GROUP BY i")
def nan_prod_std(spark, d):
    e = E(spark, d)
    x = xp.where(e > 0.0, e, math.nan)
    return _rounded(_over({"p": xp.nanprod(x + 1.0, axis=1), "s": xp.nanstd(x, axis=1)}), 9)


@_query(f"SELECT i AS i0, j AS i1, round(product(CASE WHEN x > 0 THEN 1 + x / 100 ELSE 1 END) OVER (PARTITION BY i ORDER BY j), 9) AS v FROM {_E}")
def nancumprod(spark, d):
    e = E(spark, d)
    return _out(xp.nancumprod(xp.where(e > 0.0, 1.0 + e / 100.0, math.nan), axis=1), digits=9)


@_query("SELECT event_id AS i0, CAST(pow(3, sum(CASE WHEN event_id % 300 = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id // 3000 ORDER BY event_id)) AS BIGINT) AS v FROM events WHERE event_id < (SELECT count(*) // 3000 * 3000 FROM events) OR (SELECT count(*) FROM events) < 3000")
def cumulative_prod_int(spark, d):
    v = V(spark, d)
    n = v.shape[0] // 3000 * 3000 or v.shape[0]
    factors = 1 + 2 * (xp.arange(n, chunks=250) % 300 == 7).astype("int64") + (v[:n] * 0.0).astype("int64")
    rows = -(-n // 3000)
    return _out(xp.reshape(xp.cumulative_prod(xp.reshape(factors, (rows, n // rows)), axis=1), (n,)))


@_query(f"SELECT j AS i0, 0 AS i1, i AS i2, x AS a, x AS m, x AS s FROM {_E}")
def axes_moved(spark, d):
    e = E(spark, d)
    a = xp.expand_dims(xp.permute_dims(e, (1, 0)), axis=1)
    m = xp.moveaxis(xp.expand_dims(e, axis=2), (0, 2), (2, 1))
    s = xp.expand_dims(xp.squeeze(xp.expand_dims(xp.matrix_transpose(e), axis=0), axis=0), axis=1)
    return _over({"a": a, "m": m, "s": s})


@_query(f"SELECT i AS i0, max(x) FILTER (j = 3) AS a, max(x) FILTER (j = 40) AS b FROM {_E} GROUP BY i")
def unstack(spark, d):
    columns = xp.unstack(E(spark, d), axis=1)
    return _over({"a": columns[3], "b": columns[40]})


@_query(f"SELECT i AS i0, j AS i1, q AS a, i * 2 AS b FROM {_G}")
def broadcast_arrays(spark, d):
    g = G(spark, d)
    a, b = xp.broadcast_arrays(g, xp.reshape(xp.arange(g.shape[0]) * 2, (-1, 1)))
    assert xp.broadcast_shapes(g.shape, (g.shape[0], 1)) == a.shape == b.shape
    return _over({"a": a, "b": b})


@_query(f"SELECT i AS i0, j AS i1, 0.0 AS z, 1.0 AS o, 0 AS zl, 1 AS ol, 5 AS fl, 0.0 AS e, 0.0 AS el, i * 10 + j AS l, j * 0.25 + 1 AS r FROM {_G} WHERE i < 4 AND j < 7")
def creation_like(spark, d):
    g, shape = G(spark, d), (4, 7)
    i = xp.zeros(shape, dtype="int32")
    literal = xp.asarray(np.arange(4)[:, None] * 10 + np.arange(7))
    assert g.shape[1] == 7
    made = {
        "z": xp.zeros(shape), "o": xp.ones(shape), "zl": xp.zeros_like(i), "ol": xp.ones_like(i), "fl": xp.full_like(i, 5), "e": xp.empty(shape), "el": xp.empty_like(xp.empty_virtual_array(shape)),
        "l": literal, "r": xp.broadcast_to(xp.arange(1.0, 2.75, 0.25), shape),
    }
    return _over(made)


@_query("""
SELECT * FROM (VALUES ('bool + int8', 'int8'), ('int32 + int64', 'int64'), ('uint8 + int8', 'int16'), ('int64 + float32', 'float64'), ('float32 + complex64', 'complex64'),
('can int32 int64', 'True'), ('can float64 float32', 'False'), ('int32 real', 'False'), ('int32 integral', 'True'), ('max int32', '2147483647'), ('min int16', '-32768'), ('bits float32', '32'),
('version', '2025.12'), ('device', 'cpu'), ('int kind', 'int16,int32,int64,int8'), ('default real', 'float64')) t(fact, value)""")
def dtype_facts(spark, d):
    info = xp.__array_namespace_info__()
    add = lambda a, b: str(xp.result_type(xp.zeros(1, dtype=a), xp.zeros(1, dtype=b)))
    facts = {f"{a} + {b}": add(a, b) for a, b in (("bool", "int8"), ("int32", "int64"), ("uint8", "int8"), ("int64", "float32"), ("float32", "complex64"))}
    facts |= {"can int32 int64": xp.can_cast(xp.int32, xp.int64), "can float64 float32": xp.can_cast(xp.float64, xp.float32), "int32 real": xp.isdtype(xp.int32, "real floating"), "int32 integral": xp.isdtype(xp.int32, "integral")}
    facts |= {"max int32": xp.iinfo(xp.int32).max, "min int16": xp.iinfo(xp.int16).min, "bits float32": xp.finfo(xp.float32).bits, "version": xp.__array_api_version__, "device": info.default_device()}
    facts |= {"int kind": ",".join(sorted(info.dtypes(kind="signed integer"))), "default real": str(info.default_dtypes()["real floating"])}
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string")


@_query("SELECT max(value) > 0 AS b, count(*) AS i, CAST(count(*) AS DOUBLE) AS f, CAST(count(*) AS BIGINT) + 1 AS n, round(sum(value), 4) AS c FROM events")
def scalars(spark, d):
    """0-d arrays as Python values."""
    v = V(spark, d)
    count = xp.count_nonzero(v == v)
    z = complex(xp.sum(v).astype("complex128"))
    row = (bool(xp.max(v) > 0.0), int(count), float(count), int(range(10**12)[count]) + 1, z.real)
    return spark.createDataFrame([row], "b boolean, i long, f double, n long, c double").withColumn("c", F.round("c", 4))


@_query("SELECT event_id AS i0, value AS a, value + 1 AS b FROM events")
def chunks_changed(spark, d):
    """Arrays whose chunks are split, merged and unified keep their elements."""
    v = V(spark, d)
    merged = xp.merge_chunks(v, (2000,))
    a, b = xp.unify_chunks(merged, (v + 1.0).rechunk(500))
    assert a.chunks == b.chunks and xp.reshape_chunks(v, v.shape, v.chunks).shape == v.shape
    return _over({"a": a, "b": b})


@_query(f"SELECT j AS i0, round(sum(x * (i + 1)), 4) AS v FROM {_E} GROUP BY j")
def rmatmul(spark, d):
    e = E(spark, d)
    weights = xp.astype(xp.arange(e.shape[0]) + 1, "float64")
    return _out(e.__rmatmul__(weights), digits=4)


@_query(f"SELECT a.i AS i0, b.i AS i1, round(sum(a.x * b.x), 6) + 0.0 AS v FROM {_E} a JOIN {_E} b USING (j) GROUP BY ALL")
def matmul_wide(spark, d):
    """Many blocks in each result axis."""
    e = E(spark, d).rechunk((100, 16))
    return _out(e @ e.T, digits=6).withColumn("v", F.col("v") + 0.0)


@_query(f"SELECT i AS i0, round(avg(x), 9) AS m, max(x) AS hi FROM {_E} GROUP BY i")
def reduction(spark, d):
    """A mean by parts of total and count, and a maximum, both by rounds over blocks."""
    e = E(spark, d)
    total = lambda a, axis, keepdims: {"n": np.ones_like(a).sum(axis=axis, keepdims=keepdims), "t": a.sum(axis=axis, keepdims=keepdims)}
    add = lambda p, axis, keepdims: {k: v.sum(axis=axis, keepdims=keepdims) for k, v in p.items()}
    mean = xp.reduction(e, 1, total, add, "float64", aggregate=lambda p: p["t"] / p["n"], split_every=2)
    return _over({"m": mean, "hi": xp.reduction(e, (1,), np.max, np.max, "float64")}).withColumn("m", F.round("m", 9))


@_query(f"SELECT i AS i0, j AS i1, x + 1 AS a, x > 0 AS b FROM {_E}")
def multiple_outputs(spark, d):
    e = E(spark, d)
    a, b = xp.map_blocks_multiple_outputs(lambda x: (x + 1, x > 0), e, shapes=[e.shape] * 2, dtypes=["float64", "bool"], chunkss=[e.chunks] * 2)
    return _over({"a": a, "b": b})


@_query("WITH n AS (SELECT count(*) // 500 AS n FROM events) SELECT (n - 1 - event_id // 500) * 500 + event_id % 500 AS i0, value AS v FROM events, n WHERE event_id < n * 500")
def map_selection(spark, d):
    """Blocks of 500 in reverse order."""
    v = V(spark, d)
    n = v.shape[0] // 500
    return _out(xp.map_selection(lambda b: b, lambda block: (slice((n - 1 - block[0]) * 500, (n - block[0]) * 500),), v, (n * 500,), "float64", (500,)))


@_query("SELECT event_id // 1000 AS i0, round(sum(value), 6) AS v FROM events GROUP BY ALL")
def general_blockwise(spark, d):
    """Each block of the result from a list of blocks of 250."""
    v = V(spark, d).rechunk(250)
    n = -(-v.shape[0] // 1000)
    key = lambda block: [[(0, (b,)) for b in range(4 * block[0], min(4 * block[0] + 4, v.numblocks[0]))]]
    (out,) = xp.general_blockwise(lambda parts: np.array([sum(p.sum() for p in parts)]), key, v, shapes=[(n,)], dtypes=["float64"], chunkss=[(1,)])
    return _out(out, digits=6)


@_query(f"SELECT i AS i0, j AS i1, round(x * 2 + i, 6) AS v FROM {_E}")
def blockwise(spark, d):
    e = E(spark, d).rechunk((250, 16))
    return _out(xp.blockwise(lambda a, b: a * 2 + b[:, None], "ij", e, "ij", xp.arange(e.shape[0], chunks=250), "i", dtype="float64"), digits=6)


@_query("SELECT event_id AS i0, max(value) OVER (ORDER BY event_id) AS v FROM events")
def scan_max(spark, d):
    return _out(xp.scan(V(spark, d), "max", axis=0))


@_query("SELECT g AS i0, CAST(max(user_id) AS BIGINT) AS v FROM (SELECT event_id % 16 AS g, user_id FROM events) GROUP BY g")
def groupby_max(spark, d):
    u = U(spark, d)
    return _out(xp.groupby_reduction(u, xp.arange(u.shape[0]) % 16, "max", axis=0, num_groups=16))


@_query("SELECT g AS i0, round(avg(value), 6) AS v FROM (SELECT event_id % 16 AS g, value FROM events) GROUP BY g")
def groupby_user(spark, d):
    """A user's aggregation: partial results by block, then combined."""
    v = V(spark, d)
    mean = xp.Aggregation(func=lambda a: (a.sum(), len(a)), combine=lambda p: p.sum(0), finish=lambda p: p[0] / p[1], width=2)
    return _out(xp.groupby_reduction(v, xp.arange(v.shape[0]) % 16, mean, axis=0, num_groups=16), digits=6)


@_query("SELECT o_orderkey AS i0, (SELECT count(*) FROM orders b WHERE b.o_orderkey * 37.5 < a.o_totalprice) AS v FROM orders a")
def searchsorted_blocks(spark, d):
    """A sorted array in several blocks, as if it were too large for one."""
    from ..operators import searching

    o = O(spark, d)
    edges = xp.arange(o.shape[0], chunks=1000).astype("float64") * 37.5 + o * 0.0
    return _out(searching._search_blocks(edges, o, "left"))


def _stored(spark, name: str) -> str:
    import uuid

    from ..sources.parquet import scratch_folder

    return f"{scratch_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query(f"SELECT i AS i0, j AS i1, x AS p, x AS z, x * 2 AS t FROM {_E}")
def storage_roundtrip(spark, d):
    """Parquet, Zarr and a transaction of two targets, read again."""
    e = E(spark, d)
    a, b, c = _stored(spark, "array"), _stored(spark, "array") + ".zarr", _stored(spark, "array")
    xp.store([e, e], [a, b])
    xp.store_transaction([e * 2.0], [c])
    kept = xp.resume(e, a)
    return _over({"p": kept, "z": xp.from_zarr(b), "t": xp.from_parquet(c)})


@_query("SELECT event_id AS i0, value AS v FROM events WHERE event_id >= 1000 AND event_id < 3000")
def storage_slice(spark, d):
    """A part of a stored array: the folders of its blocks."""
    path = _stored(spark, "array")
    xp.to_parquet(V(spark, d), path)
    out = _out(xp.from_parquet(path)[1000:3000])
    return out.withColumn("i0", F.col("i0") + 1000)


@_query(f"SELECT i AS i0, j AS i1, x AS v FROM {_E}")
def from_array(spark, d):
    """A large NumPy array, sliced by the tasks that need it."""
    return _out(xp.from_array(E(spark, d).compute(), chunks=(500, 64)))


@_query("SELECT event_id AS i0, 1.0 AS v FROM events")
def complex_parts(spark, d):
    """exp(i x) has modulus 1."""
    v = V(spark, d).astype("complex128")
    return _out(abs(xp.exp(v * 1j)), digits=9)
