"""Distances, kernels and nearest neighbours over vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import removed, written

#: Rows of a block of queries or of the pool.
BLOCK = 16_384


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Mean vector of each key: one aggregate of `size` sums, no explode."""
    return df.groupBy(key).agg(F.array(*[F.avg(F.get(vector, F.lit(k)).cast("double")) for k in range(size)]).alias("center"), F.count(F.lit(1)).alias("n"))


class _Best:
    """The `most` nearest pool rows of some queries so far: flat arrays in order of query, distance and id."""

    def __init__(self, q: np.ndarray, most: int):
        self.q, self.most = q, most
        self.worst = np.full(len(q), np.inf)
        self.i, self.name, self.d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, i: np.ndarray, name: np.ndarray, d2: np.ndarray) -> None:
        i, name, d2 = (np.concatenate(x) for x in ((self.i, i), (self.name, name), (self.d2, d2)))
        order = np.lexsort((name, d2, i))
        i, name, d2 = i[order], name[order], d2[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        on = nth < self.most
        self.i, self.name, self.d2 = i[on], name[on], d2[on]
        full = nth == self.most - 1
        self.worst[i[full]] = d2[full]


def _vectors(t: pa.Table, column: str) -> np.ndarray:
    c = t.column(column).combine_chunks()
    c = c if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks)
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def _compare(q: pa.Table, p: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, pool ids and squared distances of the nearest that each query may have of these pool rows."""
    if not q.num_rows or not p.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    qv, pv = _vectors(q, "v"), _vectors(p, "v")
    qn, turn, after, after_id = (q.column(c).to_numpy() for c in ("id", "turn", "after", "after_id"))
    pn, held = (p.column(c).to_numpy() for c in ("id", "held"))
    out = []
    for a in range(0, len(qv), 1024):
        part = slice(a, a + 1024)
        x, best = qv[part], _Best(qv[part], most)
        for b in range(0, len(pv), 2048):
            y, names = pv[b : b + 2048], pn[b : b + 2048]
            size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
            d = size - 2 * x @ y.T
            # The expansion rounds: all that its error leaves possible is measured by differences.
            slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * size
            free = (qn[part][:, None] != names[None, :]) & (held[b : b + 2048][None, :] > turn[part][:, None])
            upper = np.where(free & (d - slack > after[part][:, None]), d + slack, np.inf)
            bound = best.worst if y.shape[0] <= most else np.minimum(best.worst, np.partition(upper, most - 1, axis=1)[:, most - 1])
            i, j = np.nonzero(free & (d - slack <= bound[:, None]) & (d + slack >= after[part][:, None]))
            for c in range(0, len(i), 16384):
                k, m = i[c : c + 16384], j[c : c + 16384]
                v = ((x[k] - y[m]) ** 2).sum(1)
                on = (v > after[part][k]) | (v == after[part][k]) & (names[m] > after_id[part][k])
                best.add(k[on], names[m[on]], v[on])
        out.append((qn[part][best.i], best.name, best.d2))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_rows(pool: DataFrame, queries: DataFrame, most: int, query_rows: int = BLOCK, pool_rows: int = BLOCK) -> DataFrame:
    """(query_id, pool_id, d2): the `most` nearest pool rows of each query, ties to the smaller id.

    pool: id, v, held; queries: id, v, turn, after, after_id.  Left out are the query's own id, pool rows held
    by an earlier turn, and what isn't farther than (after, after_id).  Queries and pool are dealt to blocks; one
    task compares a block of each, so a task's memory is bounded and nothing passes through the driver.
    """
    n_pool, n_queries = pool.count(), queries.count()
    parts, turns = max(1, -(-n_pool // pool_rows)), max(1, -(-n_queries // query_rows))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = pool.select("id", "v", "held", deal(parts).alias("_p")).select("*", every(turns).alias("_q"))
    q = queries.select("id", "v", "turn", "after", "after_id", deal(turns).alias("_q")).select("*", every(parts).alias("_p"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names, d2 = _compare(left, right, most)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "pool_id": pa.array(names, pa.int64()), "d2": pa.array(d2, pa.float64())})

    met = q.groupBy("_p", "_q").cogroup(p.groupBy("_p", "_q")).applyInArrow(pair, "query_id long, pool_id long, d2 double")
    if parts == 1:
        return met
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "pool_id"))
    return met.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def _sides(pool: DataFrame, queries: DataFrame, ident: str, vector: str, turn: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides as nearest_rows takes them; rows without a vector, or with a null in it, are left out."""
    v = F.col(vector).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    p = pool.where(whole).select(F.col(ident).cast("long").alias("id"), v.alias("v"), F.lit((1 << 63) - 1).alias("held"))
    q = queries.where(whole).select(F.col(ident).cast("long").alias("id"), v.alias("v"), turn.cast("long").alias("turn"), F.lit(-1.0).alias("after"), F.lit(0).cast("long").alias("after_id"))
    return p, q


def nearest(df: DataFrame, ident: str, vector: str, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, nn_id, distance): for each query the nearest other row, ties to the smaller id.  block: rows of one block."""
    p, q = _sides(df, queries, ident, vector, F.lit(0))
    kind = df.schema[ident].dataType
    return nearest_rows(p, q, 1, block, block).select(F.col("query_id").cast(kind).alias("query_id"), F.col("pool_id").cast(kind).alias("nn_id"), F.sqrt("d2").alias("distance"))


def matched(pool: DataFrame, queries: DataFrame, ident: str, vector: str, turn: str | None = None, page: int = 16, block: int = BLOCK) -> DataFrame:
    """(query_id, pool_id, distance): each query's nearest pool row that no query before it took, as taking turns would give.

    turn: a column of distinct integers, the id where None; a query whose pool is used up gives no row.
    Queries propose to their nearest pool row and a row keeps the proposal of the earliest turn.  A refused
    query goes on to its next one.  Since a row's holder only ever gets earlier, what this ends with doesn't depend on
    the order of proposals and is what taking turns gives.  Proposals are made from pages of
    `page` candidates; a query that was refused by all of its page gets the next page, of rows that it may still have.
    """
    spark, made, pages = pool.sparkSession, [], []
    p, q = _sides(pool, queries, ident, vector, F.col(turn or ident))
    kind = pool.schema[ident].dataType
    p, everyone = written(p, "pool", made), written(q, "queries", made)
    waiting, turns = everyone, everyone.select(F.col("id").alias("query_id"), "turn")
    tables: list[str] = []
    choice = None
    while True:
        free = p
        if choice is not None:
            holders = choice.select(F.col("pool_id").alias("id"), F.col("turn").alias("_turn"))
            free = p.join(holders, "id", "left").select("id", "v", F.coalesce("_turn", "held").alias("held"))
        last = written(nearest_rows(free, waiting, page, block, block).join(turns, "query_id"), "candidates", pages)
        if last.isEmpty():
            break
        able = spark.read.schema(last.schema).parquet(*pages)
        while True:
            open_ = able
            if choice is not None:
                held = choice.groupBy("pool_id").agg(F.min("turn").alias("held"))
                open_ = able.join(held, "pool_id", "left").where("held is null or held >= turn")
            old, tables = tables, []
            choice = written(open_.groupBy("query_id", "turn").agg(F.min(F.struct("d2", "pool_id")).alias("c")).select("query_id", "turn", "c.pool_id", "c.d2"), "choices", tables)
            removed(spark, old)
            n, distinct = choice.agg(F.count(F.lit(1)), F.count_distinct("pool_id")).first()
            if n == distinct:
                break
        cursor = able.groupBy(F.col("query_id").alias("id")).agg(F.max(F.struct("d2", "pool_id")).alias("c")).select("id", "c.d2", "c.pool_id")
        left = everyone.join(choice.select(F.col("query_id").alias("id")), "id", "left_anti").join(cursor, "id")
        waiting = written(left.select("id", "v", "turn", F.col("d2").alias("after"), F.col("pool_id").alias("after_id")), "queries", made)
        if waiting.isEmpty():
            break
    if choice is None:
        return q.select(F.col("id").cast(kind).alias("query_id"), F.col("id").cast(kind).alias("pool_id"), F.lit(0.0).alias("distance")).limit(0)
    removed(spark, made + pages)
    return choice.select(F.col("query_id").cast(kind).alias("query_id"), F.col("pool_id").cast(kind).alias("pool_id"), F.sqrt("d2").alias("distance"))


def kernel_table(points: DataFrame, ident: str, vector: str, most: int = 4096) -> DataFrame:
    """(a, b, d2) of all ordered pairs of a small registered design (centers, candidates), which is broadcast; more than `most` points raise."""
    if points.limit(most + 1).count() > most:
        raise ValueError("too many points for a table of all pairs")
    b = points.select(F.col(ident).alias("b"), F.col(vector).alias("_vb"))
    return points.select(F.col(ident).alias("a"), F.col(vector).alias("_va")).join(F.broadcast(b)).select("a", "b", squared_distance(F.col("_va"), F.col("_vb")).alias("d2"))


def standardised_by_targets(points: DataFrame, columns: list[str], target: Column) -> DataFrame:
    """The columns about the targets' means over their deviations; where targets don't vary, over the deviation of all points about these means; where nothing varies, over 1."""
    means = points.agg(*[F.avg(F.when(target, F.col(c))).alias(f"_m_{c}") for c in columns])
    d = points.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    own, pooled = (lambda c: F.sqrt(F.avg(F.when(target, F.col(c) * F.col(c))))), (lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))))
    scales = d.agg(*[F.when(own(c) > 0, own(c)).when(pooled(c) > 0, pooled(c)).otherwise(1.0).alias(f"_s_{c}") for c in columns])
    return d.crossJoin(F.broadcast(scales)).withColumns({c: F.col(c) / F.col(f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def mmd_augmented(pairs: DataFrame, observed: Column, target: Column, bandwidth: float) -> DataFrame:
    """(candidate, current, augmented): biased squared MMD to the target set, now and with each candidate added.

    pairs: kernel_table(); observed and target: predicates on an id column, applied to a and b.
    """
    k = F.exp(-0.5 * F.col("d2") / F.lit(bandwidth))
    p = pairs.withColumn("k", k)
    s = p.agg(F.sum(F.when(F.expr("oa AND ob"), F.col("k"))).alias("oo"), F.sum(F.when(F.expr("oa AND tb"), F.col("k"))).alias("ot"), F.sum(F.when(F.expr("ta AND tb"), F.col("k"))).alias("tt"), F.sqrt(F.sum(F.expr("CASE WHEN oa AND ob THEN 1 ELSE 0 END"))).alias("n"), F.sqrt(F.sum(F.expr("CASE WHEN ta AND tb THEN 1 ELSE 0 END"))).alias("m"))
    c = p.groupBy(F.col("a").alias("candidate")).agg(F.sum(F.when(F.col("ob"), F.col("k"))).alias("co"), F.sum(F.when(F.col("tb"), F.col("k"))).alias("ct"))
    now = F.col("oo") / (F.col("n") * F.col("n")) - 2 * F.col("ot") / (F.col("n") * F.col("m")) + F.col("tt") / (F.col("m") * F.col("m"))
    n1 = F.col("n") + 1
    then = (F.col("oo") + 2 * F.col("co") + 1) / (n1 * n1) - 2 * (F.col("ot") + F.col("ct")) / (n1 * F.col("m")) + F.col("tt") / (F.col("m") * F.col("m"))
    return c.crossJoin(F.broadcast(s)).select("candidate", now.alias("current"), then.alias("augmented"))


def greedy_nearest(pool: np.ndarray, queries: np.ndarray) -> list[int]:
    """Pool index for each query in turn, nearest first, without replacement (a kernel for one small pool; `matched` is the operator)."""
    free = np.ones(len(pool), bool)
    out = []
    for q in queries:
        d = ((pool - q) ** 2).sum(axis=1)
        d[~free] = np.inf
        k = int(d.argmin())
        free[k] = False
        out.append(k)
    return out
