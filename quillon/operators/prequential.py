"""Prequential scoring: every row under the bank's posterior of the rows before it, without refitting and without a collect.

Sufficient statistics add, so the statistics before a row are a prefix sum.  The scan has two levels:
rows fall into order-preserving blocks whose sums are one aggregate; what lies before each block is a
running sum over the few blocks of a key; inside a block, rows follow by cumulative sums of arrays.  The posteriors
of all rows of a block are solved together.  A key with very many rows is cut into blocks, keys with few rows share a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import special
from quillon.functions.columns import finite
from quillon.operators import gram
from quillon.operators.ordered import MOST, bucketed
from quillon.sources.shared import written

#: Rows of a block, and rows whose posteriors are solved at a time.
BLOCK_ROWS, AT_ONCE = 65_536, 4096
#: The bucket of the rows that come before all others.
FIRST = -2


def _scores(z: np.ndarray, y: np.ndarray, n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, bank: list[tuple[np.ndarray, float]], prior: gram.Prior, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability transform and log density of each y under the mixture of its row's posteriors."""
    logs, parts = [], []
    shape = prior.shape + n / 2
    for at, log_prior in bank:
        k = len(at)
        precision = prior.precision * np.eye(k) + xx[:, at[:, None], at[None, :]]
        info = prior.precision * prior.mean + xy[:, at]
        rows = z[:, at]
        solved = np.linalg.solve(precision, np.stack((info, rows), axis=-1))
        mean, v = solved[..., 0], solved[..., 1]
        scale = prior.scale + 0.5 * (yy + prior.precision * k * prior.mean**2 - np.einsum("ij,ij->i", mean, info))
        logs.append(log_prior + 0.5 * (k * math.log(prior.precision) - np.linalg.slogdet(precision)[1]) - shape * np.log(scale))
        parts.append((np.einsum("ij,ij->i", rows, mean), np.sqrt(scale / shape * (1 + np.einsum("ij,ij->i", rows, v)))))
    log_w = np.array(logs)
    log_w = log_w - log_w.max(axis=0)
    log_w = log_w - np.log(np.exp(log_w).sum(axis=0))
    df = 2 * shape
    loc, width = (np.array([p[k] for p in parts]) for k in (0, 1))
    pit = (np.exp(log_w) * special.t_cdf_array((y - loc) / width, df[None, :])).sum(axis=0)
    dens = log_w + special.t_logpdf(y, df[None, :], loc, width)
    top = dens.max(axis=0)
    return np.clip(pit, clip, 1 - clip), top + np.log(np.exp(dens - top).sum(axis=0))


def _losses(z: np.ndarray, y: np.ndarray, n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, bank: list[tuple[np.ndarray, float]], prior: gram.Prior, powers: tuple[float, ...]) -> list[np.ndarray]:
    """Expected log loss of each y by a parameter drawn from its row's posterior, for each likelihood power."""
    digamma = np.vectorize(special.digamma, otypes=[float])
    out = []
    for eta in powers:
        shape = prior.shape + eta * n / 2
        logs, losses = [], []
        for at, log_prior in bank:
            k = len(at)
            precision = prior.precision * np.eye(k) + eta * xx[:, at[:, None], at[None, :]]
            info = prior.precision * prior.mean + eta * xy[:, at]
            rows = z[:, at]
            solved = np.linalg.solve(precision, np.stack((info, rows), axis=-1))
            scale = prior.scale + 0.5 * (eta * yy + prior.precision * k * prior.mean**2 - np.einsum("ij,ij->i", solved[..., 0], info))
            logs.append(log_prior + 0.5 * (k * math.log(prior.precision) - np.linalg.slogdet(precision)[1]) - shape * np.log(scale))
            losses.append(0.5 * (math.log(2 * math.pi) + np.log(scale) - digamma(shape) + shape / scale * (y - np.einsum("ij,ij->i", rows, solved[..., 0])) ** 2 + np.einsum("ij,ij->i", rows, solved[..., 1])))
        w = np.exp(np.array(logs) - np.max(logs, axis=0))
        out.append((w * np.array(losses)).sum(axis=0) / w.sum(axis=0))
    return out


def predictive_pits(df: DataFrame, order: Column, ident: str, terms: dict[str, Column], y: Column, bank: list[gram.Structure], prior: gram.Prior, initial: Column | None = None, keys: list[str] | None = None, clip: float = 1e-12, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, order, ident, n_before, pit, log_score) of each row by the posterior of the rows of its key before it.

    order: numeric, nulls first and NaN last; ident breaks ties.  initial: rows that come before all others and get no score.
    Rows with a term or target that is null or not finite count for nothing.  A key's first row is scored by the prior.
    """
    return _scan(df, order, ident, terms, y, bank, initial, keys, block_rows, ["pit", "log_score"], lambda *a: _scores(*a, prior, clip))


def power_losses(df: DataFrame, order: Column, ident: str, terms: dict[str, Column], y: Column, bank: list[gram.Structure], prior: gram.Prior, powers: tuple[float, ...], initial: Column | None = None, keys: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, order, ident, n_before, loss_0, loss_1, ...): each row's expected log loss under every likelihood power, as predictive_pits scores rows."""
    return _scan(df, order, ident, terms, y, bank, initial, keys, block_rows, [f"loss_{k}" for k in range(len(powers))], lambda *a: _losses(*a, prior, powers))


def _scan(df: DataFrame, order: Column, ident: str, terms: dict[str, Column], y: Column, bank: list[gram.Structure], initial: Column | None, keys: list[str] | None, block_rows: int, made: list[str], score: Callable) -> DataFrame:
    """The scan of the module's docstring; score makes the columns `made` of rows, targets and the statistics before each row."""
    keys = keys or []
    names, k = tuple(terms), len(terms)
    if k > gram.WIDE:
        raise ValueError("more terms than one aggregate takes")
    at = [(np.array([names.index(t) for t in b.terms]), math.log(b.prior)) for b in bank]
    zs = [f"_z{j}" for j in range(k)]
    first = F.coalesce(initial, F.lit(False)) if initial is not None else F.lit(False)
    rows = df.select(*keys, F.col(ident), order.cast("double").alias("order"), first.alias("_first"), *[c.cast("double").alias(z) for z, c in zip(zs, terms.values(), strict=True)], y.cast("double").alias("_y"))
    for c in [*zs, "_y"]:
        rows = rows.where(finite(F.col(c)))
    rows = written(rows, "prequential")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    n, hottest = counts[0] or 0, counts[1] or 0
    blocks = min(MOST, max(1, -(-hottest // block_rows)))
    slots = max(1, -(-n // (block_rows * blocks))) if keys else 1
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int") if keys else F.lit(0))
    later = rows.where(~F.col("_first"))
    later = bucketed(later, F.col("order"), blocks, ident) if blocks > 1 else later.withColumn("_bucket", F.lit(0))
    start = rows.where("_first").withColumn("_bucket", F.lit(FIRST))

    sums = gram._sums({z: F.col(z) for z in zs}, F.col("_y"))
    m = len(sums)
    totals = later.unionByName(start.select(later.columns)).groupBy(*keys, "_slot", "_bucket").agg(*[s.alias(f"s{j}") for j, s in enumerate(sums)])
    w = Window.partitionBy(*keys, "_slot").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_slot", "_bucket", F.array(*[F.coalesce(F.sum(f"s{j}").over(w), F.lit(0.0)) for j in range(m)]).alias("before")).where(F.col("_bucket") != FIRST)
    upper = np.triu_indices(k)
    schema = T.StructType([*rows.select(*keys, "order", ident).schema.fields, T.StructField("n_before", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in made]])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if keys:
            codes = pc.fill_null(pa.concat_arrays([_text(t, keys) for t in (left, right)]), "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        else:
            codes = np.zeros(left.num_rows + right.num_rows, np.int64)
        key, of = codes[: left.num_rows], codes[left.num_rows :]
        base = np.zeros((int(codes.max(initial=-1)) + 1, m))
        base[of] = np.array(right.column("before").to_pylist(), float).reshape(len(of), m)
        place = left.column("order").combine_chunks()
        place = np.where(np.asarray(place.is_null()), -np.inf, np.asarray(place.fill_null(0.0)))
        by = left.column(ident).to_numpy()
        turn = np.lexsort((by, place, key))
        left, key = left.take(pa.array(turn)), key[turn]
        z = np.column_stack([left.column(c).to_numpy() for c in zs])
        y = left.column("_y").to_numpy()
        new = np.ones(len(y), bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(new)
        seg = np.cumsum(new) - 1
        out, carry = [], np.zeros(m)
        held = np.zeros((len(lead), m))  # running total where each key's rows begin
        for a in range(0, len(y), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            zz, yy = z[part], y[part]
            each = np.column_stack([np.ones(len(yy)), zz[:, upper[0]] * zz[:, upper[1]], zz * yy[:, None], yy * yy])
            run = carry + np.cumsum(each, axis=0)
            excl = np.vstack((carry[None, :], run[:-1]))
            begins = np.flatnonzero(new[part])
            held[seg[part][begins]] = excl[begins]
            now = excl - held[seg[part]] + base[key[part]]
            carry = run[-1]
            xx = np.zeros((len(yy), k, k))
            xx[:, upper[0], upper[1]] = now[:, 1 : 1 + len(upper[0])]
            xx[:, upper[1], upper[0]] = now[:, 1 : 1 + len(upper[0])]
            out.append((np.rint(now[:, 0]), *score(zz, yy, now[:, 0], xx, now[:, 1 + len(upper[0]) : -1], now[:, -1], at)))
        n_before, *columns = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0)] * (1 + len(made))
        t = left.select([*keys, "order", ident]).append_column("n_before", pa.array(n_before.astype(np.int64)))
        for c, v in zip(made, columns, strict=True):
            t = t.append_column(c, pa.array(v))
        return t

    return later.groupBy("_slot", "_bucket").cogroup(before.groupBy("_slot", "_bucket")).applyInArrow(block, schema)


def _text(t: pa.Table, keys: list[str]) -> pa.Array:
    """The keys of each row as one string; a null differs from any text."""
    parts = [pc.fill_null(pc.binary_join_element_wise("=", t.column(c).cast(pa.string()), ""), "-") for c in keys]
    joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, "\x1f")
    return joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
