"""Certificates over the open grammar: every polynomial class against a table, and a bound for all that was not listed.

A class is a polynomial with the prior mass of its expressions.  What its evidence asks of the table are moments, so one
aggregate over the rows serves all classes, whose evidences are then Columns over a table of classes.  Kernel
discrepancies depend on where the responses stand; they take a registered grid of bounded size instead.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import certify, discrepancy
from quillon.operators.gram import Prior
from quillon.operators.grammar import Grammar

#: Rows of a registered grid at most.
GRID = 512
CLASSES = "class_id string, size int, multiplicity long, mass double, terms array<struct<code:int,powers:array<int>,coefficient:double>>"


def degree(most: int) -> int:
    """The largest total degree of an expression of a size."""
    return (most + 1) // 2


def classes(spark: SparkSession, g: Grammar, most: int) -> DataFrame:
    """(class_id, size, multiplicity, mass, terms) of the polynomial classes of each size; a term's code is its powers in a base that products don't overflow."""
    base = 2 * degree(most) + 1
    rows = []
    for n in range(1, most + 1):
        for key, m in g.shell(n).items():
            terms = [(sum(p * base**k for k, p in enumerate(powers)), list(powers), float(c)) for powers, c in key if c]
            rows.append((hashlib.sha256(repr(key).encode()).hexdigest(), n, m, m * g.prior(n), terms))
    return spark.createDataFrame(rows, CLASSES)


@dataclass(frozen=True)
class Moments:
    """Weighted sums of a table: n, y'y, monomials by code (to twice the degree) and their products with y (to the degree)."""

    n: float
    yy: float
    plain: tuple[float, ...]
    with_y: tuple[float, ...]


def moments(df: DataFrame, xs: list[Column], y: Column, most: int, power: Column | None = None) -> Moments:
    """One aggregate; power: of each row's likelihood, 1 where None."""
    d, top = len(xs), degree(most)
    base = 2 * top + 1
    w = power.cast("double") if power is not None else F.lit(1.0)

    def monomial(powers: tuple[int, ...]) -> Column:
        return reduce(lambda a, b: a * b, [x for x, p in zip(xs, powers, strict=True) for _ in range(p)], w)

    kinds = {sum(p * base**k for k, p in enumerate(powers)): powers for powers in itertools.product(range(base), repeat=d) if sum(powers) <= 2 * top}
    cols = [F.sum(w).alias("n"), F.sum(w * y * y).alias("yy")]
    cols += [F.sum(monomial(p)).alias(f"s{c}") for c, p in kinds.items()] + [F.sum(monomial(p) * y).alias(f"t{c}") for c, p in kinds.items() if sum(p) <= top]
    r = df.agg(*cols).first()
    held = r.asDict()
    size = base**d
    return Moments(float(r.n or 0.0), float(r.yy or 0.0), *(tuple(float(held.get(f"{k}{c}") or 0.0) for c in range(size)) for k in ("s", "t")))


def log_marginal(terms: Column, m: Moments, prior: Prior) -> Column:
    """Log evidence of the responses under an amplitude times a polynomial, from moments."""
    s, t = (F.array(*map(F.lit, v)) for v in (m.plain, m.with_y))
    zero = F.lit(0.0)
    square = F.aggregate(F.transform(terms, lambda a: F.aggregate(F.transform(terms, lambda b: a["coefficient"] * b["coefficient"] * F.get(s, a["code"] + b["code"])), zero, lambda u, v: u + v)), zero, lambda u, v: u + v)
    cross = F.aggregate(F.transform(terms, lambda a: a["coefficient"] * F.get(t, a["code"])), zero, lambda u, v: u + v)
    precision = F.lit(prior.precision) + square
    info = cross + prior.precision * prior.mean
    shape = prior.shape + m.n / 2
    scale = prior.scale + 0.5 * (m.yy + prior.precision * prior.mean**2 - info * info / precision)
    flat = -m.n / 2 * math.log(2 * math.pi) + 0.5 * math.log(prior.precision) + prior.shape * math.log(prior.scale) + math.lgamma(shape) - math.lgamma(prior.shape)
    return F.lit(flat) - 0.5 * F.log(precision) - shape * F.log(scale)


@dataclass(frozen=True)
class Kernel:
    """A discrepancy that may be there: its prior share among kernels, its squared length scale."""

    name: str
    share: float
    lengthscale2: float


def grid_log_marginal(design: np.ndarray, y: np.ndarray, powers: np.ndarray, precisions: np.ndarray, prior: Prior) -> float:
    """Log evidence of weighted responses under a design of small arrays."""
    n = float(powers.sum())
    p = np.diag(precisions) + (design * powers[:, None]).T @ design
    info = (design * powers[:, None]).T @ y
    info[0] += prior.precision * prior.mean
    shape = prior.shape + n / 2
    scale = prior.scale + 0.5 * (float(powers @ (y * y)) + prior.precision * prior.mean**2 - float(info @ np.linalg.solve(p, info)))
    return -n / 2 * math.log(2 * math.pi) + 0.5 * (float(np.log(precisions).sum()) - np.linalg.slogdet(p)[1]) + prior.shape * math.log(prior.scale) - shape * math.log(scale) + math.lgamma(shape) - math.lgamma(prior.shape)


def with_components(table: DataFrame, x: np.ndarray, y: np.ndarray, prior: Prior, kernels: list[Kernel], spike: float, precision: float, powers: np.ndarray | None = None, joint: bool = False) -> DataFrame:
    """The classes with `log_marginal` mixed over no discrepancy (probability spike) and kernels projected off the class's function, on a registered grid.

    precision: of the discrepancy's coefficients.  joint: a row for each class and component instead, `component` (none for no discrepancy)
    and a log_marginal that holds the component's prior probability.
    """
    x, y = np.atleast_2d(np.asarray(x, float).T).T, np.asarray(y, float)
    powers = np.ones(len(y)) if powers is None else np.asarray(powers, float)
    if len(y) > GRID or len(x) != len(y) or len(powers) != len(y) or not (np.isfinite(x).all() and np.isfinite(y).all()) or (powers < 0).any():
        raise ValueError("a grid of finite, aligned rows, within the bound, is needed")
    if kernels and abs(sum(k.share for k in kernels) - 1) > 1e-12:
        raise ValueError("shares of kernels must sum to 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, names = [], ["none", *[k.name for k in kernels]]
            for terms in b.column("terms").to_pylist():
                f = sum((t["coefficient"] * np.prod(x ** np.array(t["powers"]), axis=1) for t in terms), np.zeros(len(y)))[:, None]
                logs = [math.log(spike if kernels else 1.0) + grid_log_marginal(f, y, powers, np.array([prior.precision]), prior)]
                for k in kernels:
                    basis = discrepancy.projected_basis(x, f, 1.0, k.lengthscale2)
                    precisions = np.concatenate(([prior.precision], np.full(basis.shape[1], precision)))
                    logs.append(math.log((1 - spike) * k.share) + grid_log_marginal(np.column_stack((f, basis)), y, powers, precisions, prior))
                out += [float(v) for v in logs] if joint else [float(np.logaddexp.reduce(logs))]
            if joint:
                at = pa.array(np.repeat(np.arange(b.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(names * b.num_rows), pa.array(out, pa.float64())], names=[*b.schema.names, "component", "log_marginal"])
                continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "log_marginal"])

    return table.drop("log_marginal", "component").mapInArrow(run, CLASSES + (", component string" if joint else "") + ", log_marginal double")


def certificate(table: DataFrame, g: Grammar, n: float, prior: Prior, least: int, most: int, tolerance: float = 0.01) -> DataFrame:
    """By largest listed size: log evidence of what is listed, upper bounds of the rest and of its posterior probability, and what a larger list shows of it.

    table: classes with log_marginal, to size `most`; n: the sum of likelihood powers.  The rest has the grammar's tail mass and
    at most the uniform bound.  minorisation: the least probability with which a draw from the prior, accepted as a Metropolis
    proposal, meets the posterior; mixing_steps brings the distance under the tolerance.  beyond: what classes up to `most` that aren't listed are sure to hold,
    never over the bound.  violation: by how much a class exceeds the uniform bound, 0 if it holds.
    """
    bound = certify.uniform_log_bound(n, prior)
    d = table.select(F.explode(F.sequence(F.lit(least), F.lit(most))).alias("most"), "size", "class_id", "mass", "log_marginal").withColumn("_l", F.log("mass") + F.col("log_marginal"))
    top = d.agg(F.max("_l").alias("_top"))
    d = d.crossJoin(F.broadcast(top)).withColumn("_e", F.exp(F.col("_l") - F.col("_top")))
    listed = F.col("size") <= F.col("most")
    s = d.groupBy("most").agg(F.max("_top").alias("_top"), F.sum(F.when(listed, F.col("_e"))).alias("_core"), F.sum("_e").alias("_all"), F.count_distinct(F.when(listed, F.col("class_id"))).alias("classes"), F.max(F.when(listed, F.col("log_marginal"))).alias("largest"))
    s = s.withColumn("log_core", F.col("_top") + F.log("_core")).withColumn("log_tail", F.col("most") * math.log(g.rho) + bound)
    last = F.lit(most * math.log(g.rho) + bound)
    ratio = F.exp(F.col("log_tail") - F.col("log_core"))
    s = s.withColumn("tail_probability", ratio / (1 + ratio)).withColumn("minorisation", 1 / (1 + ratio))
    steps = F.when(F.col("tail_probability") <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(math.log(tolerance) / F.log(F.col("tail_probability")))))
    beyond = (F.col("_all") - F.col("_core")) / (F.col("_all") + F.exp(last - F.col("_top")))
    return s.select("most", "classes", "log_core", "log_tail", "tail_probability", "minorisation", steps.cast("long").alias("mixing_steps"), beyond.alias("beyond"), (beyond <= F.col("tail_probability") + 1e-12).alias("inside"), F.greatest(F.lit(0.0), F.col("largest") - bound).alias("violation"))


def class_posterior(table: DataFrame) -> DataFrame:
    """(class_id, mass, probability): listed classes by their share of the listed evidence, sizes joined; by component too where the table has them."""
    keys = ["class_id", "component"] if "component" in table.columns else ["class_id"]
    c = table.groupBy(*keys).agg(F.sum("mass").alias("mass"), F.max("log_marginal").alias("log_marginal"))
    top = c.agg(F.max(F.log("mass") + F.col("log_marginal")).alias("_top"))
    c = c.crossJoin(F.broadcast(top)).withColumn("_e", F.exp(F.log("mass") + F.col("log_marginal") - F.col("_top")))
    total = c.agg(F.sum("_e").alias("_all"))
    return c.crossJoin(F.broadcast(total)).select(*keys, "mass", (F.col("_e") / F.col("_all")).alias("probability"))
