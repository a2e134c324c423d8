"""Closed bounds on evidence, bounds on class masses from interval records, and gates over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import enclosure
from quillon.operators import gram
from quillon.operators.gram import Prior, Stats, Structure


class ClassProjector(Protocol):
    """What maps states to classes: rows (state, class_id, mass) of a population."""

    def project(self, states: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class MappedClasses:
    """Classes by a table (state, class_id); a state that it doesn't hold is in no class."""

    mapping: DataFrame

    def project(self, states: DataFrame) -> DataFrame:
        return states.join(self.mapping.select("state", "class_id"), "state", "left").select("state", "class_id", "mass")


@dataclass(frozen=True)
class BinnedClasses:
    """Classes by the bins of a state's coordinates (state, mass, coordinate, lower, upper); null where an interval crosses an edge."""

    edges: tuple[float, ...]

    def project(self, states: DataFrame) -> DataFrame:
        lo, hi = binned(F.col("lower"), F.col("upper"), list(self.edges))
        place = F.struct("coordinate", lo.alias("bin"))
        d = states.groupBy("state").agg(F.max("mass").alias("mass"), F.bool_and(lo == hi).alias("_sure"), F.array_sort(F.collect_list(place)).alias("_bins"))
        return d.select("state", F.when(F.col("_sure"), F.array_join(F.transform("_bins", lambda b: b["bin"].cast("string")), ",")).alias("class_id"), "mass")


def class_masses(projector: ClassProjector, states: DataFrame) -> DataFrame:
    """(class_id, mass) of a population; the mass in no class has a null id."""
    return projector.project(states).groupBy("class_id").agg(F.sum("mass").alias("mass"))


class CdfOracle(Protocol):
    """What encloses predictive probabilities: intervals that hold P(Y <= y) at each design row."""

    def cdf(self, x: np.ndarray, y: np.ndarray) -> enclosure.Interval: ...


@dataclass(frozen=True)
class PosteriorCdf:
    """Enclosures under a bank's posterior, whose parameters are taken as they are."""

    posts: list[gram.Posterior]

    def cdf(self, x: np.ndarray, y: np.ndarray) -> enclosure.Interval:
        of, parts, total = enclosure.Interval.of, [], enclosure.Interval.of(0.0)
        for p in self.posts:
            df, loc, scale = p.predict(gram.design_rows(x, p.structure.terms))
            parts.append(enclosure.t_cdf((of(y) - of(loc)) / of(scale), of(np.full(len(y), float(df)))))
            total = total + p.probability
        return enclosure.mixture_cdf([of(p.probability) / total for p in self.posts], parts)


def enclosed_t_cdf(df: DataFrame, z: Column, nu: Column) -> DataFrame:
    """Adds `lower` and `upper`, which enclose Student's t distribution function; null where an argument isn't finite or degrees of freedom aren't positive."""
    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zz, nn = (np.asarray(b.column(c).fill_null(np.nan)) for c in ("_z", "_nu"))
            good = np.isfinite(zz) & np.isfinite(nn) & (nn > 0)
            lo, hi = (np.full(len(zz), np.nan) for _ in range(2))
            if good.any():
                got = enclosure.t_cdf(zz[good], nn[good])
                lo[good], hi[good] = got.lo, got.hi
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(v, mask=~good) for v in (lo, hi))], names=[*keep, "lower", "upper"])

    return df.withColumns({"_z": z.cast("double"), "_nu": nu.cast("double")}).mapInArrow(run, schema)


def uniform_log_bound(n: float, prior: Prior) -> float:
    """Upper bound of the log evidence of n (weighted) responses under every design and every response."""
    if not (math.isfinite(n) and n >= 0):
        raise ValueError("the number of responses must be finite and not negative")
    return math.lgamma(prior.shape + n / 2) - math.lgamma(prior.shape) - n / 2 * (math.log(2 * math.pi) + math.log(prior.scale))


@dataclass(frozen=True)
class EnergyBound:
    energy: float
    shape: float
    t: float
    log_upper: float
    flat: float

    @property
    def margin(self) -> float:
        """By how much it is sharper than the uniform bound."""
        return max(0.0, self.flat - self.log_upper)


def energy_log_bound(y: np.ndarray, powers: np.ndarray, prior: Prior) -> EnergyBound:
    """The uniform bound sharpened by the energy of the responses: the supremum over covariances of the identity or more, at t = min(1, b / ((a - 1/2) e))."""
    y, powers = np.asarray(y, float).ravel(), np.asarray(powers, float).ravel()
    if not len(y) or len(y) != len(powers) or not np.isfinite([y, powers]).all() or (powers < 0).any():
        raise ValueError("responses and powers must be finite and aligned, powers not negative")
    n, energy = math.fsum(powers), math.fsum(powers * y * y)
    shape = prior.shape + n / 2
    if shape <= 0.5:
        raise ValueError("the posterior shape must be over 1/2")
    t = 1.0 if energy == 0 else min(1.0, prior.scale / ((shape - 0.5) * energy))
    head = -n / 2 * math.log(2 * math.pi) + math.lgamma(shape) - math.lgamma(prior.shape) + prior.shape * math.log(prior.scale)
    upper, flat = head + 0.5 * math.log(t) - shape * math.log(prior.scale + 0.5 * energy * t), uniform_log_bound(n, prior)
    if upper > flat + 64 * np.finfo(float).eps * max(1.0, abs(upper), abs(flat)):
        raise ArithmeticError("the sharper bound is over the flat one")
    return EnergyBound(energy, shape, t, upper, flat)


def bridge_relative_ess(core: Callable[[np.ndarray], float], tail_mass: float, y: np.ndarray, index: int, before: float, after: float, prior: Prior) -> float:
    """Lower bound of the relative effective sample size when one response's power goes from `before` to `after`.

    core: log evidence of the enumerated part at given powers; the rest has prior mass tail_mass and is bounded by the uniform bound.
    """
    if not 0 <= index < len(y) or not 0 <= before < after <= 1:
        raise ValueError("powers must grow inside [0, 1] at an index of y")

    def powers(beta: float) -> np.ndarray:
        out = np.zeros(len(y))
        out[:index], out[index] = 1.0, beta
        return out

    def upper(beta: float) -> float:
        p = powers(beta)
        return float(np.logaddexp(core(p), math.log(tail_mass) + uniform_log_bound(float(p.sum()), prior))) if tail_mass > 0 else core(p)

    return min(1.0, math.exp(2 * core(powers(after)) - upper(before) - upper(2 * after - before)))


def dependency_gate(checks: dict[str, tuple[float, float]], needs: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """For each check (value, most): `pass`, `fail`, or `blocked` where something that it needs doesn't pass."""
    out: dict[str, str] = {}

    def judge(name: str, path: tuple[str, ...] = ()) -> str:
        if name in path:
            raise ValueError(f"{name} needs itself")
        if name not in out:
            below = [judge(k, (*path, name)) for k in needs.get(name, ())]
            value, most = checks[name]
            out[name] = "blocked" if any(b != "pass" for b in below) else "pass" if math.isfinite(value) and value <= most else "fail"
        return out[name]

    for name in checks:
        judge(name)
    return out


def binned(lower: Column, upper: Column, edges: list[float]) -> tuple[Column, Column]:
    """Bins (0 to len(edges)) of an interval's ends."""
    count = [sum(((c >= e).cast("int") for e in edges), F.lit(0)) for c in (lower, upper)]
    return count[0], count[1]


def projection_bounds(records: DataFrame, edges: list[float]) -> DataFrame:
    """(class_rank, mass): mass of states all of whose coordinates fall into one bin, by the rank of the bins; null is the mass that may fall on either side.

    records: state, mass, coordinate (from 0), lower, upper.  The masses of the states must sum to 1.
    """
    lo, hi = binned(F.col("lower"), F.col("upper"), edges)
    states = records.withColumns({"_lo": lo, "_hi": hi}).groupBy("state").agg(
        F.max("mass").alias("mass"), F.bool_and(F.col("_lo") == F.col("_hi")).alias("sure"), F.sum(F.col("_lo") * F.pow(F.lit(float(len(edges) + 1)), F.col("coordinate").cast("double"))).cast("long").alias("rank")
    )
    out = states.groupBy(F.when(F.col("sure"), F.col("rank")).alias("class_rank")).agg(F.sum("mass").alias("mass"))
    total = out.agg(F.sum("mass").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("class_rank", F.when(F.abs(F.col("total") - 1) <= 1e-9, F.col("mass")).otherwise(F.raise_error(F.lit("masses don't sum to 1")).cast("double")).alias("mass"))


def candidate_bounds(records: DataFrame, edges: list[float], candidate: list[int]) -> DataFrame:
    """One row (lower, upper): mass of states that are in the class for sure, and of those that can be."""
    lo, hi = binned(F.col("lower"), F.col("upper"), edges)
    want = F.element_at(F.array(*map(F.lit, candidate)), (F.col("coordinate") + 1).cast("int"))
    states = records.withColumns({"_lo": lo, "_hi": hi}).groupBy("state").agg(F.max("mass").alias("mass"), F.bool_and((F.col("_lo") == want) & (F.col("_hi") == want)).alias("sure"), F.bool_and((F.col("_lo") <= want) & (F.col("_hi") >= want)).alias("maybe"))
    return states.agg(F.coalesce(F.sum(F.when(F.col("sure"), F.col("mass"))), F.lit(0.0)).alias("lower"), F.coalesce(F.sum(F.when(F.col("maybe"), F.col("mass"))), F.lit(0.0)).alias("upper"))


def sequential_reference(bank: list[Structure], x: np.ndarray, y: np.ndarray, prior: Prior, order: list[int] | None = None) -> dict:
    """All structures reweighted one response at a time: the log normaliser of each step, which add up to the evidence, and the last probabilities."""
    order = list(range(len(y))) if order is None else order
    names = tuple(dict.fromkeys(t for b in bank for t in b.terms))
    total = np.array([math.log(b.prior) for b in bank])
    s, steps = None, []
    for k in order:
        d = gram.design_rows(x[k : k + 1], names)
        one = Stats(names, 1.0, d.T @ d, d.T @ y[k : k + 1], float(y[k] ** 2))
        s = one if s is None else s + one
        new = np.array([math.log(b.prior) + gram.conjugate(b, s, prior).log_evidence for b in bank])
        steps.append(float(np.logaddexp.reduce(new) - np.logaddexp.reduce(total)))
        total = new
    weights = np.exp(total - np.logaddexp.reduce(total))
    return {"steps": steps, "log_evidence": float(np.logaddexp.reduce(total)), "probabilities": dict(zip([b.name for b in bank], weights.tolist(), strict=True))}


def aligned(bank: list[Structure], exact: dict[str, float], run: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of two sources in the bank's order; what a run doesn't hold is 0, what the bank doesn't hold raises."""
    names = [b.name for b in bank]
    if extra := sorted(({*exact} | {*run}) - {*names}):
        raise ValueError(f"not in the bank: {extra}")
    return np.array([exact.get(n, 0.0) for n in names]), np.array([run.get(n, 0.0) for n in names])


def penalised_score(mse: float, operations: int, variance: float, penalty: float, collapse: float = 1.0) -> float:
    """Error, a price for each operation, and one for an expression that doesn't vary."""
    return mse + penalty * operations + (collapse if variance < 1e-12 else 0.0)


def distance_threshold(budget: int, separation: float = 1.0) -> float:
    """The least distance between laws that a number of measurements can tell apart."""
    if budget < 1 or not separation > 0:
        raise ValueError("the budget and the separation must be positive")
    return separation / math.sqrt(budget)


class Streams:
    """Counter-based random streams by seed, island and purpose; each is given out once."""

    def __init__(self, seed: int):
        self.seed = seed
        self.given: list[tuple[int, str]] = []

    def take(self, island: int, purpose: str) -> np.random.Generator:
        import hashlib

        if (island, purpose) in self.given:
            raise ValueError(f"the stream of island {island} for {purpose} was taken before")
        self.given.append((island, purpose))
        key = int.from_bytes(hashlib.sha256(f"{self.seed}:{island}:{purpose}".encode()).digest()[:16], "little")
        return np.random.Generator(np.random.Philox(key=key))
