"""Design matrices, additive sufficient statistics and exact conjugate posteriors.

Rows are read once: every structure's Gram matrix is a part of one aggregate over the union of
their terms.  What follows works on matrices of a few terms on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import special

#: Terms that one aggregate takes: beyond, its columns outgrow code generation.
WIDE = 24
#: Partitions of the levels at which partial matrices are added.
MERGES = (64, 1)
PARTIAL = pa.schema([("n", pa.float64()), ("sums", pa.list_(pa.float64()))])

LEGACY = {
    "1": lambda x: F.lit(1.0), "x": lambda x: x, "x_alias": lambda x: x, "x2": lambda x: x * x, "x3": lambda x: x * x * x,
    "sin_x": F.sin, "cos_x": F.cos, "exp_neg_x2": lambda x: F.exp(-x * x), "reciprocal_1_plus_x2": lambda x: 1 / (1 + x * x),
}


def term(name: str, xs: list[Column]) -> Column:
    """A basis term: intercept, x{i}, x{i}_sq, x{i}_cube, x{i}_x{j}, or a one-feature name."""
    if name in ("intercept", "1"):
        return F.lit(1.0)
    if len(xs) == 1 and name in LEGACY:
        return LEGACY[name](xs[0])
    if m := re.fullmatch(r"x(\d+)_x(\d+)", name):
        i, j = int(m[1]), int(m[2])
        if i < j < len(xs):
            return xs[i] * xs[j]
    if m := re.fullmatch(r"x(\d+)(_sq|_cube)?", name):
        if int(m[1]) < len(xs):
            x = xs[int(m[1])]
            return {None: x, "_sq": x * x, "_cube": x * x * x}[m[2]]
    raise ValueError(f"unknown term {name} for {len(xs)} features")


def design_stats(df: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """One row a term: mean and population deviation; the intercept keeps (0, 1)."""
    row = df.agg(*[f(c).alias(f"{k}\x1f{n}") for n, c in terms.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    items = [F.struct(F.lit(n).alias("term"), (F.lit(0.0) if n == "intercept" else F.col(f"`m\x1f{n}`")).alias("mean"), (F.lit(1.0) if n == "intercept" else F.col(f"`s\x1f{n}`")).alias("scale")) for n in terms]
    return row.select(F.inline(F.array(*items)))


def standardised(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """The columns as z-scores with means and deviations of the rows that `fit_on` selects."""
    base = df.where(fit_on) if fit_on is not None else df
    s = base.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    at = {c: (s[2 * k], s[2 * k + 1]) for k, c in enumerate(columns)}
    for c, (m, d) in at.items():
        if m is None or not d:
            raise ValueError(f"{c} has no spread")
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(d) for c, (m, d) in at.items()})


@dataclass(frozen=True)
class Stats:
    """n, X'X, X'y and y'y of named terms; two of them add."""

    terms: tuple[str, ...]
    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, other: Stats) -> Stats:
        return Stats(self.terms, self.n + other.n, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def __sub__(self, other: Stats) -> Stats:
        return Stats(self.terms, self.n - other.n, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def of(self, terms: tuple[str, ...]) -> Stats:
        at = [self.terms.index(t) for t in terms]
        return Stats(tuple(terms), self.n, self.xx[np.ix_(at, at)], self.xy[at], self.yy)


def _sums(terms: dict[str, Column], y: Column) -> list[Column]:
    cs = list(terms.values())
    return [F.count(F.lit(1)).cast("double"), *[F.sum(cs[i] * cs[j]) for i in range(len(cs)) for j in range(i, len(cs))], *[F.sum(c * y) for c in cs], F.sum(y * y)]


def _unpack(names: tuple[str, ...], row) -> Stats:
    k = len(names)
    v = [float(x or 0.0) for x in row]
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = v[1 : 1 + k * (k + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    rest = v[1 + k * (k + 1) // 2 :]
    return Stats(names, v[0], xx, np.array(rest[:k]), rest[k])


def gram(df: DataFrame, terms: dict[str, Column], y: Column) -> Stats:
    """Sufficient statistics in one pass: one aggregate, or partial matrices beyond WIDE terms; a product with a null counts as none."""
    if len(terms) > WIDE:
        return _wide(df, terms, y)
    return _unpack(tuple(terms), df.agg(*[c.alias(f"s{k}") for k, c in enumerate(_sums(terms, y))]).first())


def _wide(df: DataFrame, terms: dict[str, Column], y: Column) -> Stats:
    """One matrix a partition from Arrow batches, added up in a tree; the driver gets one matrix."""
    k = len(terms) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0.0, np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, 65536):
                m = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in b.slice(at, 65536).columns])
                n, total = n + len(m), total + m.T @ m
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [total.ravel()]}, schema=PARTIAL)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0.0, np.zeros(k * k)
        for b in batches:
            for got, sums in zip(b["n"].to_pylist(), b["sums"]):
                n, total = n + got, total + sums.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [total]}, schema=PARTIAL)

    columns = [c.cast("double").alias(f"c{i}") for i, c in enumerate([*terms.values(), y])]
    parts = df.select(*columns).mapInArrow(partial, "n double, sums array<double>")
    for count in MERGES:
        parts = parts.repartition(count).mapInArrow(add, "n double, sums array<double>")
    row = parts.first()
    if row is None:
        return Stats(tuple(terms), 0.0, np.zeros((k - 1, k - 1)), np.zeros(k - 1), 0.0)
    m = np.array(row["sums"]).reshape(k, k)
    return Stats(tuple(terms), row["n"], m[:-1, :-1], m[:-1, -1], float(m[-1, -1]))


def grams(df: DataFrame, terms: dict[str, Column], y: Column, key: Column, most: int = 1000) -> dict:
    """Sufficient statistics by a key of few values (folds); more than `most` raise."""
    rows = df.groupBy(key.alias("_key")).agg(*[c.alias(f"s{k}") for k, c in enumerate(_sums(terms, y))]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many keys for statistics on the driver")
    return {r[0]: _unpack(tuple(terms), r[1:]) for r in rows}


@dataclass(frozen=True)
class Prior:
    """Normal-inverse-gamma: mean and precision of each coefficient, shape and scale of the noise."""

    mean: float = 0.0
    precision: float = 1.0
    shape: float = 3.0
    scale: float = 1.0


@dataclass(frozen=True)
class Structure:
    name: str
    terms: tuple[str, ...]
    prior: float


def generic_bank(d: int) -> list[Structure]:
    """Six nested structures over d features, equally likely."""
    one, lin = ("intercept",), tuple(f"x{i}" for i in range(d))
    sq, cube = tuple(f"x{i}_sq" for i in range(d)), tuple(f"x{i}_cube" for i in range(d))
    cross = tuple(f"x{i}_x{j}" for i in range(d) for j in range(i + 1, d))
    kinds = {"intercept": one, "linear": one + lin, "additive_quadratic": one + lin + sq, "interaction": one + lin + cross, "full_quadratic": one + lin + sq + cross, "full_quadratic_additive_cubic": one + lin + sq + cross + cube}
    return [Structure(k, t, 1 / 6) for k, t in kinds.items()]


@dataclass
class Posterior:
    """Exact posterior of one structure at a likelihood power."""

    structure: Structure
    mean: np.ndarray
    cov: np.ndarray
    shape: float
    scale: float
    log_evidence: float
    probability: float = field(default=0.0)

    def predict(self, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Degrees of freedom, location and scale of the predictive t at each design row."""
        spread = np.einsum("ij,jk,ik->i", rows, self.cov, rows)
        return 2 * self.shape, rows @ self.mean, np.sqrt(self.scale / self.shape * (1 + spread))

    def latent_variance(self, rows: np.ndarray) -> np.ndarray:
        return self.scale / (self.shape - 1) * np.einsum("ij,jk,ik->i", rows, self.cov, rows)

    def randomised_log_loss(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Expected log loss of a parameter drawn from the posterior."""
        spread = np.einsum("ij,jk,ik->i", rows, self.cov, rows)
        return 0.5 * (math.log(2 * math.pi) + math.log(self.scale) - special.digamma(self.shape) + self.shape / self.scale * (y - rows @ self.mean) ** 2 + spread)

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """Coefficients and noise variance."""
        noise = self.scale / rng.gamma(self.shape)
        return self.mean + np.linalg.cholesky(self.cov * noise) @ rng.standard_normal(len(self.mean)), noise


def conjugate(structure: Structure, s: Stats, prior: Prior, power: float = 1.0) -> Posterior:
    """Closed form from statistics weighted by the likelihood power."""
    if not 0 < power <= 1:
        raise ValueError("a likelihood power lies in (0, 1]")
    s = s.of(structure.terms)
    k, n = len(structure.terms), power * s.n
    precision = prior.precision * np.eye(k) + power * s.xx
    info = prior.precision * prior.mean + power * s.xy
    chol = np.linalg.cholesky(precision)
    mean = np.linalg.solve(precision, info)
    shape = prior.shape + n / 2
    scale = prior.scale + 0.5 * (power * s.yy + prior.precision * k * prior.mean**2 - float(mean @ info))
    if not scale > 0:
        raise ValueError("the posterior scale isn't positive")
    log_det = 2 * float(np.log(np.diag(chol)).sum())
    evidence = -n / 2 * math.log(2 * math.pi) + 0.5 * (k * math.log(prior.precision) - log_det) + prior.shape * math.log(prior.scale) - shape * math.log(scale) + math.lgamma(shape) - math.lgamma(prior.shape)
    return Posterior(structure, mean, np.linalg.inv(precision), shape, scale, evidence)


def quadrature_log_evidence(structure: Structure, s: Stats, prior: Prior, tol: float = 1e-10) -> float:
    """The log evidence by another way, as a check: coefficients are integrated out for a given noise, the logarithm of the noise by quadrature."""
    s = s.of(structure.terms)
    k, n = len(structure.terms), s.n
    precision = prior.precision * np.eye(k) + s.xx
    info = prior.precision * prior.mean * np.ones(k) + s.xy
    rest = s.yy + prior.precision * k * prior.mean**2 - float(info @ np.linalg.solve(precision, info))
    half_det = 0.5 * (k * math.log(prior.precision) - np.linalg.slogdet(precision)[1])
    shape = prior.shape + n / 2
    top = math.log((prior.scale + rest / 2) / shape)  # where the integrand is largest

    def log_at(v: np.ndarray) -> np.ndarray:
        """Of v, the logarithm of the noise variance: likelihood with the coefficients gone, its prior, and the change of variable."""
        return -n / 2 * (math.log(2 * math.pi) + v) + half_det - 0.5 * rest * np.exp(-v) + prior.shape * math.log(prior.scale) - math.lgamma(prior.shape) - prior.shape * v - prior.scale * np.exp(-v)

    peak, width = float(log_at(np.array(top))), 40 / math.sqrt(shape)
    return peak + math.log(special.integrate(lambda v: np.exp(log_at(v) - peak), top - width, top + width, tol))


def bank_posterior(bank: list[Structure], s: Stats, prior: Prior, power: float = 1.0) -> list[Posterior]:
    """All structures with their posterior probabilities."""
    out = [conjugate(b, s, prior, power) for b in bank]
    log = np.array([math.log(p.structure.prior) + p.log_evidence for p in out])
    w = np.exp(log - log.max())
    for p, x in zip(out, w / w.sum(), strict=True):
        p.probability = float(x)
    return out


def design_rows(x: np.ndarray, terms: tuple[str, ...]) -> np.ndarray:
    """Design matrix of a small array of actions."""
    cols = []
    for t in terms:
        if t == "intercept":
            cols.append(np.ones(len(x)))
        elif m := re.fullmatch(r"x(\d+)_x(\d+)", t):
            cols.append(x[:, int(m[1])] * x[:, int(m[2])])
        else:
            m = re.fullmatch(r"x(\d+)(_sq|_cube)?", t)
            cols.append(x[:, int(m[1])] ** {None: 1, "_sq": 2, "_cube": 3}[m[2]])
    return np.column_stack(cols)


def mixture_logpdf(posts: list[Posterior], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    logs = []
    for p in posts:
        df, loc, scale = p.predict(design_rows(x, p.structure.terms))
        logs.append(math.log(max(p.probability, 1e-300)) + special.t_logpdf(y, df, loc, scale))
    a = np.array(logs)
    top = a.max(axis=0)
    return top + np.log(np.exp(a - top).sum(axis=0))


def mixture_cdf(posts: list[Posterior], x: np.ndarray, y: np.ndarray, clip: float = 1e-12) -> np.ndarray:
    out = np.zeros(len(x))
    for p in posts:
        df, loc, scale = p.predict(design_rows(x, p.structure.terms))
        out += p.probability * special.t_cdf((y - loc) / scale, df)
    return np.clip(out, clip, 1 - clip)


def ridge(s: Stats, alpha: float, free: tuple[str, ...] = ("intercept",)) -> np.ndarray:
    """Ridge coefficients from statistics; free terms aren't penalised."""
    penalty = np.diag([0.0 if t in free else alpha for t in s.terms])
    return np.linalg.lstsq(s.xx + penalty, s.xy, rcond=None)[0]


def squared_error(s: Stats, beta: np.ndarray) -> float:
    """Mean squared error of coefficients, from statistics alone."""
    return max(0.0, float(s.yy - 2 * beta @ s.xy + beta @ s.xx @ beta) / s.n)


def adaptive_ridge(s: Stats) -> float:
    """A ridge that grows with the condition number."""
    c = np.linalg.cond(s.xx)
    if not np.isfinite(c):
        return 1e-4
    return 1e-8 if c <= 1e8 else min(1e-3, 1e-8 * math.sqrt(c / 1e8))


def sparse_terms(s: Stats, keep: int, alpha: float = 1e-8) -> tuple[tuple[str, ...], np.ndarray]:
    """Ridge fit, the terms of largest |coefficient| * deviation, and a fit of these alone."""
    beta = ridge(s, alpha)
    mean = s.xx[s.terms.index("intercept")] / s.n if "intercept" in s.terms else np.zeros(len(s.terms))
    spread = np.sqrt(np.maximum(np.diag(s.xx) / s.n - mean**2, 0))
    rank = [t for _, t in sorted(zip(-np.abs(beta) * spread, s.terms, strict=True)) if t != "intercept"][:keep]
    terms = tuple(t for t in s.terms if t == "intercept" or t in rank)
    return terms, ridge(s.of(terms), alpha)


def lasso(s: Stats, alpha: float, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on 1/(2n) squared error + alpha |b|_1, from statistics; an intercept is free."""
    a, b, beta = s.xx / s.n, s.xy / s.n, np.zeros(len(s.terms))
    for _ in range(rounds):
        most = 0.0
        for j, t in enumerate(s.terms):
            if a[j, j] <= 0:
                continue
            rho = b[j] - a[j] @ beta + a[j, j] * beta[j]
            new = rho / a[j, j] if t == "intercept" else math.copysign(max(abs(rho) - alpha, 0), rho) / a[j, j]
            most, beta[j] = max(most, abs(new - beta[j])), new
        if most < tol:
            break
    return beta


def calibrated_power(bank: list[Structure], prefixes: list[Stats], rows: list[np.ndarray], ys: list[float], prior: Prior, powers: tuple[float, ...]) -> dict[float, float]:
    """Mean prequential loss of each likelihood power: row t is scored by the posterior of the rows before it."""
    out = {}
    for eta in powers:
        total = 0.0
        for s, x, y in zip(prefixes, rows, ys, strict=True):
            posts = bank_posterior(bank, s, prior, eta)
            total += sum(p.probability * float(p.randomised_log_loss(design_rows(x[None, :], p.structure.terms), np.array([y]))[0]) for p in posts)
        out[eta] = total / len(ys)
    return out


def best_power(losses: dict[float, float]) -> float:
    """The power of least loss; ties within 1e-12 go to the largest."""
    low = min(losses.values())
    return max(e for e, v in losses.items() if v <= low + 1e-12 * max(1.0, abs(low)))
