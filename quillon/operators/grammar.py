"""An open grammar of one, variables, negation, sums and products: counts, prior mass, classes, ranks and exact draws."""

from __future__ import annotations

import itertools
import math
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as ex

# An expression: ("one",), ("var", i), ("neg", e), ("add", a, b), ("mul", a, b).


class Grammar:
    """Expressions over d variables; sizes are geometric with ratio rho, and even within a size."""

    def __init__(self, d: int, rho: float):
        self.d, self.rho = d, rho
        self.count = cache(self._count)
        self.shell = cache(self._shell)

    def _count(self, n: int) -> int:
        if n < 1:
            return 0
        if n == 1:
            return self.d + 1
        return self.count(n - 1) + 2 * sum(self.count(k) * self.count(n - 1 - k) for k in range(1, n - 1))

    def expressions(self, n: int):
        """All expressions of a size, in rank order."""
        if n == 1:
            yield ("one",)
            yield from (("var", i) for i in range(self.d))
            return
        yield from (("neg", e) for e in self.expressions(n - 1))
        for op in ("add", "mul"):
            for k in range(1, n - 1):
                yield from ((op, a, b) for a in self.expressions(k) for b in self.expressions(n - 1 - k))

    def unrank(self, n: int, rank: int) -> tuple:
        """The expression of that rank within its size."""
        if not 0 <= rank < self.count(n):
            raise ValueError("no such rank")
        if n == 1:
            return ("one",) if rank == 0 else ("var", rank - 1)
        if rank < self.count(n - 1):
            return ("neg", self.unrank(n - 1, rank))
        rank -= self.count(n - 1)
        for op in ("add", "mul"):
            for k in range(1, n - 1):
                block = self.count(k) * self.count(n - 1 - k)
                if rank < block:
                    return (op, self.unrank(k, rank // self.count(n - 1 - k)), self.unrank(n - 1 - k, rank % self.count(n - 1 - k)))
                rank -= block
        raise AssertionError

    def prior(self, n: int) -> float:
        """Probability of one expression of a size."""
        return (1 - self.rho) * self.rho ** (n - 1) / self.count(n)

    def tail(self, n: int) -> float:
        return self.rho**n

    def draw(self, rng: np.random.Generator, above: int = 0) -> tuple:
        """An exact draw, given a size above a bound."""
        n = above + int(rng.geometric(1 - self.rho))
        return self.unrank(n, _below(rng, self.count(n)))

    def masses(self, spark: SparkSession, most: int) -> DataFrame:
        """(size, expressions, mass, tail)."""
        return spark.createDataFrame([(n, self.count(n), (1 - self.rho) * self.rho ** (n - 1), self.tail(n)) for n in range(1, most + 1)], "size int, expressions long, mass double, tail double")

    def _shell(self, n: int) -> dict:
        """Polynomial classes of a size with their numbers of expressions, without listing expressions."""
        if n == 1:
            zero = (0,) * self.d
            return {_key({zero: 1}): 1} | {_key({tuple(int(i == j) for j in range(self.d)): 1}): 1 for i in range(self.d)}
        out: dict = {}

        def put(p: dict, m: int) -> None:
            k = _key(p)
            out[k] = out.get(k, 0) + m

        for p, m in self.shell(n - 1).items():
            put({a: -c for a, c in p}, m)
        for k in range(1, n - 1):
            for (p, a), (q, b) in itertools.product(self.shell(k).items(), self.shell(n - 1 - k).items()):
                put(ex.add(dict(p), dict(q)), a * b)
                put(ex.multiply(dict(p), dict(q)), a * b)
        return out

    def quotient(self, most: int) -> dict:
        """Prior mass of each polynomial class up to a size."""
        out: dict = {}
        for n in range(1, most + 1):
            for k, m in self.shell(n).items():
                out[k] = out.get(k, 0.0) + m * self.prior(n)
        return out

    def unrank_in_class(self, n: int, key: tuple, rank: int) -> tuple:
        """The expression of that rank among those of a size and class; a bijection with range(multiplicity)."""
        if n == 1:
            return next(e for e in self.expressions(1) if polynomial_key(e, self.d) == key)
        neg = _key({a: -c for a, c in key})
        m = self.shell(n - 1).get(neg, 0)
        if rank < m:
            return ("neg", self.unrank_in_class(n - 1, neg, rank))
        rank -= m
        for op, f in (("add", ex.add), ("mul", ex.multiply)):
            for k in range(1, n - 1):
                for p, a in self.shell(k).items():
                    for q, b in self.shell(n - 1 - k).items():
                        if _key(f(dict(p), dict(q))) == key:
                            if rank < a * b:
                                return (op, self.unrank_in_class(k, p, rank // b), self.unrank_in_class(n - 1 - k, q, rank % b))
                            rank -= a * b
        raise ValueError("no such rank")


def _below(rng: np.random.Generator, n: int) -> int:
    """Exact uniform integer below n, by rejection."""
    bits = max(1, (n - 1).bit_length())
    while True:
        v = int.from_bytes(rng.bytes((bits + 7) // 8), "big") & ((1 << bits) - 1)
        if v < n:
            return v


def _key(p: dict) -> tuple:
    return tuple(sorted(p.items()))


def polynomial_key(e: tuple, d: int) -> tuple:
    """Exact integer polynomial of an expression, as sorted (powers, coefficient) pairs."""

    def go(x: tuple) -> dict:
        if x[0] == "one":
            return {(0,) * d: 1}
        if x[0] == "var":
            return {tuple(int(j == x[1]) for j in range(d)): 1}
        if x[0] == "neg":
            return {m: -c for m, c in go(x[1]).items()}
        return (ex.add if x[0] == "add" else ex.multiply)(go(x[1]), go(x[2]))

    return _key(go(e))


def size(e: tuple) -> int:
    return 1 + sum(size(x) for x in e[1:] if isinstance(x, tuple))


def show(e: tuple) -> str:
    if e[0] == "one":
        return "1"
    if e[0] == "var":
        return f"x{e[1]}"
    return f"-({show(e[1])})" if e[0] == "neg" else f"({show(e[1])} {'+' if e[0] == 'add' else '*'} {show(e[2])})"


def evaluate(e: tuple, x: np.ndarray) -> np.ndarray:
    if e[0] == "one":
        return np.ones(len(x))
    if e[0] == "var":
        return x[:, e[1]]
    if e[0] == "neg":
        return -evaluate(e[1], x)
    a, b = evaluate(e[1], x), evaluate(e[2], x)
    return a + b if e[0] == "add" else a * b


def class_rows(spark: SparkSession, g: Grammar, most: int) -> DataFrame:
    """(class_id, size, multiplicity, mass) of every class up to a size."""
    import hashlib

    rows = [(hashlib.sha256(repr(k).encode()).hexdigest(), n, m, m * g.prior(n)) for n in range(1, most + 1) for k, m in g.shell(n).items()]
    return spark.createDataFrame(rows, "class_id string, size int, multiplicity long, mass double")


def unranked(df: DataFrame, n: str, rank: str, d: int, rho: float) -> DataFrame:
    """Adds `expression`, `prior` and `polynomial` of the expression of each row's size and rank; null where there is no such rank."""

    @F.pandas_udf("struct<expression:string,prior:double,polynomial:string>")
    def made(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        g, held = Grammar(d, rho), {}
        for key in set(zip(sizes, ranks, strict=True)):
            try:
                e = g.unrank(int(key[0]), int(key[1]))
                held[key] = show(e), g.prior(int(key[0])), ex.spelled_polynomial(dict(polynomial_key(e, d)))
            except (ValueError, TypeError):
                held[key] = None, None, None
        return pd.DataFrame([held[k] for k in zip(sizes, ranks, strict=True)], columns=["expression", "prior", "polynomial"])

    return df.withColumn("_e", made(n, rank)).select("*", "_e.*").drop("_e")


def class_masses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class_id").agg(F.sum("mass").alias("mass"), F.sum("multiplicity").alias("multiplicity"))


def subtree_proposal(g: Grammar, e: tuple, site: tuple[int, ...], new: tuple) -> tuple[tuple, float, float]:
    """The expression with a regenerated subtree, and the forward and reverse proposal masses."""

    def at(x: tuple, path: tuple[int, ...]) -> tuple:
        return x if not path else at(x[path[0]], path[1:])

    def put(x: tuple, path: tuple[int, ...]) -> tuple:
        return new if not path else (*x[: path[0]], put(x[path[0]], path[1:]), *x[path[0] + 1 :])

    out = put(e, site)
    return out, g.prior(size(new)) / size(e), g.prior(size(at(e, site))) / size(out)


def mh_log_acceptance(current: float, proposed: float, forward: float, reverse: float, log_jacobian: float = 0.0) -> float:
    return min(0.0, proposed - current + math.log(reverse) - math.log(forward) + log_jacobian)


def independence_log_acceptance(current_target: float, proposed_target: float, current_proposal: float, proposed_proposal: float) -> float:
    return min(0.0, proposed_target - current_target + current_proposal - proposed_proposal)


# Finite laws in exact rationals.


def systematic_law(weights: tuple[Fraction, ...], n: int) -> dict[tuple[int, ...], Fraction]:
    """The law of index tuples of systematic resampling: the start is cut where a position crosses a cumulative weight."""
    cum = list(itertools.accumulate(weights))
    cuts = sorted({Fraction(0), Fraction(1, n), *((c - Fraction(k, n)) for c in cum for k in range(n) if 0 < c - Fraction(k, n) < Fraction(1, n))})
    out: dict = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        mid = (a + b) / 2
        pick = tuple(next(i for i, c in enumerate(cum) if mid + Fraction(k, n) < c) for k in range(n))
        out[pick] = out.get(pick, Fraction(0)) + (b - a) * n
    return out


def multinomial_law(weights: tuple[Fraction, ...], n: int) -> dict[tuple[int, ...], Fraction]:
    out = {}
    for pick in itertools.product(range(len(weights)), repeat=n):
        p = Fraction(1)
        for i in pick:
            p *= weights[i]
        if p:
            out[pick] = p
    return out


def pushforward(weights: tuple[Fraction, ...], transition: tuple[tuple[Fraction, ...], ...]) -> tuple[Fraction, ...]:
    return tuple(sum((w * row[j] for w, row in zip(weights, transition, strict=True)), Fraction(0)) for j in range(len(weights)))


def majority_failure(islands: int, each: Fraction = Fraction(1, 4)) -> Fraction:
    """Exact probability that more than half of the islands fail."""
    if islands % 2 == 0:
        raise ValueError("an odd number of islands")
    return sum((math.comb(islands, k) * each**k * (1 - each) ** (islands - k) for k in range(islands // 2 + 1, islands + 1)), Fraction(0))


def least_islands(functionals: int, failure: float) -> int:
    """Smallest odd number of islands that meets a union bound."""
    k = 1
    while functionals * majority_failure(k) > Fraction(failure):
        k += 2
    return k


def particle_lower_bound(steps: int, relative_ess: float, error: float) -> int:
    return math.ceil(math.log(128 * steps) * max(18 / relative_ess, 1 / (2 * error * error)))


def product_law(laws: list[dict[str, Fraction]]) -> dict[tuple[str, ...], Fraction]:
    out = {(): Fraction(1)}
    for law in laws:
        out = {(*k, a): p * q for k, p in out.items() for a, q in law.items()}
    return out


def mixture_transition(target: list[Fraction], proposal: list[Fraction], local: list[list[Fraction]], weight: Fraction) -> list[list[Fraction]]:
    """weight * independence MH + (1 - weight) * a local kernel, which must leave the target invariant."""
    n = len(target)
    if any(sum((target[i] * local[i][j] for i in range(n)), Fraction(0)) != target[j] for j in range(n)):
        raise ValueError("the local kernel doesn't keep the target")
    mh = [[proposal[j] * min(Fraction(1), target[j] * proposal[i] / (target[i] * proposal[j])) if i != j and proposal[j] and target[i] else Fraction(0) for j in range(n)] for i in range(n)]
    for i in range(n):
        mh[i][i] = 1 - sum(mh[i], Fraction(0))
    return [[weight * mh[i][j] + (1 - weight) * local[i][j] for j in range(n)] for i in range(n)]


def audit_transition(target: list[Fraction], matrix: list[list[Fraction]]) -> dict[str, bool]:
    """Exact row sums, stationarity and detailed balance."""
    n = len(target)
    return {
        "rows": all(sum(r, Fraction(0)) == 1 for r in matrix),
        "stationary": all(sum((target[i] * matrix[i][j] for i in range(n)), Fraction(0)) == target[j] for j in range(n)),
        "balanced": all(target[i] * matrix[i][j] == target[j] * matrix[j][i] for i in range(n) for j in range(n)),
    }


def confirmation_failure(selection: list[Fraction], per_candidate: list[Fraction], islands: int) -> Fraction:
    return sum((p * majority_failure(islands, f) for p, f in zip(selection, per_candidate, strict=True)), Fraction(0))


def certified_map(median: Fraction, tolerance: Fraction, threshold: Fraction) -> dict:
    lower = median - tolerance
    return {"lower": lower, "competitors": 1 - lower, "certified": median >= threshold and lower > 1 - lower}


def tail_certificate(core: float, tail_bound: float, tolerance: float = 0.01) -> dict[str, float]:
    """Posterior mass beyond the enumerated core, and the mixing steps of independence proposals from the prior."""
    share = core / (core + tail_bound)
    return {"tail_probability": tail_bound / (core + tail_bound), "mixing_steps": math.ceil(math.log(tolerance) / math.log1p(-share)) if share < 1 else 1}
