"""Symbolic search: candidate generation on the driver, scoring of whole batches in one aggregate."""

from __future__ import annotations

import hashlib
import math
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators import gram


class Regressor(ABC):
    """What an engine offers."""

    @abstractmethod
    def fit(self, df: DataFrame, xs: list[Column], y: Column) -> Regressor: ...

    @abstractmethod
    def best_expression(self) -> str: ...


@dataclass
class Budget:
    """A hard count of evaluations by category."""

    most: int
    used: dict[str, int] = field(default_factory=dict)
    denied: dict[str, int] = field(default_factory=dict)

    def consume(self, category: str, n: int = 1) -> bool:
        ok = sum(self.used.values()) + n <= self.most
        side = self.used if ok else self.denied
        side[category] = side.get(category, 0) + n
        return ok

    def snapshot(self) -> dict:
        return {"used": dict(self.used), "denied": dict(self.denied), "remaining": self.most - sum(self.used.values())}


class PolynomialLasso(Regressor):
    """L1-penalised polynomial on z-scores, from one aggregate of sufficient statistics."""

    def __init__(self, degree: int = 4, alpha: float = 0.01):
        self.degree, self.alpha, self.expression = degree, alpha, "0"

    def fit(self, df: DataFrame, xs: list[Column], y: Column) -> PolynomialLasso:
        import itertools

        d = len(xs)
        s = df.agg(*[f(c) for c in [*xs, y] for f in (F.avg, F.stddev_pop)]).first()
        at = [(s[2 * k] or 0.0, s[2 * k + 1] or 1.0) for k in range(d + 1)]
        z = [(x - F.lit(m)) / F.lit(v) for x, (m, v) in zip(xs, at, strict=False)]
        powers = [p for p in itertools.product(range(self.degree + 1), repeat=d) if 0 < sum(p) <= self.degree]
        terms = {"intercept": F.lit(1.0)}
        for p in powers:
            c = F.lit(1.0)
            for x, k in zip(z, p, strict=True):
                for _ in range(k):
                    c = c * x
            terms["_".join(map(str, p))] = c
        stats = gram.gram(df, terms, (y - F.lit(at[-1][0])) / F.lit(at[-1][1]))
        scale = np.sqrt(np.maximum(np.diag(stats.xx) / stats.n - (stats.xx[0] / stats.n) ** 2, 1e-300))
        scale[0] = 1.0
        scaled = gram.Stats(stats.terms, stats.n, stats.xx / np.outer(scale, scale), stats.xy / scale, stats.yy)
        beta = gram.lasso(scaled, self.alpha) / scale
        parts = [repr(float(at[-1][0] + at[-1][1] * beta[0]))]
        for b, p in zip(beta[1:], powers, strict=True):
            if b:
                zs = "*".join(f"((x{i} - {at[i][0]!r})/{at[i][1]!r})**{k}" for i, k in enumerate(p) if k)
                parts.append(f"{float(at[-1][1] * b)!r}*{zs}")
        self.expression = " + ".join(parts).replace("- -", "+ ")
        return self

    def best_expression(self) -> str:
        return self.expression


@dataclass
class _Node:
    text: str
    parent: _Node | None = None
    visits: int = 0
    total: float = 0.0
    children: list[_Node] = field(default_factory=list)
    untried: list[str] | None = None


class TreeSearch(Regressor):
    """UCB over a typed grammar; the untried neighbours of the chosen node are scored together.  reward: of a score, more is better."""

    def __init__(self, iterations: int = 10, width: int = 6, ucb: float = 1.4142, penalty: float = 1e-3, max_ops: int = 8, seed: int = 0, reward: Callable[[float], float] | None = None, functions: tuple[str, ...] = ("sin", "cos", "exp", "log")):
        self.reward, self.functions = reward or (lambda score: 1 / (1 + score)), functions
        self.iterations, self.width, self.ucb, self.penalty, self.max_ops, self.seed = iterations, width, ucb, penalty, max_ops, seed
        self.scores: dict[str, float] = {}

    def neighbours(self, text: str, d: int, rng: np.random.Generator) -> list[str]:
        ends = [f"x{i}" for i in range(d)] + ["0.5", "2.0"]
        out = [f"{f}({text})" for f in self.functions] + [f"({text}) {op} {e}" for op in "+-*/" for e in ends] + [f"({text})**2"]
        seen, keep = set(), []
        for k in rng.permutation(len(out)):
            try:
                c = ex.canonical(out[k], d)
                if ex.operations(out[k], d) <= self.max_ops and c not in seen:
                    seen.add(c)
                    keep.append(out[k])
            except (ValueError, ZeroDivisionError, OverflowError):
                continue
        return keep

    def _score(self, df: DataFrame, texts: list[str], xs: list[Column], y: Column) -> None:
        fresh = [t for t in dict.fromkeys(texts) if t not in self.scores]
        if fresh:
            for r in ex.score_candidates(df, fresh, xs, y, self.penalty).collect():
                flat = r.variance is not None and r.variance < 1e-12
                self.scores[r.candidate] = float(r.mse) + (1.0 if flat else 0.0) if r.valid and r.mse is not None else math.inf

    def fit(self, df: DataFrame, xs: list[Column], y: Column) -> TreeSearch:
        rng = np.random.default_rng(self.seed)
        d = len(xs)
        root = _Node("0.0")
        root.untried = [f"x{i}" for i in range(d)] + ["1.0"]
        for _ in range(self.iterations):
            node = root
            while not node.untried and node.children:
                node = max(node.children, key=lambda c: c.total / max(1, c.visits) + self.ucb * math.sqrt(math.log(max(1, node.visits)) / max(1, c.visits)))
            if node.untried is None:
                node.untried = self.neighbours(node.text, d, rng)
            batch, node.untried = node.untried[: self.width], node.untried[self.width :]
            self._score(df, batch, xs, y)
            for t in batch:
                child = _Node(t, node)
                node.children.append(child)
                reward, up = self.reward(self.scores[t]), child
                while up is not None:
                    up.visits += 1
                    up.total += reward
                    up = up.parent
        return self

    def best_expression(self) -> str:
        return min(self.scores, key=lambda t: (self.scores[t], len(t), t))


def scheduled(engines: dict[str, Callable[[int], Regressor]], df: DataFrame, xs: list[Column], y: Column, valid: DataFrame, repeats: int, base_seed: int, budget: Budget) -> list[dict]:
    """Engines times repeats with stable seeds; a failing job is retried once with another seed; all failing raises.  Scored on validation rows in one aggregate."""
    found = []
    for name, make in sorted(engines.items()):
        for r in range(repeats):
            for attempt in range(2):
                if not budget.consume(name):
                    break
                seed = int.from_bytes(hashlib.sha256(f"{base_seed}:{name}:{r}:{attempt}".encode()).digest()[:4], "big")
                try:
                    found.append((name, r, make(seed).fit(df, xs, y).best_expression()))
                    break
                except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                    continue
    if not found:
        raise ValueError("every engine failed")
    texts = list(dict.fromkeys(t for *_, t in found))
    score = {r.candidate: r.mse if r.valid else None for r in ex.score_candidates(valid, texts, xs, y).collect()}
    return [{"engine": n, "repeat": r, "expression": t, "mse": score[t]} for n, r, t in found]


def anchor_terms(xs: list[Column]) -> dict[str, tuple[str, Column]]:
    """Named basis of each feature and of pairs: text and Column."""
    out: dict[str, tuple[str, Column]] = {}
    for i, x in enumerate(xs):
        n = f"x{i}"
        out |= {n: (n, x), f"{n}^2": (f"{n}**2", x * x), f"{n}^3": (f"{n}**3", x * x * x), f"sin {n}": (f"sin({n})", F.sin(x)), f"cos {n}": (f"cos({n})", F.cos(x)), f"tanh {n}": (f"tanh({n})", F.tanh(x)), f"log1p {n}": (f"log(1 + abs({n}))", F.log1p(F.abs(x))), f"sat {n}": (f"{n}/(1 + abs({n}))", x / (1 + F.abs(x)))}
    for i, a in enumerate(xs):
        for j in range(i + 1, len(xs)):
            b = xs[j]
            out |= {f"x{i}x{j}": (f"x{i}*x{j}", a * b), f"x{i}2x{j}": (f"x{i}**2*x{j}", a * a * b), f"x{i}x{j}2": (f"x{i}*x{j}**2", a * b * b)}
    return out


def explore(df: DataFrame, xs: list[Column], y: Column, folds: int = 5, beam: int = 4, gain: float = 1e-3, fold: Column | None = None) -> dict:
    """Greedy forward choice of terms by cross-validated error.  Every fit comes from per-fold statistics of one aggregate."""
    terms = {"intercept": ("1", F.lit(1.0))} | anchor_terms(xs)
    key = fold if fold is not None else F.pmod(F.xxhash64(*xs, y), F.lit(folds)).cast("int")
    by = gram.grams(df, {k: c for k, (_, c) in terms.items()}, y, key)
    whole = sum(list(by.values())[1:], list(by.values())[0])

    def cv(names: tuple[str, ...]) -> float:
        total = 0.0
        for s in by.values():
            beta = gram.ridge((whole - s).of(names), 1e-8)
            total += gram.squared_error(s.of(names), beta) / max(1e-12, s.yy / s.n - (s.xy[0] / s.n) ** 2)
        return total / len(by)

    spread = np.diag(whole.xx) / whole.n - (whole.xx[0] / whole.n) ** 2
    pool = sorted((cv(("intercept", t)), t) for t, v in zip(whole.terms, spread, strict=True) if t != "intercept" and v > 1e-24)[: 2 * beam]
    chosen, best = ("intercept",), cv(("intercept",))
    trace = [("intercept", best)]
    while len(chosen) <= beam:
        step = min(((cv((*chosen, t)), t) for _, t in pool if t not in chosen), default=None)
        if step is None or best - step[0] < gain * max(best, 1e-12):
            break
        chosen, best = (*chosen, step[1]), step[0]
        trace.append((step[1], best))
    beta = gram.ridge(whole.of(chosen), 1e-8)
    text = " + ".join(f"{float(b)!r}*({terms[t][0]})" for t, b in zip(chosen, beta, strict=True))
    return {"expression": text, "terms": chosen, "cv_nmse": best, "trace": trace}


def plugin_candidates(plugins: list[tuple[str, Callable[[], list[str]]]], n_features: int) -> tuple[list[str], list[str]]:
    """Candidates of caller-made generators, in order of their names; duplicates by canonical form and invalid ones are left out."""
    out, rejected, seen = [], [], set()
    for _, f in sorted(plugins, key=lambda p: p[0]):
        for t in f():
            try:
                h = ex.digest(t, n_features)
            except (ValueError, SyntaxError) as error:
                rejected.append(f"{t}: {error}")
                continue
            if h not in seen:
                seen.add(h)
                out.append(t)
    return out, rejected


def register_plugin(spark: SparkSession, name: str, make: Callable[[int], Iterable[str]]) -> None:
    """A caller's generator as a table function: SELECT * FROM name(n_features) gives (plugin, expression, digest, reason).

    make: from a number of features to expressions.  An expression that can't be read has no digest, and the reason why.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError("the name must be an identifier")

    class Candidates:
        def eval(self, n_features: int):
            for t in make(n_features):
                try:
                    yield name, t, ex.digest(t, n_features), None
                except (ValueError, SyntaxError, TypeError) as error:
                    yield name, str(t), None, str(error)

    spark.udtf.register(name, F.udtf(Candidates, returnType="plugin string, expression string, digest string, reason string"))


def plugin_table(spark: SparkSession, names: list[str], n_features: int) -> DataFrame:
    """Candidates of registered plugins, of equal ones the first by plugin and text; what can't be read is left out."""
    out = None
    for n in sorted(names):
        part = spark.sql(f"SELECT * FROM {n}({int(n_features)})")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no plugin is named")
    return out.where("digest is not null").groupBy("digest").agg(F.min(F.struct("plugin", "expression")).alias("_f")).select("_f.plugin", "_f.expression", "digest")
