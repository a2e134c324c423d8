"""The residual grammar: what a prediction misses, said in terms of the prediction, the features and its own parts.

Terms grow from base symbols (the prediction, the features, sub-expressions of the current model) by
unary and pairwise operations to a small depth.  Each depth is one round over the table: a screen drops what isn't finite or doesn't vary; terms
that are alike on probe rows of different features are compared on all rows, which drops what is there already; and one Gram matrix a fold
scores all new terms beside the prediction.  The best of a depth are the seeds of the next.  Terms are then chosen forward by cross-validated error and tail.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.functions.columns import finite
from quillon.operators import evaluation, gram
from quillon.operators.ordered import quantiles
from quillon.sources.shared import written

# Rows of a fingerprint, its clip and its scale; how far from 1 the correlation of equal terms may be; the clip of values; the weight of the tail by profile.
PROBE, FINGER_CLIP, FINGER_SCALE, SAME = 64, 8.0, 1000.0, 1e-10
CLIP, CLIP_LEVEL, CLIP_FACTOR = 1e5, 0.999, 20.0
PROFILES = {"nmse": 0.25, "tail": 3.0, "low_complexity": 0.5}
#: Operations on terms: how they are spelt, and what they make of arrays.
UNARY = {
    "square": ("({0})**2", lambda v: v * v), "cube": ("({0})**3", lambda v: v * v * v), "tanh": ("tanh({0})", np.tanh), "sin": ("sin({0})", np.sin), "cos": ("cos({0})", np.cos),
    "signed_log": ("sign({0})*log(1 + abs({0}))", lambda v: np.sign(v) * np.log1p(np.abs(v))), "saturate": ("({0})/(1 + abs({0}))", lambda v: v / (1 + np.abs(v))),
}
BINARY = {"multiply": ("({0})*({1})", lambda a, b: a * b), "safe_ratio": ("({0})/(1 + abs({1}))", lambda a, b: a / (1 + np.abs(b)))}
OPERATIONS = UNARY | BINARY


@dataclass(frozen=True)
class Settings:
    """Widths and limits; tail_weight: of the .99 quantile of relative errors beside the squared error."""

    beam: int = 16
    most_terms: int = 128
    depth: int = 2
    chosen: int = 6
    gain: float = 1e-4
    folds: int = 4
    alpha: float = 1e-8
    tail_weight: float = 0.08
    intermediates: int = 20
    most_coefficient: float = 1e4


@dataclass(frozen=True)
class Term:
    """tree: the number of a base symbol, or an operation with its operands; what follows is where it comes from and how it is scaled."""

    tree: tuple | int
    family: str
    depth: int
    low: float = -CLIP
    high: float = CLIP
    mean: float = 0.0
    sd: float = 1.0

    @property
    def operator(self) -> str:
        return "identity" if isinstance(self.tree, int) else self.tree[0]


def spell(tree: tuple | int, names: list[str]) -> str:
    return names[tree] if isinstance(tree, int) else OPERATIONS[tree[0]][0].format(*[spell(t, names) for t in tree[1:]])


def values(tree: tuple | int, base: np.ndarray, held: dict) -> np.ndarray:
    """A term over rows of base symbols; what several terms share is made once."""
    if isinstance(tree, int):
        return base[:, tree]
    if tree not in held:
        held[tree] = OPERATIONS[tree[0]][1](*[values(t, base, held) for t in tree[1:]])
    return held[tree]


def raw(terms: list[Term]) -> Callable[[np.ndarray], np.ndarray]:
    """From rows of base symbols to rows of terms."""

    def expand(base: np.ndarray) -> np.ndarray:
        held: dict = {}
        with np.errstate(all="ignore"):
            return np.column_stack([values(t.tree, base, held) for t in terms])

    return expand


def scaled(terms: list[Term], more: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """The same with clipped values as z-scores.  more: columns after the base symbols, which are passed on."""
    plain = raw(terms)
    low, high, mean, sd = (np.array([getattr(t, c) for t in terms]) for c in ("low", "high", "mean", "sd"))

    def expand(m: np.ndarray) -> np.ndarray:
        base, rest = (m[:, :-more], m[:, -more:]) if more else (m, m[:, :0])
        return np.hstack(((np.clip(plain(base), low, high) - mean) / sd, rest))

    return expand


def matrix(b: pa.RecordBatch, first: int = 0) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[first:]]).astype(float)


def wide_grams(df: DataFrame, columns: list[Column], key: str, expand: Callable[[np.ndarray], np.ndarray] | None = None, size: int | None = None) -> dict[int, np.ndarray]:
    """Matrix of products of the columns, or of what expand makes of them (`size` columns), with a leading one, for each value of a small integer key; from Arrow batches, added in a tree."""
    k = (size or len(columns)) + 1
    schema = pa.schema([("key", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"key": list(total), "sums": [m.ravel() for m in total.values()]}, schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 16384):
                part = b.slice(at, 16384)
                of, m = part.column(0).to_numpy(), matrix(part, 1)
                m = np.column_stack((np.ones(len(of)), m if expand is None else expand(m)))
                for f in np.unique(of).tolist():
                    own = m[of == f]
                    total[f] = total.get(f, 0.0) + own.T @ own
        yield from rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for f, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[f] = total.get(f, 0.0) + sums.values.to_numpy(zero_copy_only=False)
        yield from rows(total)

    parts = df.select(F.col(key).cast("int").alias("key"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(partial, "key int, sums array<double>")
    for count in gram.MERGES:
        parts = parts.repartition(count).mapInArrow(add, "key int, sums array<double>")
    return {r.key: np.array(r.sums).reshape(k, k) for r in parts.collect()}


@dataclass(frozen=True)
class Screen:
    """Whether a column is finite on every row, its mean and deviation, and its largest absolute value."""

    ok: bool
    mean: float
    sd: float
    largest: float


def screened(df: DataFrame, columns: list[Column], expand: Callable[[np.ndarray], np.ndarray] | None = None, size: int | None = None) -> list[Screen]:
    """One pass over Arrow batches of the columns, or of what expand makes of them; partial results of partitions are joined in one aggregate."""
    k = size or len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ok, total, square, largest = 0, np.ones(k, bool), np.zeros(k), np.zeros(k), np.zeros(k)
        for b in batches:
            for at in range(0, b.num_rows, 16384):
                m = matrix(b.slice(at, 16384))
                m = m if expand is None else expand(m)
                ok &= np.isfinite(m).all(axis=0)
                m = np.where(np.isfinite(m), m, 0.0)
                own, mean = len(m), m.mean(axis=0)
                square += ((m - mean) ** 2).sum(axis=0) + own * n / (own + n) * (mean - total / max(n, 1)) ** 2
                n, total, largest = n + own, total + m.sum(axis=0), np.maximum(largest, np.abs(m).max(axis=0))
        yield pa.RecordBatch.from_pydict({"k": np.arange(k, dtype=np.int32), "n": np.full(k, float(n)), "ok": ok, "mean": total / max(n, 1), "square": square, "largest": largest})

    parts = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(partial, "k int, n double, ok boolean, mean double, square double, largest double").where("n > 0")
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    joined = parts.groupBy("k").agg(F.bool_and("ok").alias("ok"), (m / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.sum("square") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - m * m / n) / n)).alias("sd"), F.max("largest").alias("largest"))
    got = {r.k: Screen(r.ok, r.mean, r.sd, r.largest) for r in joined.collect()}
    return [got.get(j, Screen(False, 0.0, 0.0, 0.0)) for j in range(k)]


def probe_rows(rows: DataFrame, key: str, columns: list[Column]) -> np.ndarray:
    """The columns of the rows with the least keys, one row a key, so copies don't fill the probe; a task passes on as many rows as the probe has."""
    some = rows.select(key, *columns)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            held = t.take(np.unique(t.column(0).to_numpy(), return_index=True)[1][:PROBE])
        if held is not None:
            yield from held.to_batches()

    got = some.mapInArrow(least, some.schema).dropDuplicates([key]).orderBy(key).limit(PROBE).collect()
    return np.array([[np.nan if v is None else v for v in r[1:]] for r in got], float).reshape(-1, len(columns))


#: Bins of relative errors for each factor of e: a quantile is known to within a thousandth of its value.
BINS = 1024


def tails(rows: DataFrame, size: int, choices: list[list[int]], fits: list[dict[int, np.ndarray]], by: dict[int, np.ndarray]) -> list[float]:
    """Mean over folds of the .99 quantile of relative errors of each fit on its left-out fold, over that of the fold's mean where this is over 1.

    rows: fold, y, z0, z1, ...; errors are counted in bins of equal ratio, so what partitions give adds up.
    """
    folds = sorted(by)
    beta = {f: np.zeros((size + 1, len(choices) + 1)) for f in folds}  # the last column predicts the fold's mean
    for f in folds:
        for k, c in enumerate(choices):
            beta[f][[0, *[j + 1 for j in c]], k] = fits[k][f]
        beta[f][0, -1] = by[f][0, -1] / by[f][0, 0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            z = np.column_stack([np.ones(len(y)), *[c.to_numpy() for c in b.columns[2:]]])
            for f in np.unique(fold).tolist():
                at = fold == f
                rel = np.abs(z[at] @ beta[f] - y[at, None]) / np.maximum(np.abs(y[at, None]), 1e-12)
                bins = np.floor(np.log(np.maximum(rel, 1e-15)) * BINS).astype(np.int64)
                key, n = np.unique(bins + (np.arange(bins.shape[1]) << 32), return_counts=True)
                k = (key + (1 << 31)) >> 32
                yield pa.RecordBatch.from_pydict({"fold": np.full(len(key), f, np.int32), "k": k.astype(np.int32), "bin": key - (k << 32), "n": n.astype(np.int64)})

    counts = rows.select("fold", "y", *[f"z{k}" for k in range(size)]).mapInArrow(count, "fold int, k int, bin long, n long").groupBy("fold", "k", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("fold", "k")
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    got = upto.where(F.col("upto") > F.lit(0.99) * (F.col("all") - 1)).groupBy("fold", "k").agg(F.min("bin").alias("bin")).collect()
    q = {(r.fold, r.k): math.exp((r.bin + 0.5) / BINS) for r in got}
    return [sum(min(100.0, q[f, k] / max(1.0, q[f, len(choices)])) for f in folds) / len(folds) for k in range(len(choices))]


def fit(m: np.ndarray, at: list[int], y: int, alpha: float) -> np.ndarray:
    """Intercept and coefficients of columns by ridge on z-scores, from a matrix of products."""
    n, mean, target = m[0, 0], m[0, at] / m[0, 0], m[0, y] / m[0, 0]
    cov = m[np.ix_(at, at)] / n - np.outer(mean, mean)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0.0)), 1e-12)
    z = n * cov / np.outer(scale, scale) + alpha * np.eye(len(at))
    beta = np.linalg.lstsq(z, n * (m[at, y] / n - mean * target) / scale, rcond=None)[0] / scale
    return np.concatenate(([target - beta @ mean], beta))


def error(m: np.ndarray, at: list[int], y: int, beta: np.ndarray) -> float:
    """Mean squared error of coefficients over the variance of y, from a matrix of products."""
    full = [0, *at]
    mse = (m[y, y] - 2 * beta @ m[full, y] + beta @ m[np.ix_(full, full)] @ beta) / m[0, 0]
    return max(0.0, float(mse)) / max(float(m[y, y] / m[0, 0] - (m[0, y] / m[0, 0]) ** 2), 1e-15)


def cross_validated(by: dict[int, np.ndarray], at: list[int], y: int, alpha: float) -> tuple[float, dict[int, np.ndarray]]:
    """Mean error of fits without each fold on that fold, and the fits."""
    whole = sum(by.values())
    fits = {f: fit(whole - m, at, y, alpha) for f, m in by.items()}
    return sum(error(m, at, y, fits[f]) for f, m in by.items()) / len(by), fits


class Builder:
    """Base symbols and grown terms of one model over one table."""

    def __init__(self, df: DataFrame, current: str, xs: list[Column], y: Column, settings: Settings, profile: str):
        self.settings, self.profile, self.spark = settings, profile, df.sparkSession
        d = len(xs)
        parts = [t for t, _ in intermediate_outputs(df, current, xs, settings.intermediates)]
        self.actual = [f"({current})", *[f"x{k}" for k in range(d)], *[f"({t})" for t in parts]]
        self.shown = ["y_hat", *self.actual[1:]]
        families = ["current_prediction", *["raw_variable"] * d, *["current_dag_intermediate"] * len(parts)]
        base = [ex.compile_expression(t, xs).cast("double").alias(f"b{k}") for k, t in enumerate(self.actual)]
        fold = F.pmod(F.xxhash64(*xs, y), F.lit(settings.folds)).cast("int")
        self.rows = written(df.select(*base, y.cast("double").alias("y"), fold.alias("fold"), F.xxhash64(F.lit(1), *xs).alias("h")).where(finite("y")), "residual")
        self.base = [F.col(f"b{k}") for k in range(len(base))]
        self.probe = probe_rows(self.rows, "h", self.base)
        self.seen: dict[tuple[int, ...], list[Term]] = {}
        self.terms: list[Term] = self.admitted([Term(k, f, 0) for k, f in enumerate(families)])
        if not self.terms or self.terms[0].tree != 0:
            raise ValueError("the current model isn't a number on every row, or doesn't vary")

    def admitted(self, terms: list[Term]) -> list[Term]:
        """Terms that are finite on every row, vary, and differ from all before; three rounds over the table at most."""
        terms = list({t.tree: t for t in terms}.values())
        if not terms or not len(self.probe):
            return []
        probed, met, fingers, fresh, room = raw(terms)(self.probe), set(self.seen), [], [], self.settings.most_terms
        for k, t in enumerate(terms):
            v = probed[:, k]
            if not np.isfinite(v).all():
                continue
            finger = tuple(np.rint(np.clip((v - v.mean()) / max(float(v.std()), 1e-12), -FINGER_CLIP, FINGER_CLIP) * FINGER_SCALE).astype(np.int64).tolist())
            new = finger not in met
            if room or not new:
                met.add(finger)
                fingers.append(finger)
                fresh.append(t)
                room -= new
        if not fresh:
            return []
        got = screened(self.rows, self.base, raw(fresh), len(fresh))
        kept = [(k, t) for k, t in enumerate(fresh) if got[k].ok and math.isfinite(got[k].sd) and got[k].sd > 1e-12]
        bounds, large = dict.fromkeys(range(len(fresh)), CLIP), [k for k, _ in kept if got[k].largest > CLIP]
        if large:
            pick = raw([fresh[k] for k in large])

            def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    m = np.abs(pick(matrix(b)))
                    yield pa.RecordBatch.from_pydict({"k": np.tile(np.arange(m.shape[1], dtype=np.int32), len(m)), "v": m.ravel()})

            q = quantiles(self.rows.select(*self.base).mapInArrow(long, "k int, v double"), F.col("v"), [CLIP_LEVEL], ["k"])
            bounds |= {large[r.k]: max(CLIP, CLIP_FACTOR * r.q) for r in q.collect()}
        return self.different([(fingers[k], Term(t.tree, t.family, t.depth, -bounds[k], bounds[k], got[k].mean, got[k].sd)) for k, t in kept])

    def different(self, terms: list[tuple[tuple[int, ...], Term]]) -> list[Term]:
        """Terms without those that equal one before but for place and scale.  Fingerprints of few rows can't tell terms that differ on rare rows only, so terms that share one are compared on all rows, by one matrix."""
        alike: dict[tuple[int, ...], list[Term]] = {}
        for finger, t in terms:
            alike.setdefault(finger, list(self.seen.get(finger, []))).append(t)
        pool = [t for ts in alike.values() if len(ts) > 1 for t in ts]
        at, out = {t.tree: k for k, t in enumerate(pool, 1)}, []
        if pool:
            m = sum(self.grams(pool).values())
            cov = m / m[0, 0] - np.outer(m[0], m[0]) / m[0, 0] ** 2
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
        for finger, t in terms:
            others = self.seen.setdefault(finger, [])
            if len(out) < self.settings.most_terms and not any(1 - cov[at[t.tree], at[o.tree]] / (sd[at[t.tree]] * sd[at[o.tree]]) < SAME for o in others):
                others.append(t)
                out.append(t)
        return out

    def grams(self, terms: list[Term]) -> dict[int, np.ndarray]:
        return wide_grams(self.rows, [*self.base, F.col("y")], "fold", scaled(terms, 1), len(terms) + 1)

    def univariate(self, terms: list[Term]) -> list[float]:
        """Error of the prediction with each term, all from one matrix a fold."""
        by, y = self.grams([self.terms[0], *terms]), len(terms) + 2
        return [cross_validated(by, [1] if t.tree == 0 else [1, k + 2], y, self.settings.alpha)[0] for k, t in enumerate(terms)]

    def grow(self) -> list[dict]:
        """Depths of terms from the best of the depth before; what each depth did."""
        s = self.settings
        order = sorted(zip(self.univariate(self.terms), range(len(self.terms)), strict=True))
        beam = [self.terms[k] for _, k in order[: s.beam]]
        trace = [{"depth": 0, "generated": len(self.terms), "beam": [spell(t.tree, self.shown) for t in beam]}]
        for depth in range(1, s.depth + 1):
            room = s.most_terms - len(self.terms)
            asked = [Term((op, t.tree), "nonlinear_transform", depth) for t in beam for op in UNARY]
            seeds = beam[: max(2, s.beam // 2)]
            for i, a in enumerate(seeds):
                for b in seeds[i:]:
                    asked.append(Term(("multiply", *sorted((a.tree, b.tree), key=str)), "interaction", depth))
                    if a is not b:
                        asked += [Term(("safe_ratio", p.tree, q.tree), "conditioned_transform", depth) for p, q in ((a, b), (b, a))]
            known = {t.tree for t in self.terms}
            new = self.admitted([t for t in asked if t.tree not in known])[: max(0, room)]
            if not new:
                break
            self.terms += new
            order = sorted(zip(self.univariate(new), range(len(new)), strict=True))
            beam = [new[k] for _, k in order[: s.beam]]
            trace.append({"depth": depth, "generated": len(new), "beam": [spell(t.tree, self.shown) for t in beam]})
        return trace

    def select(self) -> tuple[list[Term], list[dict], dict[str, float]]:
        """Terms chosen forward beside the prediction, what each step gained, and the objectives before and after."""
        s = self.settings
        weight = s.tail_weight * PROFILES.get(self.profile, 1.0)
        others = self.terms[1:]
        order = sorted(zip(self.univariate(others), range(len(others)), strict=True)) if others else []
        pool = [self.terms[0], *[others[k] for _, k in order[: max(8, 2 * s.beam)]]]
        expand, names = scaled(pool), [f"z{k}" for k in range(len(pool))]

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, expand(matrix(b, 2)).T)], names=["fold", "y", *names])

        rows = written(self.rows.select("fold", "y", *self.base).mapInArrow(scores, "fold int, y double, " + ", ".join(f"{n} double" for n in names)), "pool")
        by = wide_grams(rows, [*map(F.col, names), F.col("y")], "fold")
        y = len(pool) + 1

        def objectives(choices: list[list[int]]) -> list[tuple[float, float]]:
            got = [cross_validated(by, [k + 1 for k in c], y, s.alpha) for c in choices]
            tail = tails(rows, len(pool), choices, [f for _, f in got], by) if weight > 0 else [0.0] * len(choices)
            return [(e + weight * t, e) for (e, _), t in zip(got, tail, strict=True)]

        chosen, (best, plain) = [0], objectives([[0]])[0]
        out = {"identity_objective": best, "identity_nmse": plain}
        steps = []
        while len(chosen) < s.chosen:
            rest = [k for k in range(len(pool)) if k not in chosen]
            if not rest:
                break
            (objective, nmse), k = min((v, k) for v, k in zip(objectives([[*chosen, k] for k in rest]), rest, strict=True))
            if (best - objective) / max(abs(best), 1e-15) < s.gain:
                break
            steps.append({"expression": spell(pool[k].tree, self.shown), "before": best, "after": objective, "nmse": nmse})
            chosen, best, plain = [*chosen, k], objective, nmse
        self.coefficients = fit(sum(by.values()), [k + 1 for k in chosen], y, s.alpha)
        return [pool[k] for k in chosen], steps, out | {"objective": best, "nmse": plain}


def program(df: DataFrame, current: str, xs: list[Column], y: Column, profile: str = "balanced", settings: Settings | None = None) -> dict:
    """The corrected expression of a model over its own residual, how it was found, and what to do with the model's structure.

    Rows whose target isn't finite are left out.
    """
    b = Builder(df, current, xs, y, settings or Settings(), profile)
    trace = b.grow()
    chosen, steps, scores = b.select()
    intercept, pieces, rows, own = float(b.coefficients[0]), [], [], 0.0
    for t, beta in zip(chosen, b.coefficients[1:], strict=True):
        value = max(-b.settings.most_coefficient, min(b.settings.most_coefficient, float(beta) / t.sd))
        intercept -= value * t.mean
        if abs(value) <= 1e-14:
            continue
        own = value if t.tree == 0 else own
        pieces.append(f"({value!r})*({spell(t.tree, b.actual)})")
        rows.append({"expression": spell(t.tree, b.shown), "family": t.family, "operator": t.operator, "depth": t.depth, "coefficient": value})
    if abs(intercept) > 1e-14:
        pieces.insert(0, f"({intercept!r})")
    features = [f"x{k}" for k in range(len(xs))]
    return {"expression": " + ".join(pieces) or "0.0", "terms": rows, "steps": steps, "trace": trace, **scores, "actions": suggested(rows, own, intercept, features), "interaction": _interacts(rows, features), "nonlinear": _transforms(rows), "generated": len(b.terms)}


def _interacts(rows: list[dict], features: list[str]) -> bool:
    return any("y_hat" in r["expression"] and any(re.search(rf"\b{x}\b", r["expression"]) for x in features) for r in rows)


def _transforms(rows: list[dict]) -> bool:
    return any(r["family"] == "nonlinear_transform" and "y_hat" in r["expression"] for r in rows)


def suggested(rows: list[dict], own: float, intercept: float, features: list[str]) -> list[str]:
    """Structural actions that the chosen terms ask for; own: the coefficient that the prediction kept."""
    rest = [r for r in rows if r["expression"] != "y_hat"]
    families = {r["family"] for r in rest}
    out = ["REPLACE"] if abs(own) < 0.2 else ["REPARAMETERIZE"] if abs(own - 1) > 0.1 or abs(intercept) > 1e-10 else []
    out += ["ADD"] * ("raw_variable" in families) + ["CHANGE_OPERATOR", "REPLACE"] * _transforms(rest) + ["CHANGE_INTERACTION", "ADD"] * _interacts(rest, features) + ["DELETE", "REPLACE"] * ("current_dag_intermediate" in families)
    return list(dict.fromkeys(out or (["ADD"] if rest else ["REPARAMETERIZE"])))


def failures(df: DataFrame, ident: str, current: str, xs: list[Column], y: Column, found: dict) -> DataFrame:
    """One row: the failure summary of a model, with the tags that its residual program shows."""
    d = df.withColumn("_model", F.lit("all"))
    return evaluation.failure_summary(d, ["_model"], ident, y, ex.compile_expression(current, xs), {f"x{k}": x for k, x in enumerate(xs)}, F.lit(found["interaction"]), F.lit(found["nonlinear"])).drop("_model")


def intermediate_outputs(df: DataFrame, text: str, xs: list[Column], most: int = 20) -> list[tuple[str, float]]:
    """Sub-expressions that vary, by log(1 + deviation) plus .05 a variable; one aggregate for all."""
    d = len(xs)
    parts = [p for p in dict.fromkeys(n.signature for n in ex.nodes(text, d)[1:] if n.kind not in ("name", "constant")) if any(f"x{i}" in p for i in range(d))]
    parts = [p for p in parts if ex.canonical(p, d) != ex.canonical(text, d)]
    if not parts:
        return []
    got = ex.score_candidates(df, parts, xs, F.lit(0.0)).collect()
    rank = [(math.log1p(math.sqrt(r.variance)) + 0.05 * sum(f"x{i}" in r.candidate for i in range(d)), r.candidate) for r in got if r.valid and r.variance is not None and r.variance > 1e-24]
    return [(t, s) for s, t in sorted(rank, key=lambda x: (-x[0], x[1]))[:most]]
