"""Refinement of expressions: amplitudes, constants, pruning, ablation, semantic matching, and domain metrics.

Fits come from sufficient statistics of the top-level terms; searches over constants score a
whole batch of settings in one aggregate.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators import gram, metrics
from quillon.operators.ordered import quantiles
from quillon.operators.ranking import edit_label


def summands(text: str, d: int) -> list[str]:
    """Top-level terms of a sum, signs kept."""
    out: list[str] = []

    def walk(x: ast.AST, sign: int) -> None:
        if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add | ast.Sub):
            walk(x.left, sign)
            walk(x.right, sign if isinstance(x.op, ast.Add) else -sign)
        else:
            out.append(ast.unparse(x) if sign > 0 else f"-({ast.unparse(x)})")

    walk(ex.parse(text, d), 1)
    return out


def _statistics(df: DataFrame, terms: list[str], xs: list[Column], y: Column) -> gram.Stats:
    return gram.gram(df, {f"t{k}": ex.compile_expression(t, xs) for k, t in enumerate(terms)}, y)


def _rendered(terms: list[str], beta: np.ndarray) -> str:
    return " + ".join(f"{float(b)!r}*({t})" for t, b in zip(terms, beta, strict=True)) or "0.0"


def fit_amplitudes(df: DataFrame, text: str, xs: list[Column], y: Column, least: float = 1e-9) -> tuple[str, float]:
    """Each top-level term gets its own factor by ridge with a condition-adaptive penalty; tiny contributions go.  Returns the error too."""
    terms = summands(text, len(xs))
    if "1" not in terms and "1.0" not in terms:
        terms.append("1.0")
    s = _statistics(df, terms, xs, y)
    scale = np.sqrt(np.maximum(np.diag(s.xx) / s.n, 1e-300))
    z = gram.Stats(s.terms, s.n, s.xx / np.outer(scale, scale), s.xy / scale, s.yy)
    beta = gram.ridge(z, gram.adaptive_ridge(z) * s.n, free=()) / scale
    size = np.abs(beta) * scale
    keep = [k for k in range(len(terms)) if size[k] > least * max(size.max(), 1e-300)]
    chosen = s.of(tuple(f"t{k}" for k in keep))
    return _rendered([terms[k] for k in keep], beta[keep]), gram.squared_error(chosen, beta[keep])


def refit_constants(df: DataFrame, text: str, xs: list[Column], y: Column, rounds: int = 12, seed: int = 0, width: int = 8) -> tuple[str, float]:
    """Pattern search over an expression's literals; every round scores `width` settings a literal in one aggregate, and only gains are kept."""
    d = len(xs)
    rng = np.random.default_rng(seed)
    tree = ex.parse(text, d)
    at = [x for x in ast.walk(tree) if isinstance(x, ast.Constant) and isinstance(x.value, float)]
    values = [float(x.value) for x in at]

    def shown(v: list[float]) -> str:
        for x, k in zip(at, v, strict=True):
            x.value = float(k)
        return ast.unparse(tree)

    def errors(settings: list[list[float]]) -> list[float]:
        texts = [shown(v) for v in settings]
        got = {r.candidate: r.mse if r.valid and r.mse is not None else np.inf for r in ex.score_candidates(df, list(dict.fromkeys(texts)), xs, y).collect()}
        return [got[t] for t in texts]

    best = errors([values])[0]
    step = [max(0.25, abs(v)) for v in values]
    for _ in range(rounds if values else 0):
        tries = []
        for k in range(len(values)):
            for sign in (-1, 1):
                for f in (1.0, 0.5, 0.1, *rng.uniform(0, 1, max(0, width // 2 - 3))):
                    v = list(values)
                    v[k] += sign * f * step[k]
                    tries.append(v)
        got = errors(tries)
        k = int(np.argmin(got))
        if got[k] < best * (1 - 1e-12):
            best, values = got[k], tries[k]
        else:
            step = [s * 0.3 for s in step]
    return shown(values), float(best)


def prune(df: DataFrame, text: str, xs: list[Column], y: Column, tolerance: float = 1e-3, budget=None) -> tuple[str, float, list[str]]:
    """Drop the top-level term whose removal costs least, refit, and repeat while the error stays within the tolerance.  All trials come from one set of statistics."""
    terms = summands(text, len(xs))
    s = _statistics(df, terms, xs, y)
    names = list(s.terms)

    def error(kept: list[str]) -> float:
        part = s.of(tuple(kept))
        return gram.squared_error(part, gram.ridge(part, 1e-8, free=())) if kept else s.yy / s.n

    base, dropped = error(names), []
    floor = base + tolerance * max(base, s.yy / s.n * 1e-6)
    while len(names) > 1:
        if budget is not None and not budget.consume("prune", len(names)):
            break
        cost, out = min((error([n for n in names if n != t]), t) for t in names)
        if cost > floor:
            break
        names.remove(out)
        dropped.append(terms[int(out[1:])])
    part = s.of(tuple(names))
    return _rendered([terms[int(n[1:])] for n in names], gram.ridge(part, 1e-8, free=())), error(names), dropped


def ablation(df: DataFrame, text: str, xs: list[Column], y: Column, threshold: float = 1e-5) -> list[dict]:
    """For each top-level term: relative rise of the error when the rest is refitted without it, and whether that is measurable."""
    terms = summands(text, len(xs))
    s = _statistics(df, terms, xs, y)

    def error(kept: tuple[str, ...]) -> float:
        part = s.of(kept)
        return gram.squared_error(part, gram.ridge(part, 1e-8, free=())) if kept else s.yy / s.n

    whole = error(s.terms)
    spread = max(s.yy / s.n, 1e-300)
    return [{"term": t, "rise": (e := error(tuple(n for n in s.terms if n != f"t{k}"))) - whole, "measurable": (e - whole) / spread >= threshold} for k, t in enumerate(terms)]


@dataclass(frozen=True)
class Similarity:
    corr: float
    nrmse: float


def similarity(df: DataFrame, pairs: list[tuple[str, str]], xs: list[Column]) -> list[Similarity]:
    """Absolute correlation and the error of the best scaling, of pairs of expressions, in one aggregate."""
    aggs = []
    for k, (a, b) in enumerate(pairs):
        p, q = ex.compile_expression(a, xs), ex.compile_expression(b, xs)
        aggs += [F.abs(metrics.safe_corr(p, q)).alias(f"c{k}"), F.avg(p * p).alias(f"pp{k}"), F.avg(q * q).alias(f"qq{k}"), F.avg(p * q).alias(f"pq{k}")]
    r = df.agg(*aggs).first()
    out = []
    for k in range(len(pairs)):
        pp, qq, pq = (float(r[f"{n}{k}"] or 0.0) for n in ("pp", "qq", "pq"))
        rest = max(0.0, 1 - pq * pq / (pp * qq)) if pp > 0 and qq > 0 else 1.0
        out.append(Similarity(float(r[f"c{k}"]), rest**0.5))
    return out


def semantic_matches(df: DataFrame, source: list[str], target: list[str], xs: list[Column], corr: float = 0.985, nrmse: float = 0.08) -> list[tuple[int, int]]:
    """Greedy one-to-one matching of terms that say the same: by canonical form, correlation, or projection error."""
    pairs = [(i, j) for i in range(len(source)) for j in range(len(target))]
    if not pairs:
        return []
    got = similarity(df, [(source[i], target[j]) for i, j in pairs], xs)
    d = len(xs)
    good = [(-s.corr, s.nrmse, i, j) for s, (i, j) in zip(got, pairs, strict=True) if ex.canonical(source[i], d) == ex.canonical(target[j], d) or s.corr >= corr or s.nrmse <= nrmse]
    left, right, out = set(), set(), []
    for _, _, i, j in sorted(good):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


def domain_metrics(train: DataFrame, valid: DataFrame, text: str, xs: list[Column], y: Column, folds: int = 5) -> dict[str, float]:
    """Error, tails, the worst of hashed folds, and the error on rows outside the training range of any feature; all infinite where the expression isn't defined on a row."""
    p = ex.compile_expression(text, xs)
    if not ex.score_candidates(valid, [text], xs, y).first().valid:
        return dict.fromkeys(("val_nmse", "val_p99", "val_max_rel", "val_share", "stress_nmse", "ood_nmse", "complexity"), float("inf"))
    v = valid.select(*[x.alias(f"_x{k}") for k, x in enumerate(xs)], y.alias("_y"), p.alias("_p"))
    yy, pp = F.col("_y"), F.col("_p")
    block = metrics.tail_block(v.withColumn("_k", F.lit(0)), yy, pp, ["_k"]).first()
    stress = v.groupBy(F.pmod(F.xxhash64("_y", *[f"_x{k}" for k in range(len(xs))]), F.lit(folds)).alias("f")).agg(metrics.nmse(yy, pp).alias("e")).agg(F.max("e")).first()[0]
    out = F.lit(False)
    for k, x in enumerate(xs):
        q = {r.level: r.q for r in quantiles(train, x.cast("double"), [0.05, 0.95]).collect()}
        out = out | (F.col(f"_x{k}") < q[0.05]) | (F.col(f"_x{k}") > q[0.95])
    ood = v.where(out).agg(metrics.nmse(yy, pp)).first()[0]
    return {"val_nmse": block.nmse, "val_p99": block.p99, "val_max_rel": block.max_rel, "val_share": block.share_01, "stress_nmse": stress, "ood_nmse": ood if ood is not None else block.nmse, "complexity": ex.complexity(text, len(xs))}


def retained(source: list[str], final: list[str], matches: list[tuple[int, int]], effects: list[dict]) -> bool:
    """Whether an edit left a trace: a new term that matches and matters, or a term that is gone."""
    matched = {j for _, j in matches}
    return any(e["measurable"] and j in matched for j, e in enumerate(effects)) or len(matched) < len(source)


def retention(train: DataFrame, valid: DataFrame, parent: str, proposal: str, final: str, xs: list[Column], y: Column, least: float = 1e-5) -> dict:
    """What of a proposed edit is left in a final expression, and whether it matters: an added term that is found again and
    whose removal is measurable, a term that is gone for good to some effect, or other constants to some effect.

    Terms are told apart by what they say on the training rows; effects are of predictions on the validation rows, over the size of y.
    """
    d = len(xs)
    old, new, now = (summands(t, d) for t in (parent, proposal, final))
    kept = semantic_matches(train, new, old, xs)
    added = [t for k, t in enumerate(new) if k not in {i for i, _ in kept}]
    deleted = [t for k, t in enumerate(old) if k not in {j for _, j in kept}]
    found = sorted({j for _, j in semantic_matches(train, added, now, xs)})
    effects = ablation(valid, final, xs, y, least) if found else []
    still = semantic_matches(train, deleted, now, xs)
    a, b = ex.compile_expression(parent, xs), ex.compile_expression(final, xs)
    r = valid.agg(F.sqrt(F.avg((a - b) * (a - b))).alias("rms"), F.greatest(F.sqrt(F.avg(y * y)), F.stddev_pop(y), F.lit(1e-12)).alias("size")).first()
    effect = float(r.rms or 0.0) / float(r["size"] or 1e-12)
    by_term = bool(added and any(e["measurable"] for k, e in enumerate(effects) if k in found))
    gone = bool(deleted and not still)
    by_deletion = gone and (ex.complexity(final, d) < ex.complexity(parent, d) - 1e-12 or effect >= least)
    action = edit_label(parent, final, d)
    by_constants = action == "REPARAMETERIZE" and effect >= least
    return {"retained": by_term or by_deletion or by_constants, "action": action, "added": added, "deleted": deleted, "added_retained": by_term, "deletion_effective": by_deletion, "reparameterized": by_constants, "effect": effect}
