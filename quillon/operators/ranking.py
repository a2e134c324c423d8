"""Stable choices, certificates, skylines, top-k and multiset differences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators.ordered import quantiles

TIE = 1e-15
#: Partitions of the levels at which local fronts meet.
MERGES = (32, 1)


def stable_argmax(df: DataFrame, keys: list[str], score: str, ident: str, tie: float = TIE) -> DataFrame:
    """By keys, the smallest id among the scores within `tie` of the largest."""
    best = df.groupBy(*keys).agg(F.max(score).alias("best"))
    return df.join(best, keys).where(F.col(score) >= F.col("best") - tie).groupBy(*keys).agg(F.min(ident).alias(ident), F.max("best").alias("best"))


def stable_argmin(df: DataFrame, keys: list[str], score: str, ident: str, tie: float = TIE) -> DataFrame:
    least = df.groupBy(*keys).agg(F.min(score).alias("least"))
    return df.join(least, keys).where(F.col(score) <= F.col("least") + tie).groupBy(*keys).agg(F.min(ident).alias(ident), F.max("least").alias("least"))


def certificate(df: DataFrame, keys: list[str], score: str, error: str, ident: str) -> DataFrame:
    """By keys: the leader, and whether its margin over every competitor exceeds both errors.

    The least margin needs only the best score-plus-error of the others, which two order statistics give.
    """
    lead = df.groupBy(*keys).agg(F.max_by(F.struct(F.col(ident).alias("i"), F.col(score).alias("s"), F.col(error).alias("e")), F.struct(F.col(score).alias("s"), (-F.col(ident)).alias("i"))).alias("lead"))
    rest = df.join(lead, keys).where(F.col(ident) != F.col("lead.i")).groupBy(*keys).agg(F.max(F.col(score) + F.col(error)).alias("other"))
    out = lead.join(rest, keys, "left")
    gap = F.col("lead.s") - F.col("lead.e") - F.col("other")
    return out.select(*keys, F.col("lead.i").alias("leader"), gap.alias("gap"), F.coalesce(gap > 0, F.lit(True)).alias("certified"))


def envelope_certificate(df: DataFrame, keys: list[str], lower: str, upper: str, ident: str) -> DataFrame:
    """By keys: whether the largest lower bound exceeds every other upper bound."""
    lead = df.groupBy(*keys).agg(F.max_by(F.struct(F.col(ident).alias("i"), F.col(lower).alias("l")), F.struct(F.col(lower).alias("l"), (-F.col(ident)).alias("i"))).alias("lead"))
    rest = df.join(lead, keys).where(F.col(ident) != F.col("lead.i")).groupBy(*keys).agg(F.max(upper).alias("other"))
    return lead.join(rest, keys, "left").select(*keys, F.col("lead.i").alias("leader"), F.coalesce(F.col("lead.l") > F.col("other"), F.lit(True)).alias("certified"))


def pareto_front(df: DataFrame, ident: str, metrics: list[str], slack: float = 1e-12, pruners: int = 256) -> DataFrame:
    """Rows that no other beats: at most `slack` worse in every metric, better by more than it in one; less is better.

    A bounded set of strong rows is sent to all partitions first, each partition then keeps its
    own front, and the fronts meet in a tree, so one last kernel sees what some tens of merged
    fronts left.
    """
    strong = df.orderBy(sum((F.col(m) for m in metrics), F.lit(0.0)), ident).limit(pruners).select(*metrics).collect()
    prune = np.array([[float(v) for v in r] for r in strong]).reshape(-1, len(metrics))
    kinds = dict(df.dtypes)

    def front(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows of x that no row of y dominates."""
        keep = np.ones(len(x), bool)
        for r in y:
            keep &= ~((r <= x + slack).all(axis=1) & (r < x - slack).any(axis=1))
        return keep

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in parts:
            x = p[metrics].to_numpy(float)
            p = p[front(x, prune)]
            held = p if held is None else pd.concat([held, p])
            x = held[metrics].to_numpy(float)
            held = held[front(x, x[np.argsort(x.sum(axis=1))])]
        if held is not None:
            yield held

    schema = ", ".join(f"{c} {kinds[c]}" for c in [ident, *metrics])
    left = df.select(ident, *metrics).mapInPandas(local, schema)
    for parts in MERGES:
        left = left.repartition(parts).mapInPandas(local, schema)
    return left


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def retrieve(df: DataFrame, tokens: str, wanted: list[str], gain: Column, stability: Column, k: int, ident: str) -> DataFrame:
    """The k rows of highest Jaccard similarity plus .20 gain plus .05 stability."""
    score = jaccard(F.col(tokens), F.array(*map(F.lit, wanted))) + 0.20 * gain + 0.05 * stability
    return df.withColumn("score", score).orderBy(F.desc("score"), ident).limit(k)


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """The first row of each group by `order`."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("_b")).select(*keys, "_b.*")


def least_favourable(df: DataFrame, keys: list[str], power: str, score: str, tie: float = TIE) -> DataFrame:
    """By keys (actions): the least score over likelihood powers, and the smallest power whose score is within `tie` of it.

    Two aggregates on the same keys, so rows are shuffled once and no group is held in a task.
    """
    least = df.groupBy(*keys).agg(F.min(score).alias("_least"))
    return df.join(least, keys).where(F.col(score) <= F.col("_least") + tie).groupBy(*keys).agg(F.min(power).alias(power), F.max("_least").alias("least"))


def best_with_median(df: DataFrame, keys: list[str], score: str, complexity: str, expression: str, fields: list[str]) -> DataFrame:
    """The best row of each group by score, complexity and expression, with the exact median score and the rows of the group."""
    best = best_per_group(df, keys, [F.col(score), F.col(complexity), F.col(expression)], fields)
    median = quantiles(df, F.col(score), [0.5], keys).select(*keys, F.col("q").alias("median"))
    count = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return best.join(median, keys).join(count, keys)


def top_distinct(df: DataFrame, digest: str, score: str, expression: str, k: int) -> DataFrame:
    """The k best rows by score and expression, of each digest the best one."""
    fields = [c for c in df.columns if c != digest]
    return best_per_group(df, [digest], [F.col(score), F.col(expression)], fields).orderBy(score, expression).limit(k)


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, only_a, only_b): how often a row is in one side more than in the other (EXCEPT ALL both ways)."""
    both = a.select(*columns, F.lit(1).alias("_s")).unionAll(b.select(*columns, F.lit(-1).alias("_s")))
    n = both.groupBy(*columns).agg(F.sum("_s").alias("_n")).where("_n <> 0")
    return n.select(*columns, F.greatest(F.col("_n"), F.lit(0)).alias("only_a"), F.greatest(-F.col("_n"), F.lit(0)).alias("only_b"))


def edit_action(added: Column, removed: Column, changed: Column | None = None, same_shape: Column | None = None, same_root: Column | None = None, same_variables: Column | None = None) -> Column:
    """The label of a structural change from counts of added and removed parts.

    changed: whether anything differs at all; same_shape: whether only constants do; same_root, same_variables: whether
    the outermost operation and the variables are the same.  Where these are not given, four labels are left.
    """
    no = F.lit(False)
    changed = changed if changed is not None else (added > 0) | (removed > 0)
    label = F.when(~changed, "NOOP").when(same_shape if same_shape is not None else no, "REPARAMETERIZE").when((added > 0) & (removed == 0), "ADD").when((removed > 0) & (added == 0), "DELETE")
    if same_root is not None and same_variables is not None:
        label = label.when(~same_root & same_variables, "CHANGE_OPERATOR").when(same_root & ~same_variables, "CHANGE_INTERACTION")
    return label.otherwise("REPLACE")


def edits(df: DataFrame, before: str, after: str, n_features: int) -> DataFrame:
    """Adds `action`, the label of the edit between two columns of expressions, and the parts that were added and removed; null where one can't be read.

    The parts of an expression are its subtrees but for constants; each pair of expressions is a row, told apart in Arrow batches.
    """
    fields = "added array<string>, removed array<string>, changed boolean, same_shape boolean, same_root boolean, same_variables boolean"

    @F.pandas_udf(f"struct<{fields.replace(', ', ',').replace(' ', ':')}>")
    def told(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        held: dict = {}
        return pd.DataFrame([_edit(x, y, n_features, held) for x, y in zip(a, b, strict=True)], columns=["added", "removed", "changed", "same_shape", "same_root", "same_variables"])

    d = df.withColumn("_edit", told(F.col(before), F.col(after)))
    e = F.col("_edit")
    action = F.when(e["changed"].isNotNull(), edit_action(F.size(e["added"]), F.size(e["removed"]), e["changed"], e["same_shape"], e["same_root"], e["same_variables"]))
    return d.withColumns({"action": action, "added": e["added"], "removed": e["removed"]}).drop("_edit")


def edit_label(a: str, b: str, n_features: int) -> str | None:
    """The label of one edit; None where an expression can't be read."""
    added, removed, changed, shape, root, variables = _edit(a, b, n_features, {})
    if changed is None:
        return None
    if not changed:
        return "NOOP"
    if shape:
        return "REPARAMETERIZE"
    if bool(added) != bool(removed):
        return "ADD" if added else "DELETE"
    return "CHANGE_OPERATOR" if not root and variables else "CHANGE_INTERACTION" if root and not variables else "REPLACE"


def _edit(a: str | None, b: str | None, d: int, held: dict) -> tuple:
    """What differs between two expressions; shapes are expressions whose constants are all alike."""

    def of(text: str) -> tuple:
        if text not in held:
            parts = ex.nodes(text, d)
            held[text] = ex.canonical(text, d), ex.canonical(re.sub(r"(?<![A-Za-z_\d.])\d+(\.\d+)?([eE][+-]?\d+)?", "7.25", text), d), Counter(n.signature for n in parts if n.kind != "constant"), (parts[0].kind, parts[0].label), frozenset(re.findall(r"\bx\d+\b", text))
        return held[text]

    try:
        x, y = of(a), of(b)
    except (TypeError, ValueError, SyntaxError, AttributeError, ZeroDivisionError, OverflowError):
        return None, None, None, None, None, None
    return sorted((y[2] - x[2]).elements()), sorted((x[2] - y[2]).elements()), x[0] != y[0], x[1] == y[1], x[3] == y[3], x[4] == y[4]


# Weights of the score and of the accuracy gain.
SCORE = {"val_nmse": 2.5, "stress_nmse": 0.7, "ood_nmse": 0.5, "ood_penalty": 0.15}
GAIN = {"val_nmse": 0.45, "val_p99": 0.25, "stress_nmse": 0.20, "ood_nmse": 0.10}


def log_metric(c: Column) -> Column:
    """log1p of a metric clipped to 1e18; 50 where it isn't finite."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, 50.0).otherwise(F.log1p(F.least(F.greatest(c, F.lit(0.0)), F.lit(1e18))))


def pareto_score(columns: dict[str, Column]) -> Column:
    return sum((F.lit(w) * log_metric(columns[k]) for k, w in SCORE.items()), F.lit(0.0))


def accuracy_gain(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """Weighted relative improvement."""
    return sum((F.lit(w) * (old[k] - new[k]) / F.greatest(F.abs(old[k]), F.lit(1e-12)) for k, w in GAIN.items()), F.lit(0.0))


def reference_dominance(df: DataFrame, keys: list[str], ident: str, lower: str, upper: str, reference: str, floor_at_zero: bool = False) -> DataFrame:
    """By keys: the leader by lower bound (ties to the smaller id), and whether it beats the reference policy's expected upper bound.

    The reference's floor may be raised to zero, for utilities that updating can only lose.
    """
    agg = df.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(ident).alias("i"), F.col(lower).alias("l")), F.struct(F.col(lower).alias("l"), (-F.col(ident)).alias("i"))).alias("lead"),
        (F.sum(F.col(reference) * F.col(upper)) / F.sum(reference)).alias("expected"),
        F.max(F.greatest(F.abs(lower), F.abs(upper))).alias("size"),
    )
    bar = F.greatest(F.lit(0.0), F.col("expected")) if floor_at_zero else F.col("expected")
    tolerance = 256 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.col("size"))
    return agg.select(*keys, F.col("lead.i").alias("leader"), F.col("lead.l").alias("leader_lower"), bar.alias("reference_upper"), ((F.col("lead.l") - bar) > tolerance).alias("hands_over"))
